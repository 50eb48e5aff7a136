"""Memory of the pruned join in a Python worker."""

import numpy as np
import pandas as pd

from openbound.operators import knn_pruned as KP

from .test_neighbors_memory import Sent, peak_mb


def test_visits_of_all_cells_are_packed(spark):
    rng = np.random.default_rng(7)
    n = 512
    p = rng.standard_normal((n, 4))
    p /= np.sqrt((p * p).sum(axis=1))[:, None]
    rows = np.ones(n, np.int64)
    rows[3] = 0
    cells = KP.Cells(p, np.full(n, 0.1), np.ones(n), np.ones(n), rows, np.ones(n, np.int64))
    x = pd.Series(list(rng.standard_normal((2000, 4))))
    out, mb = peak_mb(lambda: KP._visits(Sent(cells), 0, n).func(x, pd.Series(np.full(2000, -np.inf))))
    assert all(len(v) == n - 1 and 3 not in v for v in out)
    assert mb < 100                       # an object per visit: some 300 MB
    kth = pd.Series(np.full(2000, 0.5))
    b = cells.bounds(np.stack(x.to_numpy()))
    few = KP._visits(Sent(cells), 1, 4).func(x, kth)
    for i in range(0, 2000, 97):
        order = np.argsort(-b[i], kind="stable")[1:5]
        assert few[i].tolist() == [c for c in order if b[i, c] >= 0.5 and rows[c]]
