"""Memory of the memory-based predictors in a Python worker: bounded by tiles, not by the index."""

import tracemalloc

import numpy as np
import pandas as pd

from openbound.operators import neighbors as NB


class Sent:
    def __init__(self, value):
        self.value = value


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 2 ** 20
    finally:
        tracemalloc.stop()


def test_tiles_give_the_top_of_all_with_ties(monkeypatch):
    rng = np.random.default_rng(3)
    x, im = (rng.integers(-1, 2, (n, 3)).astype(float) for n in (40, 501))
    monkeypatch.setattr(NB, "TILE_ROWS", 7)
    for k in (1, 5, 9, 600):
        at, score = NB._tiled_topk(x, im, k)
        want = np.argsort(-(x @ im.T), axis=1, kind="stable")[:, :k]
        assert (at == want).all()
        assert (score == np.take_along_axis(x @ im.T, want, axis=1)).all()


def test_sums_over_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    x, im, labels = rng.integers(-1, 2, (9, 3)).astype(float), rng.integers(-1, 2, (50, 3)).astype(float), rng.integers(4, size=50)
    monkeypatch.setattr(NB, "TILE_ROWS", 8)
    total, count = NB._class_sums(x, im, labels, 4)
    dots = x @ im.T
    for c in range(4):
        assert (total[:, c] == dots[:, labels == c].sum(axis=1)).all()
        assert (count[:, c] == (dots[:, labels == c] != 0).sum(axis=1)).all()


def test_a_block_pair_with_missing_vectors_holds_a_tile_of_products():
    rng = np.random.default_rng(5)
    n, dim = 20_000, 4
    made = []

    def make(qid, x, im, kind, iid, label):
        at, score = NB._tiled_topk(x, im, 5)
        made.append(len(qid))
        return np.repeat(qid, 5), score.ravel(), kind[at].ravel(), iid[at].ravel(), label[at].ravel()
    columns = {"qid": "int64", "score": "float64", "kind": "int32", "iid": "int64", "label": "int32"}
    q = pd.DataFrame({"qid": np.arange(2000), "x": list(rng.standard_normal((2000, dim)))})
    ix = pd.DataFrame({"kind": 0, "iid": np.arange(n), "label": 1, "v": list(rng.standard_normal((n, dim)))})
    ix.loc[7, "v"] = None
    out, mb = peak_mb(lambda: NB._pair(make, columns, dim)(q, ix))
    assert len(out) == 5 * 2000 and 7 not in set(out["iid"])
    assert max(made) <= NB.QUERY_ROWS
    assert mb < 160                       # all products at once: 305 MB, and as much again to rank them


def test_broadcast_index_holds_a_tile_of_products():
    rng = np.random.default_rng(6)
    n = 30_000
    index = (np.zeros(n, np.int32), np.arange(n), rng.integers(3, size=n), rng.standard_normal((n, 4)))
    q = pd.DataFrame({"qid": np.arange(1000), "x": list(rng.standard_normal((1000, 4)))})
    predict = NB._broadcast_predict(Sent(index), lambda x, im, labels: NB._vote(labels[NB._tiled_topk(x, im, 5)[0]], 3), 2)
    out, mb = peak_mb(lambda: pd.concat(predict([q])))
    assert len(out) == 1000
    assert mb < 160                       # 229 MB for the products alone
