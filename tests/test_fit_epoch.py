"""Epochs in a barrier stage: equal to one job per step, restarted when a task is lost."""

import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from openbound.operators import fit as FT
from openbound.operators import fit_epoch as FE
from openbound.operators.prototypes import Prototypes
from openbound.operators.sampling import shuffled_batches

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(n=230, c=4, d=6, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(c, size=n)
    x = rng.standard_normal((c, d))[y] + 0.5 * rng.standard_normal((n, d))
    p = Prototypes(rng.standard_normal((c, d)), np.full(c, 0.2), rng.standard_normal((c, d)))
    return [(i, int(y[i]), x[i].tolist()) for i in range(n)], p


def unit(spark, data):
    return FT.unit_training_table(spark.createDataFrame(data, "row_id long, y int, x array<double>"), id_col="row_id")


def one_job_per_step(u, p, opt, variant, alpha, size, epoch):
    p, losses, b = p.copy(), [], shuffled_batches(u, size, seed=epoch)
    for number in range(-(-u.count() // size)):
        sums = FT.aggregate_sums(b.filter(F.col("batch") == number), p, variant, alpha)
        loss, d_p, d_m = FT.loss_and_grad(sums, p, variant, alpha)
        p = opt.apply(p, d_p, d_m)
        losses.append(loss)
    return p, opt, losses


@pytest.mark.parametrize("variant, size, tasks", [("new", 60, None), ("org", 150, 3)])
def test_same_steps_as_one_job_each(spark, variant, size, tasks):
    data, p = rows()
    u = unit(spark, data)
    opt, want_opt = FT.Optimiser(variant, 8, lr=1e-3), FT.Optimiser(variant, 8, lr=1e-3)
    got, want = p, p
    for epoch in range(2):
        got, opt, losses = FE.fit_epoch(u, got, opt, variant, 4.0, size, epoch, tasks)
        want, want_opt, expected = one_job_per_step(u, want, want_opt, variant, 4.0, size, epoch)
        assert len(losses) == -(-230 // size) and np.allclose(losses, expected, rtol=1e-9, atol=0)
    assert np.abs(got.proxy - want.proxy).max() < 1e-9 and opt.step_no == want_opt.step_no
    side = "margin_vec" if variant == "new" else "margin"
    assert np.abs(getattr(got, side) - getattr(want, side)).max() < 1e-9
    assert not np.allclose(got.proxy, p.proxy)                        # and the start is left as it was


def test_empty_table_and_stream_order(spark):
    data, p = rows(3)
    got, _, losses = FE.fit_epoch(unit(spark, [(1, 0, None)]), p, FT.Optimiser("new", 1), "new", 4.0, 10)
    assert losses == [] and np.array_equal(got.proxy, p.proxy)
    import pyarrow as pa
    b = [0, 0, 2, 2, 2, 5]
    batch = lambda lo, hi: pa.record_batch([pa.array(b[lo:hi], pa.int64()), pa.array(range(lo, hi), pa.int32()),     # noqa: E731
                                            pa.array([[float(i)] for i in range(lo, hi)], pa.list_(pa.float64()))], names=["b", "y", "x"])
    stream = FE._Rows(iter([batch(0, 1), batch(1, 1), batch(1, 4), batch(4, 6)]))
    assert [None if g is None else g[1].tolist() for g in map(stream.take, range(7))] == [[0, 1], None, [2, 3, 4], None, None, [5], None]


def test_a_lost_task_restarts_the_epoch(tmp_path):
    """In a session of its own that lets stages be tried again: one task fails in the middle of the
    first attempt; the result is that of a run without failure."""
    code = textwrap.dedent("""
        import os
        import sys
        sys.path.insert(0, ROOT)
        import numpy as np
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[3,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate())
        from openbound.session import ship_package
        ship_package(spark)
        from openbound.operators import fit as FT, fit_epoch as FE
        sys.path.insert(0, ROOT + "/tests")
        import test_fit_epoch as T

        class Torn(FT.Optimiser):
            def apply(self, p, d_p, d_m):
                from pyspark import BarrierTaskContext
                ctx = BarrierTaskContext.get()
                if self.step_no == 2 and ctx.partitionId() == 1 and not os.path.exists(FLAG):
                    open(FLAG, "w").close()
                    raise RuntimeError("lost on purpose")
                return super().apply(p, d_p, d_m)

        data, p = T.rows(120)
        u = T.unit(spark, data)
        plain = FE.fit_epoch(u, p, FT.Optimiser("new", 4, lr=1e-3), "new", 4.0, 30, tasks=3)
        torn = FE.fit_epoch(u, p, Torn("new", 4, lr=1e-3), "new", 4.0, 30, tasks=3)
        assert np.array_equal(plain[0].proxy, torn[0].proxy) and plain[2] == torn[2] and len(torn[2]) == 4
        print("SAME")
    """).replace("ROOT", repr(ROOT)).replace("FLAG", repr(str(tmp_path / "failed once")))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "SAME" in done.stdout and "lost on purpose" in done.stderr, done.stderr[-3000:]
