"""Whitening against numpy's dense solvers."""

import numpy as np
import pytest

from openbound.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, vec string, n string"
RNG = np.random.default_rng(0)


def matrices():
    for m in (1, 2, 3, 5, 20, 64):
        yield RNG.standard_normal((m + 30, m))
        a = RNG.standard_normal((m + 30, m))
        a[:, 0] = 0
        yield a
        a = RNG.standard_normal((m + 30, m))
        a[:, m // 2] = 0
        yield a
        yield RNG.standard_normal((m + 30, m)) * np.logspace(0, -12, m)
        yield RNG.standard_normal((m + 30, m)) * np.logspace(-12, 0, m)
        yield np.vstack([np.eye(m)] * 3)
        yield np.ones((m + 3, m))
        yield RNG.standard_normal((m + 3, 1)) @ RNG.standard_normal((1, m))
        yield np.vstack([np.diag(np.repeat(np.arange(1.0, m + 1), 2)[:m])] * 2) @ np.linalg.qr(RNG.standard_normal((m, m)))[0]
        yield np.diag(np.abs(np.arange(m) - m // 2) + 1e-9 * np.arange(m)) + np.diag(np.ones(m - 1), 1)


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: f"{a.shape}")
def test_solver(a):
    m = a.shape[1]
    r = np.zeros((m, m))
    t = np.linalg.qr(a, mode="r")
    r[:len(t)] = t
    want = np.linalg.svd(r, compute_uv=False) ** 2
    diag, upper, v = W.bidiagonal(r)
    b = np.diag(diag) + np.diag(upper, 1)
    assert np.abs(v.T @ v - np.eye(m)).max() < 1e-13
    assert np.abs(np.linalg.svd(b, compute_uv=False) ** 2 - want).max() <= 1e-13 * max(want[0], 1e-300)
    e, u, trace = W.directions(r, 1, 8)
    if not want[0]:
        assert not len(e)
        return
    assert np.abs(e - want[:len(e)]).max() <= 1e-13 * want[0] and abs(trace / want.sum() - 1) < 1e-13
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-10
    assert np.abs(r.T @ (r @ u) - u * e).max() < 1e-10 * want[0]


def test_small_values_keep_relative_accuracy():
    """Of a graded bidiagonal matrix, against exact fractions by bisection of the determinant's signs."""
    diag, upper = 10.0 ** -np.arange(0, 16, 2.0), 10.0 ** -np.arange(1, 15, 2.0) * 0.5
    got = W.dqds(diag, upper)
    prod = float(np.prod(diag ** 2))
    assert abs(np.prod(got) / prod - 1) < 1e-12          # the determinant is exact only if all values are


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    return W.whiten(df, **kw).collect()


def test_dropped_rows_copies_and_null_ids(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(40)]
    good += [(7, good[7][1]), (None, good[8][1])] + [(100 + i, good[0][1]) for i in range(25)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = run(spark, good + bad)
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)) + 100000
    n, s = len(x), x.sum(axis=0)
    assert len(rows) == 5 * n and {r["n"] for r in rows} == {n}
    cov = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(cov)
    want = sorted((-1 if i is None else i, c + 1, round(abs(float(w)), 7), int(((n * y - s) ** 2).sum()))
                  for (i, _), y in zip(good, x) for c, w in enumerate((y - s / n) @ u[:, ::-1] / np.sqrt(e[::-1])))
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"], round(abs(r["whitened"]), 7), r["deviation"]) for r in rows)
    assert got == want
    assert max(r["identity_error"] for r in rows) < 1e-10
    explained = {r["component"]: r["explained"] for r in rows}
    assert np.allclose([explained[c + 1] for c in range(5)], e[::-1] / e.sum(), rtol=1e-10)


def test_no_variance_and_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(1, [1.0, 2.0])]) == []
    assert run(spark, [(i, [0.5, 0.5]) for i in range(9)]) == [] and run(spark, [(1, []), (2, [])]) == []
    flat = run(spark, [(i, [0.5, i / 4]) for i in range(9)])
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_errors_that_say_so(spark):
    with pytest.raises(Exception, match="entries"):
        run(spark, [(1, [1.0, 2.0]), (2, [1.0])])
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30, 2.0]), (2, [1.0, 1.0])])
    with pytest.raises(Exception, match="does not fit"):
        run(spark, [(i, [1e9 * (i % 7), 2.0]) for i in range(50)])


def test_many_partitions_reduce_in_levels(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), None, None) for i, x in enumerate(v)], SCHEMA).repartition(70)
    n, s = W.fit_sums(df, "embedding", 1024, 0)
    x = np.floor(1024 * v.astype(float))
    assert n == 900 and s == x.sum(axis=0).astype(int).tolist()
    r = W.reduced_triangle(df, "embedding", n, s, 1024, 0)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12)
