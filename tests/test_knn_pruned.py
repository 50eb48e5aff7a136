"""Pruned exact k-NN join (J6, T5) against brute force."""

import numpy as np
import pytest

from openbound.operators import knn_pruned as KP
from openbound.operators import neighbors as NB
from openbound.operators.prototypes import Prototypes

INDEX = "kind int, iid long, label int, v array<double>"


def brute(queries, index, k):
    usable = [r for r in index if r[3] is not None and None not in r[3] and np.isfinite(r[3]).all()]
    out = {}
    for qid, x in queries:
        if x is None or None in x or not np.isfinite(x).all():
            continue
        s = sorted((-float(KP.pair_products(np.array(x), np.array(r[3])[None, :])[0]), r[0], r[1], r[2]) for r in usable)
        out[qid] = [(kind, iid, label) for _, kind, iid, label in s[:k]]
    return out


def run(spark, queries, index, k, **kw):
    top, report = KP.similarity_topk(spark.createDataFrame(queries, "qid long, x array<double>"), spark.createDataFrame(index, INDEX), k, **kw)
    got: dict = {}
    for r in sorted(top.collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["kind"], r["iid"], r["label"]))
        assert r["rank"] == len(got[r["qid"]])
    return got, report


def small(rng, n, d=3):
    return rng.integers(-2, 3, (n, d)).astype(float)          # many ties and zero vectors


@pytest.mark.parametrize("k, pivots", [(1, None), (4, 9), (4, 1), (500, 7)])
def test_ties_zero_and_missing_vectors(spark, k, pivots):
    rng = np.random.default_rng(k)
    index = [(int(i % 2), i, int(rng.integers(4)), v.tolist()) for i, v in enumerate(small(rng, 150))]
    index += [(0, 900 + i, 1, [2.0, 2.0, 2.0]) for i in range(40)]                       # one vector, many rows
    index += [(0, 990, 0, None), (1, 991, 0, [1.0, None, 0.0]), (0, 992, 0, [float("nan")] * 3), (0, 993, 0, [float("inf"), 0.0, 0.0])]
    queries = [(i, v.tolist()) for i, v in enumerate(small(rng, 60))]
    queries += [(100, None), (101, [float("nan"), 0.0, 0.0]), (102, [0.0, 0.0, 0.0]), (103, [-0.0, 0.0, 0.0])]
    got, _ = run(spark, queries, index, k, pivots=pivots)
    assert got == brute(queries, index, k)


def test_empty_sides(spark):
    assert run(spark, [(1, [1.0, 0.0])], [], 3)[0] == {}
    assert run(spark, [], [(0, 1, 1, [1.0, 0.0])], 3)[0] == {}
    assert run(spark, [(1, [0.0, 0.0])], [(0, 5, 1, [0.0, 0.0])], 3)[0] == {1: [(0, 5, 1)]}
    assert run(spark, [(1, [1.0, 0.0])], [(0, 5, 1, [0.0, 0.0])], 3)[0] == {1: [(0, 5, 1)]}


def clustered(rng, n, centres, noise, d=16):
    c = rng.standard_normal((centres, d))
    c /= np.sqrt((c * c).sum(axis=1))[:, None]
    return c[rng.integers(centres, size=n)] + noise * rng.standard_normal((n, d))


def test_cells_are_skipped_and_the_result_is_exact(spark, monkeypatch):
    monkeypatch.setattr(KP, "SHARD_ROWS", 40)
    monkeypatch.setattr(KP, "QUERY_ROWS", 16)
    rng = np.random.default_rng(0)
    v = clustered(rng, 2000, 40, 0.03)
    v *= rng.uniform(0.5, 2.0, len(v))[:, None]
    v[::3] = v[0]                                                 # a third of all rows are one vector
    index = [(0, i, i % 5, x.tolist()) for i, x in enumerate(v)]
    queries = [(i, x.tolist()) for i, x in enumerate(clustered(np.random.default_rng(0), 120, 40, 0.03))]
    got, report = run(spark, queries, index, 5)
    assert got == brute(queries, index, 5)
    assert report.queries == 120 and report.index_rows == 2000
    assert report.skipped > 0.5 and report.visits < 0.5 * report.queries * report.cells
    assert report.rounds[0] == 120 and sum(report.rounds) == report.visits


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(1)
    v, x = rng.standard_normal((400, 8)) * rng.uniform(0, 3, (400, 1)), rng.standard_normal((50, 8)) * 5
    p = v[:12] / np.sqrt((v[:12] ** 2).sum(axis=1))[:, None]
    norm = np.sqrt((v * v).sum(axis=1))
    cos = np.clip(v @ p.T / norm[:, None], -1, 1)
    at = cos.argmax(axis=1)
    angle = np.arccos(cos[np.arange(400), at])
    cells = KP.Cells(p, *[np.array([f(w[at == c]) for c in range(12)]) for f, w in ((max, angle), (min, norm), (max, norm), (len, norm))], np.ones(12))
    assert ((x @ v.T) <= cells.bounds(x)[:, at] + 1e-12).all()


def test_vote_equals_the_broadcast_path(spark):
    rng = np.random.default_rng(3)
    v = clustered(rng, 300, 6, 0.2, 8)
    train = spark.createDataFrame([(i, int(i % 4), x.tolist()) for i, x in enumerate(v)], "row_id long, y int, x array<double>")
    protos = Prototypes(rng.standard_normal((4, 8)))
    rows = [(i, x.tolist()) for i, x in enumerate(clustered(rng, 80, 6, 0.2, 8))] + [(500, None), (501, [0.0] * 8)]
    q = spark.createDataFrame(rows, "row_id long, x array<double>")
    got, report = KP.knn_vote_pruned(q, train, protos, 7)
    want = NB.knn_vote(q, train, protos, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 <= report.skipped < 1
