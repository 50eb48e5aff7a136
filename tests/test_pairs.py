"""Pairs of packs: the result of all pairs, with a copy of a row per pack and not per pair."""

import os

import numpy as np
import pytest

from openbound.operators import knn_pruned as KP
from openbound.operators import neighbors as NB
from openbound.operators import pairs as PA
from openbound.operators.prototypes import Prototypes
from openbound.session import ensure_checkpoint_dir


@pytest.mark.parametrize("predict", [lambda *a, **kw: NB.knn_vote(*a, k=7, **kw), NB.class_average_predict])
def test_many_blocks_in_many_partitions_equal_the_broadcast_path(spark, monkeypatch, predict):
    # keys of the two sides must meet when partitions are not put together
    monkeypatch.setattr(PA, "PACK_ROWS", 40)
    rng = np.random.default_rng(3)
    train = spark.createDataFrame([(i, int(i % 4), x.tolist()) for i, x in enumerate(rng.integers(-2, 3, (400, 4)).astype(float))] + [(900, 1, None)],
                                  "row_id long, y int, x array<double>")
    rows = [(i, x.tolist()) for i, x in enumerate(rng.integers(-2, 3, (90, 4)).astype(float))] + [(500, None), (501, [0.0] * 4)]
    q, protos = spark.createDataFrame(rows, "row_id long, x array<double>"), Prototypes(rng.standard_normal((5, 4)))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = predict(q, train, protos, broadcast_limit=0, block_rows=20).collect()
    finally:
        spark.conf.set(key, old)
    assert sorted(map(tuple, got)) == sorted(map(tuple, predict(q, train, protos).collect()))


def test_visits_of_all_cells_write_no_vector_per_visit(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 48))                   # no structure: all cells are visited
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "qid long, x array<double>")
    index = rows.selectExpr("0 AS kind", "qid AS iid", "0 AS label", "x AS v")
    top = ensure_checkpoint_dir(spark).removeprefix("file:")

    def kept():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = kept()
    got, report = KP.similarity_topk(rows, index, 3, pivots=40)
    assert kept() - before < 12 * v.nbytes                # a vector per visit: 40 times
    assert report.visits > 20 * len(v)
    want = np.argsort(-(v @ v.T), axis=1)[:, :3]
    assert all(want[r["qid"], r["rank"] - 1] == r["iid"] for r in got.collect())


def test_best_keeps_ties_by_kind_and_id():
    rng = np.random.default_rng(6)
    x, v = rng.integers(-1, 2, (9, 3)).astype(float), rng.integers(-1, 2, (200, 3)).astype(float)
    kind, iid = rng.integers(2, size=200).astype("int32"), rng.permutation(200)
    for k in (1, 5, 300):
        best = PA.Best(9, k)
        for lo in range(0, 200, 17):
            best.offer(np.arange(9), x @ v[lo:lo + 17].T, kind[lo:lo + 17], iid[lo:lo + 17], iid[lo:lo + 17])
        for i in range(9):
            want = sorted((-p, a, b) for p, a, b in zip(v @ x[i], kind, iid))[:k]
            n = best.held[i]
            assert [(-s, a, b) for s, a, b in zip(best.score[i][:n], best.kind[i], best.iid[i])] == want
