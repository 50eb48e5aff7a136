"""Nearest neighbours by stable projections against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from openbound.llm import stable_search as S

SCHEMA = "vec_id long, embedding array<float>, vec string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)


def brute(rows, k=10):
    """(query, rank, id, score) with the row's own place left out."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and i % 100 == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), j is None, j or 0, j) for b, (j, w) in enumerate(ok) if b != a)
            out += [(i, r + 1, x[3], x[0]) for r, x in enumerate(d[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], rtol=0, atol=1e-9)


def test_nulls_ties_copies_and_odd_values(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(230)]
    rows += [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(1000, 1060)]                    # copies: ties by id
    rows += [(5000, None), (5100, [0.0] * 4), (5200, [1.0, None, 0.0, 0.0]), (5300, [float("nan")] * 4), (5400, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0, 1.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0]), (-100, [9.0, 9.0, 9.0, 8.0])]
    same(got(S.nearest(frame(spark, rows), stop=1 - 1e-12)), brute(rows))


def test_repeated_queries_and_large_ids(spark):
    big = 9_007_199_254_740_900
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (big, [1.0, 0.5]), (big + 1, [1.0, 0.5]), (None, [1.0, 0.25])]
    same(got(S.nearest(frame(spark, rows), k=3)), brute(rows, 3))


def test_few_candidates_and_empty_tables(spark):
    same(got(S.nearest(frame(spark, [(100, [1.0, 2.0]), (1, [1.0, 1.0])]))), [(100, 1, 1, 1.0)])
    assert S.nearest(frame(spark, [(100, [1.0, 2.0])])).count() == 0
    assert S.nearest(frame(spark, [(100, None)])).count() == 0
    with pytest.raises(ValueError, match="from 1 to 2 entries"):
        S.nearest(frame(spark, [(100, [1.0, 2.0]), (1, [1.0])]))


@pytest.mark.parametrize("stop, least", [(0.98, 0.9), (1 - 1e-9, 0.9999)])
def test_recall_over_many_cells_and_a_hot_vector(spark, monkeypatch, stop, least):
    monkeypatch.setattr(S, "SHARD_ROWS", 150)
    monkeypatch.setattr(S, "QUERY_ROWS", 7)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 24))
    v = centres[rng.integers(20, size=3000)] + 0.3 * rng.standard_normal((3000, 24))
    v[::3] = v[0]                                             # a third of all rows are one vector
    df = spark.createDataFrame([(i, x.tolist(), None, None) for i, x in enumerate(v)], SCHEMA)
    found = S.nearest(df, stop=stop).cache()
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0
    assert S.recall(found, df) >= least
    # ties of the hot vector: the smallest ids
    hot = [r["vec_id"] for r in found.filter("query_id = 0").orderBy("rank").collect()]
    assert hot == [3 * i for i in range(1, 11)]


def test_far_cells_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 100)
    asked = []
    plain = S._searched
    monkeypatch.setattr(S, "_searched", lambda q, *a: asked.append(q) or plain(q, *a))
    rng = np.random.default_rng(6)
    v = 50 * rng.standard_normal((16, 12))[rng.integers(16, size=1600)] + 0.1 * rng.standard_normal((1600, 12))
    df = spark.createDataFrame([(i, x.tolist(), None, None) for i, x in enumerate(v)], SCHEMA)
    found = S.nearest(df)
    assert S.recall(found, df) >= 0.98
    assert asked[1].count() <= 4 * 16                       # of 16 shards for 16 queries
    other = S.nearest(df, queries=F.col("vec_id") < 3, k=2)
    assert sorted(r["query_id"] for r in other.collect()) == [0, 0, 1, 1, 2, 2]


def test_chi_square_by_simulation():
    x = (np.random.default_rng(0).standard_normal((200_000, S.PROJECTED)) ** 2).sum(axis=1)
    for p in (0.1, 0.5, 0.9, 0.98):
        assert abs((x <= S.chi_square_bound(p)).mean() - p) < 0.005
