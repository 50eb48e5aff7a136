"""Neighbour-preserving layout (R4): neighbours, weights, mesh field and the layout itself."""

import numpy as np
import pytest

from openbound.operators import layout as LY
from openbound.operators.project import pca_project

SCHEMA = "row_id long, x array<double>"


def planted(seed=3, clusters=12, per=20, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (clusters, dim))
    return np.vstack([c + rng.normal(0, 1, (per, dim)) for c in centres])


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def places(df):
    return np.array([r[1:] for r in sorted(df.collect(), key=lambda r: r[0])])


def recall(x, y, k=10):
    """Mean share of the k nearest rows in ``x`` that are among the k nearest in ``y``."""
    def near(m):
        d = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x), near(y))])


def test_neighbours_are_those_of_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (80, 3)).astype(float) + 7          # ties and copies, far from the origin
    got: dict = {}
    for r in sorted(LY.euclidean_neighbours(table(spark, x), 6).collect(), key=lambda r: (r[0], r[1])):
        got.setdefault(r["row_id"], []).append((round(r["dist2"], 6), r["nbr"]))
    for i in range(len(x)):
        d = sorted((round(float(((x[i] - v) ** 2).sum()), 6), j) for j, v in enumerate(x) if j != i)
        assert [e[0] for e in got[i]] == [e[0] for e in d[:6]]
        assert len({e[1] for e in got[i]}) == 6 and i not in {e[1] for e in got[i]}


def test_weights_have_the_perplexity(spark):
    x = planted(clusters=3, per=15)
    near = LY.euclidean_neighbours(table(spark, x), 12).collect()
    weights = {(r["a"], r["b"]): r["w"] for r in LY.neighbour_weights(spark.createDataFrame(near), 5.0).collect()}
    want: dict = {}
    for i in range(len(x)):
        mine = sorted((r["rank"], r["nbr"], r["dist2"]) for r in near if r["row_id"] == i)
        d = np.array([m[2] for m in mine]) - mine[0][2]
        lo, hi = -60.0, 60.0
        for _ in range(60):
            e = np.exp(-(2 ** ((lo + hi) / 2)) * d)
            p = e / e.sum()
            wide = -(p[p > 0] * np.log(p[p > 0])).sum() > np.log(5.0)
            lo, hi = ((lo + hi) / 2, hi) if wide else (lo, (lo + hi) / 2)
        for (_, j, _), v in zip(mine, p):
            key = (min(i, j), max(i, j))
            want[key] = want.get(key, 0) + v / 2
    assert weights.keys() == want.keys()
    assert all(abs(weights[k] - want[k]) < 1e-9 for k in want)


def test_field_is_near_the_sum_over_all_pairs(spark):
    y = np.random.default_rng(1).normal(0, 6, (300, 2))
    state = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)], "id long, y0 double, y1 double")
    field = LY.Field(LY._node_shares(state, LY.NODE_WIDTH), LY.NODE_WIDTH)
    got = np.stack(field.at(y[:, 0], y[:, 1]), axis=1)
    d = y[:, None, :] - y[None, :, :]
    q = 1 / (1 + (d ** 2).sum(axis=2))
    want = (q[:, :, None] ** 2 * d).sum(axis=1)
    assert np.abs(got - want).max() < 0.05 * np.abs(want).max()
    assert field.total == pytest.approx(q.sum() - len(y), rel=0.02)


def test_pull_counts_every_edge_also_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(LY, "HUB_EDGES", 5)
    rng = np.random.default_rng(2)
    y = rng.normal(0, 2, (40, 2))
    pairs = {(0, j): float(rng.random()) for j in range(1, 40)} | {(3, 9): 0.5, (8, 21): 0.25}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, w double")
    ids = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(y)], "id long, y0 double, y1 double")
    salted, state = LY._salted(edges, ids)
    assert salted.count() == len(pairs) and state.agg({"salts": "max"}).first()[0] == 8
    got = {r["id"]: np.array([r["p0"], r["p1"]]) / LY.PULL_UNIT for r in LY._pull(salted, state).collect()}
    want = {i: np.zeros(2) for i in got}
    for (a, b), w in pairs.items():
        d = y[b] - y[a]
        want[a] = want[a] + w * d / (1 + d @ d)
        want[b] = want[b] - w * d / (1 + d @ d)
    assert all(np.abs(got[i] - want[i]).max() < 1e-6 for i in want)


def test_neighbours_are_kept_better_than_by_components(spark):
    x = planted()
    df = table(spark, x)
    flat = recall(x, places(pca_project(df, "x", 2, ["row_id"])))
    ours = recall(x, places(LY.neighbour_layout(df, k=20, perplexity=8.0, rounds=24)))
    assert ours > flat + 0.15, (ours, flat)


def test_same_layout_for_any_partitioning(spark):
    df = table(spark, planted(clusters=4, per=12))
    one, many = (places(LY.neighbour_layout(df.repartition(n, "row_id"), k=8, perplexity=4.0, rounds=6)) for n in (1, 13))
    assert (one == many).all()


def test_missing_copies_and_small_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 0.0]), (3, [1.0, 2.0]), (4, [1.0, None]), (5, [4.0, 0.0]), (6, [1.0, 2.0])]
    got = {r["row_id"]: r for r in LY.neighbour_layout(spark.createDataFrame(rows, SCHEMA), k=3, perplexity=2.0, rounds=3).collect()}
    assert len(got) == 7
    assert all((got[i]["dim0"] is None) == (i in (1, 2, 4)) for i in got)
    assert all(np.isfinite(got[i]["dim0"]) and np.isfinite(got[i]["dim1"]) for i in (0, 3, 5, 6))
    only = LY.neighbour_layout(spark.createDataFrame([(7, [1.0])], SCHEMA)).collect()
    assert [tuple(r) for r in only] == [(7, 0.0, 0.0)]
    assert LY.neighbour_layout(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        LY.neighbour_layout(spark.createDataFrame([], SCHEMA), k=3, perplexity=4.0)
