import numpy as np
from pyspark.sql import functions as F

from openbound.llm import quality as Q

SF01 = "/root/testdata/sf0.01"


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    acc = [0.95, 0.9, 0.8, 0.7, 0.6]
    y = rng.random(40_000) < 0.7
    v = np.full((len(y), len(acc)), Q.NONE)
    for j, a in enumerate(acc):
        cast, right = rng.random(len(y)) < 0.7, rng.random(len(y)) < a
        v[cast, j] = np.where(y == right, Q.GOOD, Q.LOW)[cast]
    codes = (v * 3 ** np.arange(len(acc))[::-1]).sum(axis=1)
    assert (Q.unpack(codes, len(acc)) == v).all()
    uniq, n = np.unique(codes, return_counts=True)
    model = Q.fit_label_model(uniq, n, n=len(acc))
    assert np.abs(model.accuracies() - acc).max() < 0.03 and abs(model.prior - 0.7) < 0.03
    p = model.posterior(codes)
    best = (p >= .5) == y
    single = [((v[:, j] == Q.GOOD) == y)[v[:, j] != Q.NONE].mean() for j in range(len(acc))]
    assert best.mean() > 0.88 and best[(v[:, 0] != Q.NONE)].mean() >= max(single) - 0.005


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    gold = spark.read.parquet(f"{SF01}/labels.parquet")
    got = Q.classify(docs).join(gold, "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    low = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) >= 0.99 and np.mean(low) <= 0.1


def _word(n):
    out = ""
    n = n * 2654435761 % 2**32
    for _ in range(3 + n % 4):
        n, r = divmod(n, 17)
        out += "bcdfglmnprstvaeio"[r] + "aeiou"[r % 5]
    return out


def test_edge_cases(spark):
    cols = "doc_id long, text string, kept string, quality_score string, `a b` int"
    rows = [(1, None, "x", "y", 1), (2, "", "x", "y", 1), (None, "word " * 3000, "x", "y", 1), (3, "Fine text here.", "x", "y", 1),
            (3, "Fine text here.", "x", "y", 1)] + [
        (10 + i, " ".join(_word(31 * i + j) for j in range(60)) + ".", "x", "y", 1) for i in range(40)] + [
        (60 + i, "BUY!! NOW!! " * (20 + i), "x", "y", 1) for i in range(6)]
    df = spark.createDataFrame(rows, cols)
    out = Q.classify(df)
    assert set(out.columns) == set(df.columns)
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert out.count() == len(rows) and got[12] and not got[61]
    assert got[1] == got[2] and None not in got.values()
    empty = spark.createDataFrame([], cols)
    assert Q.classify(empty).count() == 0
    assert out.filter(F.col("quality_score").isNull()).count() == 0


def test_long_text_scored_in_stretches():
    rng = np.random.default_rng(0)
    s = Q.Scorer(rng.normal(size=1 << Q.DIM_BITS).astype(np.float32), 0.1)
    t = "abc dé" * 400_000
    want = 0.1 + float(Q.features(t).astype(np.float64) @ s.weights)
    assert abs(s.probability(t) - 1 / (1 + np.exp(-want))) < 1e-3


def test_common_text_takes_its_share_of_the_sample(spark, monkeypatch):
    """A third of all rows share a text; picked or not by its hash, it counts as a third of the sample."""
    texts = [" ".join(_word(31 * i + j) for j in range(30)) + "." for i in range(2000)]
    some = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)))
    order = [r["text"] for r in some.orderBy("h").collect()]
    seen = []

    def fit(x, p, bits, copies=None):
        seen.append((x, np.ones(len(x)) if copies is None else copies))
        return Q.Scorer(np.zeros(x.shape[1], np.float32), 0.0, bits)
    monkeypatch.setattr(Q, "fit_scorer", fit)
    for common in (order[0], order[-1]):
        df = spark.createDataFrame([(t,) for t in texts + [common] * 999], "text string").repartition(8)
        Q.fit_quality(df, sample_docs=300)
        x, copies = seen.pop()
        own = copies[(np.abs(x - Q.features(common)) < 1e-6).all(axis=1)].sum()
        assert abs(own / copies.sum() - 1 / 3) < .05 and abs(copies.sum() - 300) < 50 and len(x) > 150


def test_copies_weigh_like_repeated_rows():
    rng = np.random.default_rng(2)
    x, p, n = rng.random((20, 16)).astype(np.float32), rng.random(20), rng.integers(1, 4, 20)
    a, b = Q.fit_scorer(x, p, 4, copies=n), Q.fit_scorer(np.repeat(x, n, axis=0), np.repeat(p, n), 4)
    assert np.allclose(a.weights, b.weights, atol=1e-2) and abs(a.bias - b.bias) < 1e-2
