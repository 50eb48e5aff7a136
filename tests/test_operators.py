"""Operator edge cases: encoder hook, pooling mask, k-NN blocks, skewed scans, masks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from openbound.operators import embed as EM
from openbound.operators import encode as EN
from openbound.operators import epochs as EP
from openbound.operators import labels as L
from openbound.operators import neighbors as NB
from openbound.operators.prototypes import Prototypes, random_prototypes
from openbound.plans import catalog
from tests.conftest import SF01


def test_embed_with_user_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, None)], "row_id long, text string")

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = {r["row_id"]: r["x"] for r in EM.embed_with(df, "text", load, 2).collect()}
    assert out == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0]}


def test_mean_pool_mask(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    r = df.select(EM.mean_pool("v").alias("a"), EM.mean_pool("v", "m").alias("b")).collect()[0]
    assert np.allclose(r["a"], [13 / 3, 5.0]) and np.allclose(r["b"], [2.0, 3.0])


def test_encode_unknown_padding_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a z"), (3, "!!!")], "row_id long, text string")
    tk = EN.tokenize(df, "text")
    vocab = spark.createDataFrame([(2, "a", 2), (3, "b", 1)], "token_id int, token string, count long")
    enc = {r["row_id"]: r for r in EN.encode(tk, vocab, 2, max_len=4).collect()}
    assert enc[1]["input_ids"] == [2, 3, 1, 0] and enc[1]["attention_mask"] == [1, 1, 1, 0]
    assert enc[2]["input_ids"] == [2, 1, 0, 0]
    assert enc[3]["input_ids"] == [1, 0, 0, 0]   # '!!!' is a token (kept class), not in the vocabulary


def test_vocab_ties_and_ids(spark):
    df = spark.createDataFrame([(1, "b a"), (2, "a c"), (3, "c b")], "row_id long, text string")
    v = EN.build_vocab(EN.tokenize(df, "text"), 2).orderBy("token_id").collect()
    assert [(r["token_id"], r["token"]) for r in v] == [(2, "a"), (3, "b")]


def test_knn_blocks_equal_single_block(spark):
    os_, protos = catalog.emb_setup(spark, SF01)
    train = os_.split("train").select("row_id", "y", "x")
    q = os_.split("test").select("row_id", "x")
    a = {r["row_id"]: r["pred"] for r in NB.knn_vote(q, train, protos, k=5).collect()}
    b = {r["row_id"]: r["pred"] for r in NB.knn_vote(q, train, protos, k=5, block_rows=37,
                                                       broadcast_limit=0).collect()}
    c = {r["row_id"]: r["pred"] for r in NB.knn_vote(q, train, protos, k=5, broadcast_limit=0).collect()}
    assert a == b == c and len(a) == q.count()


def test_class_average_is_exact_on_zero_dots(spark):
    # orthogonal rows drop out of a class's count
    train = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.0]), (1, 0, [0.0, 1.0, 0.0]), (2, 0, [0.0, 1.0, 0.0]), (3, 1, [0.6, 0.8, 0.0]),
                                   (4, 1, [0.0, 0.0, 0.0])], "row_id int, y int, x array<double>")
    protos = Prototypes(np.array([[0.0, 0.0, 0.0], [0.3, 0.0, 0.0], [0.0, 0.0, 0.0]]))
    nan = float("nan")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.9, 0.1]), (2, None), (3, [nan, 1.0, 0.0]), (4, [0.0, 0.0, 1.0])],
                              "row_id int, x array<double>")
    want = {0: 0, 1: 0, 2: 2, 3: 2, 4: 0}
    for how in ({}, {"broadcast_limit": 0, "block_rows": 2}):
        assert {r["row_id"]: r["pred"] for r in NB.class_average_predict(q, train, protos, **how).collect()} == want
        got = {r["row_id"]: r["pred"] for r in NB.knn_vote(q, train, protos, k=2, **how).collect()}
        assert got[2] == got[3] == 2 and got[0] in (0, 1)


def test_segmented_scan_hot_run(spark):
    # one run holds 2/3 of the rows; tiny buckets force many cells and prefixes
    rows = [(1, e, float(e % 7)) for e in range(300)] + [(r, e, float(e % 5)) for r in (2, 3) for e in range(75)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, valid_f1 double")
    got = EP.running_mean(df, ["run_id"], "epoch", "valid_f1", n_buckets=9)
    w = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.avg("valid_f1").over(w))
    j = got.join(ref, ["run_id", "epoch"]).select("running_mean", "ref").collect()
    assert len(j) == 450 and all(abs(r[0] - r[1]) < 1e-9 for r in j)
    gate = EP.export_gate(df, ["run_id"], n_buckets=9)
    wl = Window.partitionBy("run_id").orderBy("epoch")
    wb = wl.rowsBetween(Window.unboundedPreceding, -1)
    imp = df.withColumn("imp", F.col("valid_f1") >= F.greatest(F.coalesce(F.max("valid_f1").over(wb), F.lit(0.0)),
                                                              F.lit(0.0)))
    ref = imp.withColumn("ref", F.coalesce(F.lag("imp").over(wl), F.lit(True)))
    j = gate.join(ref, ["run_id", "epoch"]).select("export", "ref").collect()
    assert len(j) == 450 and all(r[0] == r[1] for r in j)


def test_check_known_rejects_oos(spark):
    with pytest.raises(ValueError):
        L.check_known(spark.createDataFrame([(0, "oos")], "cls int, label string"))


def test_random_prototypes_std():
    p = random_prototypes(150, 768, seed=1)
    assert p.proxy.shape == (150, 768) and abs(p.proxy.std() - np.sqrt(2 / 150)) < 0.002


@pytest.mark.parametrize("fn", ["reject_vector", "reject_scalar", "nearest_dot"])
def test_arrow_engine_equals_expressions(spark, fn):
    from openbound.operators import score as S
    os_, protos = catalog.emb_setup(spark, SF01, margin_vectors=True)
    rows = os_.mapped.select("row_id", "x")
    a = {r["row_id"]: r["pred"] for r in getattr(S, fn)(rows, protos, engine="expr").collect()}
    b = {r["row_id"]: r["pred"] for r in getattr(S, fn)(rows, protos, engine="arrow").collect()}
    assert a == b and len(a) == 500


def test_engine_is_the_callers_choice(spark):
    from openbound.operators import score as S
    rng = np.random.default_rng(3)
    protos = Prototypes(rng.normal(size=(60, 300)), np.full(60, 0.05), rng.normal(size=(60, 300)))
    df = spark.createDataFrame([(i, rng.normal(size=300).tolist()) for i in range(200)],
                               "row_id long, x array<double>")
    plain = S.reject_scalar(df, protos)
    assert "MapInPandas" not in plain._jdf.queryExecution().executedPlan().toString()
    auto = S.reject_scalar(df, protos, engine="arrow")
    assert "MapInPandas" in auto._jdf.queryExecution().executedPlan().toString()
    a = {r["row_id"]: r["pred"] for r in auto.collect()}
    b = {r["row_id"]: r["pred"] for r in S.reject_scalar(df, protos, engine="expr").collect()}
    assert a == b


def test_arrow_loss_equals_expressions(spark):
    from openbound.operators import loss as LS
    from openbound.operators import sampling as SM
    os_, protos = catalog.emb_setup(spark, SF01, margin_vectors=True)
    tr = SM.shuffled_batches(os_.split("train").select("row_id", "y", "x"), 32, seed=0)
    a = {(r["variant"], r["batch"]): r["loss"] for r in
         LS.multi_variant_loss(tr, protos, alpha=4.0, by="batch", engine="expr").collect()}
    b = {(r["variant"], r["batch"]): r["loss"] for r in
         LS.multi_variant_loss(tr, protos, alpha=4.0, by="batch", engine="arrow").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    for v in LS.VARIANTS:
        x = LS.proxy_loss(tr, protos, v, 4.0, engine="expr").collect()[0]["loss"]
        y = LS.proxy_loss(tr, protos, v, 4.0, engine="arrow").collect()[0]["loss"]
        assert abs(x - y) < 1e-9


@pytest.mark.parametrize("dim", [16, 130])
def test_text_embedding_covers_whole_texts(spark, dim):
    import hashlib
    texts = {0: "a b c", 1: "word " * 500 + "last", 2: "", 3: None, 4: "a a b"}
    df = EM_tokenize(spark, texts)
    got = {r["row_id"]: r["x"] for r in EM.embed_text(df, "row_id", dim=dim).collect()}

    def signs(t):
        return [1 - 2 * (int(hashlib.md5(f"{t}:{j // 60}".encode()).hexdigest()[:15], 16) >> j % 60 & 1) for j in range(dim)]
    for i, t in texts.items():
        words = (t or "").split()
        want = np.mean([signs(w) for w in words], axis=0) if words else np.zeros(dim)
        assert np.allclose(got[i], want, atol=1e-12)


def EM_tokenize(spark, texts):
    from openbound.operators import encode as EN
    return EN.tokenize(spark.createDataFrame(list(texts.items()), "row_id long, text string"), "text")


def test_label_text_ids_never_move(spark):
    texts = [(0, "zero"), (2, "two"), (3, "three"), (2, "more")]
    df = spark.createDataFrame(texts, "cls int, text string")
    with pytest.raises(ValueError, match="without a text: .1."):
        EM.label_text_prototypes(df, 4, 8)
    full = df.unionByName(spark.createDataFrame([(1, "one")], "cls int, text string"))
    p = EM.label_text_prototypes(full, 4, 8)
    assert np.allclose(p.proxy[1], EM.label_text_prototypes(spark.createDataFrame([(0, "one")], "cls int, text string"), 1, 8).proxy[0])
    with pytest.raises(ValueError, match="outside"):
        EM.label_text_prototypes(full, 3, 8)


def test_random_vectors_are_normal_and_free_of_partitions(spark):
    from openbound.operators.prototypes import random_vectors
    one, many = ([tuple(r) for r in random_vectors(spark.range(200).withColumnRenamed("id", "cls").repartition(n), 50, 3).orderBy("cls", "dim").collect()]
                 for n in (1, 9))
    v = np.array([r[2] for r in one]) / np.sqrt(2.0 / 200)
    assert one == many and len(v) == 10000
    assert abs(v.mean()) < 0.04 and abs(v.std() - 1) < 0.03 and abs((np.abs(v) < 1).mean() - 0.6827) < 0.02
    assert random_vectors(spark.range(0).withColumnRenamed("id", "cls"), 4).collect() == []
