"""Properties: bounds, invariances, exact counts, distributed positions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from openbound.functions.ordering import mix_key
from openbound.operators import sampling as SM
from openbound.operators import score as S
from openbound.operators.indexing import dense_index
from openbound.operators.prototypes import Prototypes
from openbound.plans import catalog, views
from tests.conftest import SF001, SF01


def test_cosine_bounds_and_predictions_in_range(spark):
    os_, protos = catalog.emb_setup(spark, SF001, margin_vectors=True)
    t = S.class_terms(os_.mapped.select("row_id", "x"), protos)
    r = t.agg(F.min("cos").alias("lo"), F.max("cos").alias("hi")).collect()[0]
    assert -1.0 <= r["lo"] and r["hi"] <= 1.0
    for fn in (S.reject_vector, S.reject_scalar, S.nearest_dot):
        p = fn(os_.mapped.select("row_id", "x"), protos)
        b = p.agg(F.min("pred"), F.max("pred")).collect()[0]
        assert 0 <= b[0] and b[1] <= protos.n_known


def test_cosine_scale_invariant(spark):
    os_, protos = catalog.emb_setup(spark, SF001)
    df = os_.mapped.select("row_id", "x")
    scaled = df.withColumn("x", F.transform("x", lambda v: v * 7.5))
    a = S.reject_scalar(df, protos).orderBy("row_id").collect()
    b = S.reject_scalar(scaled, protos).orderBy("row_id").collect()
    assert [r["pred"] for r in a] == [r["pred"] for r in b]


def test_scalar_margin_monotone(spark):
    os_, protos = catalog.emb_setup(spark, SF001)
    df = os_.mapped.select("row_id", "x")
    n = protos.n_known
    rej = []
    for m in (0.0, 0.1, 0.2, 0.4):
        p = Prototypes(protos.proxy, np.full(protos.n_classes, m), protos.margin_vec)
        rej.append(S.reject_scalar(df, p).filter(F.col("pred") == n).count())
    assert rej == sorted(rej)


def test_balanced_sample_exact(spark):
    e = views.embedding_splits(spark, SF01).select("row_id", "label")
    s = SM.balanced_sample(e, "label", 30, seed=7, salt_buckets=4)
    counts = {r["label"]: r["count"] for r in s.groupBy("label").count().collect()}
    assert set(counts.values()) == {30} and len(counts) == 10
    # identical to a single-window top-k
    w = Window.partitionBy("label").orderBy(mix_key("row_id", 7), "row_id")
    ref = e.withColumn("rn", F.row_number().over(w)).filter("rn <= 30")
    assert sorted(r["row_id"] for r in s.collect()) == sorted(r["row_id"] for r in ref.collect())


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=400), st.integers(min_value=1, max_value=9),
       st.integers(min_value=0, max_value=10**6))
def test_dense_index_equals_row_number(spark, n, buckets, seed):
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumn("k", mix_key("row_id", seed))
    got = dense_index(df, ["k", "row_id"], "pos", n_buckets=buckets)
    ref = df.withColumn("pos", F.row_number().over(Window.orderBy("k", "row_id")) - 1)
    assert sorted((r["row_id"], r["pos"]) for r in got.collect()) == \
        sorted((r["row_id"], r["pos"]) for r in ref.collect())


def test_batches_cover_every_row_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    b = SM.shuffled_batches(df, 150, seed=3)
    sizes = sorted(r["count"] for r in b.groupBy("batch").count().collect())
    assert sum(sizes) == 1000 and sizes == [100] + [150] * 6


def test_dense_index_bucketizer_path(spark):
    # more than 64 bounds -> JVM Bucketizer instead of the comparison tree
    df = spark.range(3000).withColumnRenamed("id", "row_id").withColumn("k", mix_key("row_id", 11))
    got = dense_index(df, ["k", "row_id"], "pos", n_buckets=150)
    ref = df.withColumn("pos", F.row_number().over(Window.orderBy("k", "row_id")) - 1)
    assert sorted((r["row_id"], r["pos"]) for r in got.collect()) == \
        sorted((r["row_id"], r["pos"]) for r in ref.collect())


def test_one_pass_setup_equals_two_pass(spark):
    from openbound.plans.openset import centroid_fixture, prepare, prepare_with_prototypes
    df = views.embedding_splits(spark, SF01)
    for ratio, mode in ((0.5, "first"), (0.25, "random")):
        a_os = prepare(df, ratio, mode, seed=5)
        a = centroid_fixture(a_os, with_margin_vectors=True)
        b_os, b = prepare_with_prototypes(df, ratio, mode, seed=5, margin_vectors=True)
        assert a_os.known.collect() == b_os.known.collect() and a_os.n_known == b_os.n_known
        assert np.allclose(a.proxy, b.proxy) and np.allclose(a.margin_vec, b.margin_vec)


def test_dense_index_null_keys_first(spark):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, k long")
    for nb in (5, 90):
        got = dense_index(df, ["k", "row_id"], "pos", n_buckets=nb)
        ref = df.withColumn("pos", F.row_number().over(Window.orderBy("k", "row_id")) - 1)
        assert sorted((r["row_id"], r["pos"]) for r in got.collect()) == \
            sorted((r["row_id"], r["pos"]) for r in ref.collect())
