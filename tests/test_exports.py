"""Sinks: parquet export with pruning, TSV pair round trip, bundles, metrics log."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from openbound.operators.prototypes import Prototypes
from openbound.sources import exports as EX
from openbound.plans import catalog
from tests.conftest import SF001


def test_parquet_export_partitions(spark):
    d = tempfile.mkdtemp(prefix="ob-exp-")
    os_, _ = catalog.emb_setup(spark, SF001)
    EX.export_embeddings(os_.split("valid"), d, "r1", 0, "valid")
    EX.export_embeddings(os_.split("test"), d, "r1", 0, "test")
    v = EX.read_embeddings(spark, d, "r1", 0, "valid")
    t = EX.read_embeddings(spark, d, "r1", 0, "test")
    assert v.count() == os_.split("valid").count() and t.count() == os_.split("test").count()
    assert "PartitionFilters" in v._jdf.queryExecution().executedPlan().toString()


def test_tsv_pair_round_trip(spark):
    d = tempfile.mkdtemp(prefix="ob-tsv-")
    os_, _ = catalog.emb_setup(spark, SF001)
    src = os_.split("test").select("row_id", "x", "y").repartition(3)
    EX.write_tsv_pair(src, f"{d}/x", f"{d}/y")
    back = EX.read_tsv_pair(spark, f"{d}/x", f"{d}/y").orderBy("row_id").collect()
    want = src.orderBy("row_id").collect()
    assert [r["target"] for r in back] == [r["y"] for r in want]
    assert all(np.allclose(a["x"], b["x"]) for a, b in zip(back, want))


def test_bundle_round_trip(spark):
    d = tempfile.mkdtemp(prefix="ob-bundle-")
    protos = Prototypes(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([.2, .3]))
    known = spark.createDataFrame([(0, "a")], "cls int, label string")
    EX.save_bundle(protos, known, {"alpha": 4, "variant": "new"}, d, "emb", 0.5, "run1")
    EX.save_bundle(protos.copy(), known, {"alpha": 8}, d, "emb", 0.75, "run1")
    p, k, cfg = EX.load_bundle(spark, d, "emb", 0.5, "run1")
    assert np.allclose(p.proxy, protos.proxy) and np.allclose(p.margin, [.2, .3])
    assert cfg == {"alpha": 4, "variant": "new"} and k.count() == 1


def test_metrics_append(spark):
    d = tempfile.mkdtemp(prefix="ob-met-")
    rows = [("r", 0, "valid", "f1", .5), ("r", 0, "test", "f1", .4)]
    EX.append_metrics(spark.createDataFrame(rows, EX.METRICS_SCHEMA), d)
    EX.append_metrics(spark.createDataFrame([("r", 1, "valid", "f1", .6)], EX.METRICS_SCHEMA), d)
    log = spark.read.parquet(d)
    assert log.count() == 3
    wide = EX.metrics_wide(log).orderBy("epoch").collect()
    assert wide[0]["valid/f1"] == .5 and wide[1]["valid/f1"] == .6
