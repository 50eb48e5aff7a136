"""Driver contract and remaining SURVEY §5 edge cases."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from openbound.operators import labels as L
from openbound.operators import metrics as M

# fixed values: inventory prefixes of SURVEY §2 (plus the end-to-end plan)
PREFIX = re.compile(r"^(s\d+b?|p\d+|j\d+|v\d+|t\d+|l\d+|m\d+|b\d+|u\d+|r\d+|e2e|op\d+)_[a-z0-9_]+$|^pipeline$")


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(PREFIX.match(k) for k in q), [k for k in q if not PREFIX.match(k)]
    core = {k for k in q if not k.startswith("op") and k != "pipeline"}
    assert len(core) >= 81 and len(core - set(o)) <= 4


def test_labels_outside_vocabulary_map_to_oos(spark):
    known = spark.createDataFrame([(0, "a"), (1, "b")], "cls int, label string")
    df = spark.createDataFrame([(0, "a"), (1, "zz"), (2, "oos"), (3, "b")], "row_id long, label string")
    got = {r["row_id"]: r["y"] for r in L.map_labels(df, known, 2).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 1}


def test_empty_split_metrics(spark):
    df = spark.createDataFrame([], "split string, y int, pred int")
    assert M.accuracy(df, by="split").count() == 0
    assert M.macro_f1(df, by="split").count() == 0
    assert M.confusion_matrix(df, 3, by="split").count() == 0
    assert M.confusion_matrix(df.drop("split"), 3).filter(F.col("n") > 0).count() == 0


def test_vocabulary_comes_from_training_rows_or_a_table(spark):
    import pytest
    from openbound.plans.openset import prepare
    rows = [(0, "train", "b"), (1, "train", "a"), (2, "test", "zz"), (3, "test", "oos"), (4, "valid", "a"), (5, "train", "b")]
    df = spark.createDataFrame(rows, "row_id long, split string, label string")
    os_ = prepare(df, 1.0)
    assert [(r["cls"], r["label"]) for r in os_.known.orderBy("cls").collect()] == [(0, "b"), (1, "a")]
    assert {r["row_id"]: r["y"] for r in os_.mapped.collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 0}
    vocab = spark.createDataFrame([(0, "a"), (1, "zz"), (2, "b"), (3, "never")], "pos int, label string")
    os_ = prepare(df, 0.5, vocab=vocab)
    assert [(r["cls"], r["label"]) for r in os_.known.orderBy("cls").collect()] == [(0, "a"), (1, "zz")] and os_.n_known == 2
    assert {r["row_id"] for r in os_.data.collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError, match="oos"):
        prepare(df, 1.0, vocab=spark.createDataFrame([(0, "oos")], "pos int, label string"))
