"""One rule for rows that cannot be scored, in both engines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from openbound.functions import vectors as V
from openbound.operators import loss as LS
from openbound.operators import score as S
from openbound.operators.prototypes import Prototypes

NAN, INF = float("nan"), float("inf")
ROWS = [(0, [1.0, 0.0]), (1, None), (2, [NAN, 0.0]), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [INF, 1.0]), (6, [0.6, 0.8]),
        (7, [-1.0, 0.0])]


def _setup(spark):
    protos = Prototypes(np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]), np.array([0.2, 0.2, 0.2]),
                        np.array([[0.8, 0.2], [0.1, 0.9], [0.5, 0.4]]))
    return protos, spark.createDataFrame(ROWS, "row_id int, x array<double>")


@pytest.mark.parametrize("fn", ["reject_vector", "reject_scalar", "nearest_dot"])
def test_engines_and_blocks_agree(spark, fn):
    protos, df = _setup(spark)
    ways = [dict(engine="expr"), dict(engine="arrow"), dict(engine="expr", limit=1)]
    got = [{r["row_id"]: r["pred"] for r in getattr(S, fn)(df, protos, **w).collect()} for w in ways]
    assert got[0] == got[1] == got[2]
    assert {got[0][i] for i in (1, 2, 4, 5)} == {2}
    assert got[0][0] != 2 and got[0][7] in (1, 2)
    both = {r["row_id"]: r for r in S.reject_both(df, protos, limit=1).collect()}
    if fn != "nearest_dot":
        col = "pred_vector" if fn == "reject_vector" else "pred_scalar"
        assert {i: r[col] for i, r in both.items()} == got[0]


def test_cosine_of_missing_is_missing(spark):
    protos, df = _setup(spark)
    c = {r["row_id"]: r["c"] for r in df.select("row_id", V.cosine("x", F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()}
    assert c[0] == pytest.approx(1) and c[1] is None and math.isnan(c[2]) and c[3] == 0 and c[4] is None and c[7] == pytest.approx(-1)
    terms = S.class_terms(df, protos).filter("row_id IN (1, 2, 4, 5)").collect()
    assert len(terms) == 12 and all(t["cos"] is None and t["xm"] is None for t in terms)
    a = spark.createDataFrame([(None,), (NAN,), (2.0,)], "c double").select(V.acos_clamped("c").alias("a")).collect()
    assert a[0]["a"] is None and math.isnan(a[1]["a"]) and a[2]["a"] == pytest.approx(math.acos(1 - 1e-7))


@pytest.mark.parametrize("variant", list(LS.VARIANTS))
def test_losses_skip_missing(spark, variant):
    protos, df = _setup(spark)
    rows = df.withColumn("y", F.col("row_id") % 3)
    clean = rows.filter("row_id IN (0, 3, 6, 7)")
    want = LS.proxy_loss(clean, protos, variant, 4.0).first()["loss"]
    for engine in S.ENGINES:
        assert LS.proxy_loss(rows, protos, variant, 4.0, engine=engine).first()["loss"] == pytest.approx(want, rel=1e-12)
        multi = {r["variant"]: r["loss"] for r in LS.multi_variant_loss(rows, protos, alpha=4.0, engine=engine).collect()}
        assert multi[variant] == pytest.approx(want, rel=1e-12)
