"""Golden micro-tables (FIXTURES.md section 3), computed independently in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from openbound.functions import text as TX
from openbound.functions import vectors as V
from openbound.operators import epochs as EP
from openbound.operators import labels as L
from openbound.operators import loss as LS
from openbound.operators import metrics as M
from openbound.operators import score as S
from openbound.operators.prototypes import Prototypes

X = [[1, 0], [.8, .6], [0, 1], [-1, 0], [.6, -.8], [0, 0]]
Y = [0, 0, 1, 1, 0, 1]
P = np.array([[1, .1], [.1, 1], [1, 1]])
MV = np.array([[1, .9], [.9, 1], [1, .95]])


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, [float(v) for v in x], y) for i, (x, y) in enumerate(zip(X, Y))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, y int")


def _by_id(df, col):
    return [r[col] for r in df.orderBy("row_id").collect()]


def test_cosine_matrix(spark, samples):
    protos = Prototypes(P, np.full(3, .2), MV)
    t = S.class_terms(samples, protos).orderBy("row_id", "cls").collect()
    got = np.array([r["cos"] for r in t]).reshape(6, 3)
    want = np.array([[.995037, .099504, .707107], [.855732, .676625, .989949],
                     [.099504, .995037, .707107], [-.995037, -.099504, -.707107],
                     [.517419, -.736328, -.141421], [0, 0, 0]])
    assert np.allclose(got, want, atol=1e-6)


def test_radius(spark):
    protos = Prototypes(P, np.full(3, .2), MV)
    assert np.allclose(protos.radius(), [.806170, .806170, .999671], atol=1e-6)
    pf = protos.to_frame(spark).select("cls", V.radius("margin_vec", "proxy").alias("r")).orderBy("cls")
    assert np.allclose([r["r"] for r in pf.collect()], [.806170, .806170, .999671], atol=1e-6)


def test_predictions(spark, samples):
    protos = Prototypes(P, np.full(3, .2), MV)
    assert _by_id(S.reject_vector(samples, protos), "pred") == [0, 0, 1, 2, 2, 2]
    assert _by_id(S.reject_scalar(samples, protos), "pred") == [0, 2, 1, 2, 0, 2]
    assert _by_id(S.nearest_dot(samples, protos), "pred") == [0, 2, 1, 1, 0, 0]
    init = Prototypes(P)  # margin vector = proxy: radius 1, everything rejected
    assert _by_id(S.reject_vector(samples, init), "pred") == [2] * 6


def test_blocked_scoring_matches_broadcast(spark, samples):
    protos = Prototypes(P, np.full(3, .2), MV)
    a = _by_id(S.reject_vector(samples, protos), "pred")
    b = _by_id(S.reject_vector(samples, protos, limit=40), "pred")
    c = _by_id(S.reject_scalar(samples, protos, limit=40), "pred")
    assert a == b and c == [0, 2, 1, 2, 0, 2]


GOLD = {
    "new": ([3.24378, 62.63494, 1080.537448], [15.575961, 65.618906, 0], 3, 6.530565935991),
    "wo_shared": ([3.24378, 62.63494, 0], [15.575961, 65.618906, 88.722457], 2, 6.633862847031),
    "org": ([0.395092, 5.580653, 0], [5.580653, 36.762006, 195.650559], 2, 4.707502342117),
    "wo_margin": ([0.395092, 5.580653, 44.103013], [5.580653, 36.762006, 0], 3, 3.847160222552),
}


@pytest.mark.parametrize("variant", list(GOLD))
def test_losses(spark, samples, variant):
    protos = Prototypes(P, np.full(3, .2), MV)
    sp, sn, nv, loss = GOLD[variant]
    sums = LS.class_sums(LS.loss_terms(samples, protos, variant, 4.0)).orderBy("cls").collect()
    assert np.allclose([r["s_pos"] for r in sums], sp, rtol=1e-6, atol=1e-6)
    assert np.allclose([r["s_neg"] for r in sums], sn, rtol=1e-6, atol=1e-6)
    out = LS.proxy_loss(samples, protos, variant, 4.0).collect()[0]
    assert out["n_valid"] == nv
    assert abs(out["loss"] - loss) < 1e-9


def test_loss_repartition_invariant(spark, samples):
    protos = Prototypes(P, np.full(3, .2), MV)
    a = LS.proxy_loss(samples, protos, "new", 4.0).collect()[0]["loss"]
    b = LS.proxy_loss(samples.repartition(5), protos, "new", 4.0).collect()[0]["loss"]
    assert abs(a - b) < 1e-9


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [0, 2, 1, 1, 2, 0])), "y int, pred int")
    rep = {r["cls"]: r["f1"] for r in M.class_report(df).collect()}
    assert np.allclose([rep[0], rep[1], rep[2]], [.5, 1, .5])
    assert abs(M.accuracy(df).collect()[0]["accuracy"] - 4 / 6) < 1e-12
    assert abs(M.macro_f1(df).collect()[0]["macro_f1"] - 4 / 6) < 1e-12
    r = M.ind_ood_f1(df, 2).collect()[0]
    assert abs(r["ind_f1"] - .75) < 1e-12 and abs(r["ood_f1"] - .5) < 1e-12
    r = M.ind_ood_f1(df, 2, positional=True).collect()[0]
    assert abs(r["ind_f1"] - .75) < 1e-12 and abs(r["ood_f1"] - .5) < 1e-12
    cm = M.confusion_matrix(df, 3).collect()
    assert len(cm) == 9 and sum(r["n"] for r in cm) == 6


def test_positional_quirk(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], [0, 1, 1, 1])), "y int, pred int")
    by_id = M.ind_ood_f1(df, 2).collect()[0]
    pos = M.ind_ood_f1(df, 2, positional=True).collect()[0]
    assert by_id["ood_f1"] is None           # class 2 absent: no out-of-domain F1
    assert pos["ood_f1"] is not None         # the reference's rule calls class 1 out-of-domain


def test_precision_zero_division(spark):
    df = spark.createDataFrame([(0, 1), (1, 1)], "y int, pred int")
    rep = {r["cls"]: r for r in M.class_report(df).collect()}
    assert rep[0]["precision"] == 1.0 and rep[0]["f1"] == 0.0


def test_best_epoch_and_flags(spark):
    rows = [(1, e, v) for e, v in enumerate([.5, .7, .7, .6, .7])]
    df = spark.createDataFrame(rows, "run_id int, epoch int, valid_f1 double")
    imp = [r["improved"] for r in EP.improved_flags(df, ["run_id"], n_buckets=2).orderBy("epoch").collect()]
    assert imp == [True, True, True, False, True]
    gate = [r["export"] for r in EP.export_gate(df, ["run_id"], n_buckets=3).orderBy("epoch").collect()]
    assert gate == [True, True, True, True, False]
    best = EP.best_epoch(df, ["run_id"]).collect()[0]
    assert best["best_epoch"] == 4 and best["best_valid_f1"] == .7
    rm = [r["running_mean"] for r in EP.running_mean(df, ["run_id"], "epoch", "valid_f1", n_buckets=2)
          .orderBy("epoch").collect()]
    assert np.allclose(rm, np.cumsum([.5, .7, .7, .6, .7]) / np.arange(1, 6))


@pytest.mark.parametrize("size,counts", [(77, (19, 38, 58)), (150, (38, 75, 112)), (20, (5, 10, 15)),
                                         (10, (2, 5, 8))])
def test_half_even(spark, size, counts):
    assert tuple(L.known_count(size, r) for r in (.25, .5, .75)) == counts
    df = spark.createDataFrame([(size, r) for r in (.25, .5, .75)], "n int, r double")
    got = [r["k"] for r in df.select(L.known_count_col(F.col("n"), F.col("r")).alias("k")).collect()]
    assert tuple(got) == counts


def test_normalize(spark):
    s = "안녕, hi\tthere — 3.5!?ㅋㅏ"
    df = spark.createDataFrame([(s,), ("a &amp; b&lt;c",)], "t string")
    out = [r["t"] for r in TX.normalize_rows(df, "t").collect()]
    assert "안녕 hi there 3.5!?ㅋ " in out
    assert "a b c" in out
    assert [r[0] for r in df.select(TX.html_unescape("t")).collect()][1] == "a & b<c"
