"""R3 fit: exact gradients (central differences), Spark sums = numpy sums, loss falls."""

import numpy as np
from pyspark.sql import functions as F
import pytest

from openbound.operators import fit as FT
from openbound.operators import loss as LS
from openbound.operators.prototypes import Prototypes
from openbound.plans import catalog
from tests.conftest import SF01

X = np.array([[1, 0], [.8, .6], [0, 1], [-1, 0], [.6, -.8], [.3, .2]], dtype=float)
Y = np.array([0, 0, 1, 1, 0, 1])
P = np.array([[1, .1], [.1, 1], [1, 1]])
MV = np.array([[1, .9], [.9, 1], [1, .95]])
ALPHA = 4.0


def _loss(proxy, margin, mv, variant):
    p = Prototypes(proxy, margin, mv)
    xh, _ = FT._unit(X)
    return FT.loss_and_grad(FT.partial_sums(xh, Y, p, variant, ALPHA), p, variant, ALPHA)


@pytest.mark.parametrize("variant", list(LS.VARIANTS))
def test_gradient_matches_central_differences(variant):
    margin = np.array([.2, .25, .15])
    loss, d_p, d_m = _loss(P, margin, MV, variant)
    h = 1e-6
    num_p = np.zeros_like(P)
    for i in range(P.shape[0]):
        for j in range(P.shape[1]):
            a, b = P.copy(), P.copy()
            a[i, j] += h
            b[i, j] -= h
            num_p[i, j] = (_loss(a, margin, MV, variant)[0] - _loss(b, margin, MV, variant)[0]) / (2 * h)
    assert np.allclose(d_p, num_p, atol=1e-6)
    kind, _ = LS.VARIANTS[variant]
    if kind == "vector":
        num_m = np.zeros_like(MV)
        for i in range(MV.shape[0]):
            for j in range(MV.shape[1]):
                a, b = MV.copy(), MV.copy()
                a[i, j] += h
                b[i, j] -= h
                num_m[i, j] = (_loss(P, margin, a, variant)[0] - _loss(P, margin, b, variant)[0]) / (2 * h)
    else:
        num_m = np.zeros(3)
        for i in range(3):
            a, b = margin.copy(), margin.copy()
            a[i] += h
            b[i] -= h
            num_m[i] = (_loss(P, a, MV, variant)[0] - _loss(P, b, MV, variant)[0]) / (2 * h)
    assert np.allclose(d_m, num_m, atol=1e-6)


def test_spark_sums_equal_numpy_and_loss(spark):
    rows = [(int(y), [float(v) for v in x]) for x, y in zip(X[:5].tolist() + [[0.0, 0.0]], [0, 0, 1, 1, 0, 1])]
    df = spark.createDataFrame(rows, "y int, x array<double>").repartition(3)
    protos = Prototypes(P, np.full(3, .2), MV)
    sums = FT.aggregate_sums(FT.unit_training_table(df, checkpoint=False), protos, "new", ALPHA)
    loss, _, _ = FT.loss_and_grad(sums, protos, "new", ALPHA)
    assert abs(loss - 6.530565935991) < 1e-9


def test_fit_reduces_loss(spark):
    os_, protos = catalog.emb_setup(spark, SF01, margin_vectors=True)
    train = os_.split("train").select("y", "x")
    res = FT.fit_prototypes(train, protos, "new", alpha=ALPHA, steps=6, lr=1e-3)
    losses = [l for _, l in res.history]
    assert losses[-1] < losses[0]
    # same schedule on a different partitioning: same trajectory
    res2 = FT.fit_prototypes(train.repartition(5), protos, "new", alpha=ALPHA, steps=6, lr=1e-3)
    assert np.allclose([l for _, l in res2.history], losses, rtol=1e-9)


def test_train_and_evaluate_run(spark):
    import tempfile

    from openbound.operators import epochs as EP
    from openbound.plans.training import train_and_evaluate
    from openbound.sources import exports as EX
    os_, protos = catalog.emb_setup(spark, SF01, margin_vectors=True)
    d = tempfile.mkdtemp(prefix="ob-run-")
    res = train_and_evaluate(os_, protos, "new", alpha=ALPHA, epochs=2, batch_size=64, lr=1e-3,
                             run_id="r1", metrics_path=f"{d}/metrics", bundle_path=f"{d}/bundle",
                             dataset="emb", ratio=0.5)
    m = spark.read.parquet(f"{d}/metrics")
    # per epoch: train loss, rate and 4 scores, 5 for valid and test each; the best epoch's 8 scores
    assert m.count() == 2 * (2 + 4 + 2 * 5) + 8
    assert len({(e, b) for e, b, _ in res.step_losses}) == 2 * 3        # 175 train rows / 64 -> 3 batches
    # the driver's best-epoch rule agrees with the Spark M7 operator over the log
    valid = (m.filter("split = 'valid' AND name = 'macro_f1'")
             .select("run_id", "epoch", F.col("value").alias("valid_f1")))
    best = EP.best_epoch(valid, ["run_id"]).collect()[0]
    assert best["best_epoch"] == res.best_epoch
    p, _, cfg = EX.load_bundle(spark, f"{d}/bundle", "emb", 0.5, "r1")
    assert np.allclose(p.proxy, res.best_protos.proxy) and cfg["best_epoch"] == res.best_epoch


def test_evaluate_matches_direct_metrics(spark):
    from openbound.operators import metrics as M
    from openbound.operators import score as S
    from openbound.plans.training import evaluate
    os_, protos = catalog.emb_setup(spark, SF01)
    rows = os_.data.filter(F.col("split").isin("valid", "test")).select("row_id", "split", "y", "x")
    got = {(sp, n): v for sp, n, v in evaluate(rows, protos, "org", ALPHA)}
    pred = S.reject_scalar(rows, protos)
    for r in M.accuracy(pred, by="split").collect():
        assert abs(got[(r["split"], "accuracy")] - r["accuracy"]) < 1e-12
    for r in M.macro_f1(pred, by="split").collect():
        assert abs(got[(r["split"], "macro_f1")] - r["macro_f1"]) < 1e-12
    for r in M.ind_ood_f1(pred, protos.n_known, by="split").collect():
        assert abs(got[(r["split"], "ind_f1")] - r["ind_f1"]) < 1e-12
