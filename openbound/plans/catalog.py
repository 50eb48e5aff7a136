"""Registered queries: one per operator of the survey inventory.

Each query takes ``(spark, sf_dir)``, reads the driver tables through
``views``, and returns a DataFrame whose computed columns are aliased to the
names used by the SQL oracles in ``oracle.py``.  Doubles are rounded to 6
places on both sides.

Shared setting (SURVEY 7.2): embeddings split by ``vec_id % 10``; vocabulary
in first-seen order; ratio 0.5 with the first-n known list (5 of 10 labels,
class ids 0..4, out-of-domain id 5); prototypes are training centroids with
scalar margin 0.2 and, for the vector-margin operators, margin vector = the
midpoint of the proxy and the class's first training row.  The setting comes
from a single aggregation over the table (``prepare_with_prototypes``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import score as S
from . import views
from .openset import OpenSet, prepare, prepare_with_prototypes

RATIO = 0.5
SEED = 42
ROUND = 6

def _r(c, name: str):
    return F.round(c, ROUND).alias(name)


def emb_setup(spark: SparkSession, sf: str, margin_vectors: bool = False):
    """(OpenSet, Prototypes) of the shared embedding setting (one aggregation)."""
    return prepare_with_prototypes(views.embedding_splits(spark, sf), RATIO, margin_vectors=margin_vectors)


def _eval_rows(os_: OpenSet) -> DataFrame:
    """Rows that the reference scores: all splits (training rows without the out-of-domain ones)."""
    return os_.data


def _scalar_predictions(spark, sf) -> tuple[OpenSet, DataFrame]:
    os_, protos = emb_setup(spark, sf)
    return os_, S.reject_scalar(_eval_rows(os_), protos)


# ------------------------------------------------------------ vectors ------

def q_v1_l2_norm(spark, sf):
    e = views.embedding_splits(spark, sf)
    return e.select("row_id", F.posexplode(V.l2_normalize("x")).alias("dim", "v")).select(
        "row_id", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def _terms(spark, sf, clamp=True, margin_vectors=False):
    os_, protos = emb_setup(spark, sf, margin_vectors)
    return S.class_terms(os_.mapped.select("row_id", "x"), protos, clamp=clamp)


def q_v2_cosine(spark, sf):
    return _terms(spark, sf).select("row_id", "cls", _r(F.col("cos"), "cos"))


def q_v3_cosine_unclamped(spark, sf):
    return _terms(spark, sf, clamp=False).select("row_id", "cls", _r(F.col("cos"), "cos"))


def q_v4_dot(spark, sf):
    os_, protos = emb_setup(spark, sf)
    t = S.dot_terms(os_.mapped.select("row_id", "x"), protos)
    return t.select("row_id", "cls", _r(F.col("dot"), "dot"))


def q_v5_acos_clamped(spark, sf):
    return _terms(spark, sf).select("row_id", "cls", _r(V.acos_clamped("cos"), "angle"))


def q_v6_angle(spark, sf):
    return _terms(spark, sf, clamp=False).select("row_id", "cls", _r(V.angle("cos"), "angle"))


def q_v7_sin(spark, sf):
    return _terms(spark, sf).select("row_id", "cls", _r(V.sin_from_cos("cos"), "sin"))


def q_v8_radius(spark, sf):
    _, protos = emb_setup(spark, sf, margin_vectors=True)
    pf = protos.to_frame(spark)
    return pf.select("cls", _r(V.radius("margin_vec", "proxy"), "radius"))


# ------------------------------------------------------------ scoring ------

def q_t1_nearest_dot(spark, sf):
    os_, protos = emb_setup(spark, sf)
    return S.nearest_dot(os_.mapped.select("row_id", "x"), protos).select("row_id", "pred")


def q_t2_reject_vector(spark, sf):
    os_, protos = emb_setup(spark, sf, margin_vectors=True)
    return S.reject_vector(_eval_rows(os_).select("row_id", "x"), protos).select("row_id", "pred")


def q_t3_reject_scalar(spark, sf):
    _, pred = _scalar_predictions(spark, sf)
    return pred.select("row_id", "pred")


def q_t2_t3_missing_vectors(spark, sf):
    """T2 and T3 over documents joined to vectors by id: half of the documents have none, and
    every 7th vector gets a NaN component; such rows are out-of-domain."""
    _, protos = emb_setup(spark, sf, margin_vectors=True)
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    e = views.embedding_splits(spark, sf).select("row_id", "x")
    x = F.when(F.col("row_id") % 7 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice("x", 2, 1 << 20))).otherwise(F.col("x"))
    rows = docs.join(e.withColumn("x", x), "row_id", "left")
    return S.reject_both(rows, protos).select("row_id", "pred_vector", "pred_scalar")


def q_t4_argmax_accuracy(spark, sf):
    os_, protos = emb_setup(spark, sf)
    lg = S.cosine_logits(os_.data.select("row_id", "split", "y", "x"), protos)
    lg = lg.withColumn("pred", S.argmax_logits(F.col("logits")))
    return M.accuracy(lg, by="split").select("split", _r(F.col("accuracy"), "accuracy"))


# ------------------------------------------------------------- labels ------

def q_s5_vocab_first_seen(spark, sf):
    return L.vocab_first_seen(views.document_splits(spark, sf))


def q_p4_known_count(spark, sf):
    sizes = (views.embedding_splits(spark, sf).select(F.lit("embeddings").alias("source_table"), "label")
             .unionByName(views.document_splits(spark, sf)
                          .select(F.lit("documents").alias("source_table"), "label"))
             .groupBy("source_table").agg(F.countDistinct("label").cast("int").alias("vocab_size")))
    grid = sizes.select("source_table", "vocab_size",
                        F.explode(F.array(*[F.lit(r) for r in (0.25, 0.5, 0.75)])).alias("ratio"))
    return grid.select("source_table", "ratio", "vocab_size",
                       L.known_count_col(F.col("vocab_size"), F.col("ratio")).alias("n_known"))


def q_p5_known_first(spark, sf):
    return prepare(views.document_splits(spark, sf), RATIO).known


def q_p6_known_random(spark, sf):
    return prepare(views.document_splits(spark, sf), RATIO, mode="random", seed=SEED).known


def q_p7_label_map(spark, sf):
    return prepare(views.document_splits(spark, sf), RATIO).mapped.select("row_id", "split", "label", "y")


def q_p8_drop_train_ood(spark, sf):
    return prepare(views.document_splits(spark, sf), RATIO).data.select("row_id", "split", "y")


def q_j4_known_semi(spark, sf):
    os_ = prepare(views.document_splits(spark, sf), RATIO)
    return L.known_semi(os_.mapped.select("row_id", "label"), os_.known, os_.n_known)


def q_j4_unknown_anti(spark, sf):
    os_ = prepare(views.document_splits(spark, sf), RATIO)
    return L.known_semi(os_.mapped.select("row_id", "label"), os_.known, os_.n_known, anti=True)


def q_u3_label_space(spark, sf):
    os_ = prepare(views.document_splits(spark, sf), RATIO)
    return L.label_space(os_.known, os_.n_known)


def _emb_masks(spark, sf, shared: bool):
    os_ = prepare(views.embedding_splits(spark, sf), RATIO)
    c = os_.n_classes
    t = os_.data.select("row_id", "y", F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("cls"))
    return t, os_


def q_p10_one_hot(spark, sf):
    os_ = prepare(views.embedding_splits(spark, sf), RATIO)
    return os_.data.select("row_id", F.posexplode(L.one_hot("y", os_.n_classes)).alias("cls", "hot"))


def q_p11_shared_positive(spark, sf):
    t, os_ = _emb_masks(spark, sf, True)
    return t.select("row_id", "cls", L.positive_mask(F.col("y"), F.col("cls"), os_.n_known, True)
                    .cast("int").alias("pos"))


def q_p12_negative(spark, sf):
    t, os_ = _emb_masks(spark, sf, True)
    return t.select("row_id", "cls", L.negative_mask(F.col("y"), F.col("cls"), os_.n_known, True)
                    .cast("int").alias("neg"))


def q_p13_block_one_hot(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id")
    lab = views.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(lab, "doc_id", "left")  # J3 misses -> all-zero blocks
    return j.select("doc_id", F.posexplode(L.block_one_hot(["quality", "toxic"], [2, 2]))
                    .alias("col", "v"))


def q_p14_class_filter(spark, sf):
    e = views.embedding_splits(spark, sf)
    return e.filter(F.col("label").isin("0", "1", "2", "3", "4", "5")).select("row_id", "label")


def q_p15_distinct_targets(spark, sf):
    os_ = prepare(views.embedding_splits(spark, sf), RATIO)
    return os_.data.select("y").distinct()


def q_p16_rename(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", "label")
    return e.withColumnRenamed("label", "class").withColumnRenamed("vec_id", "row_id")


# ------------------------------------------------------------ metrics ------

def q_m1_accuracy(spark, sf):
    _, pred = _scalar_predictions(spark, sf)
    return M.accuracy(pred, by="split").select("split", _r(F.col("accuracy"), "accuracy"))


def q_m2_confusion(spark, sf):
    os_, protos = emb_setup(spark, sf)
    pred = S.reject_scalar(_eval_rows(os_).select("split", "y", "x"), protos)
    return M.confusion_matrix(pred, os_.n_classes, by="split")


def q_m3_report(spark, sf):
    _, pred = _scalar_predictions(spark, sf)
    r = M.class_report(pred, by="split")
    return r.select("split", "cls", _r(F.col("precision"), "precision"), _r(F.col("recall"), "recall"),
                    _r(F.col("f1"), "f1"), "support")


def q_m4_macro_f1(spark, sf):
    _, pred = _scalar_predictions(spark, sf)
    return M.macro_f1(pred, by="split").select("split", _r(F.col("macro_f1"), "macro_f1"))


def q_m5_ind_ood_f1(spark, sf):
    os_, pred = _scalar_predictions(spark, sf)
    r = M.ind_ood_f1(pred, os_.n_known, by="split")
    return r.select("split", _r(F.col("ind_f1"), "ind_f1"), _r(F.col("ood_f1"), "ood_f1"))


def q_m5_ind_ood_positional(spark, sf):
    os_, pred = _scalar_predictions(spark, sf)
    r = M.ind_ood_f1(pred, os_.n_known, by="split", positional=True)
    return r.select("split", _r(F.col("ind_f1"), "ind_f1"), _r(F.col("ood_f1"), "ood_f1"))


def q_m10_value_counts(spark, sf):
    return M.value_counts(views.document_splits(spark, sf), "label")


def q_m12_weighted(spark, sf):
    _, pred = _scalar_predictions(spark, sf)
    r = M.weighted_scores(pred, by="split")
    return r.select("split", *[_r(F.col(c), c) for c in
                               ("weighted_precision", "weighted_recall", "weighted_f1")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

FLAGSHIP = "m2_confusion"
