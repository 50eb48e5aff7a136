"""Registered queries: losses, batching and sampling, epoch windows, text, positional zip.

Loss setting: training split of the shared embedding setting, centroid
proxies with margin vectors = midpoint of proxy and first training row, scalar
margin 0.2, alpha = 4 (64 spans 50 orders of magnitude and makes 6-digit
comparison meaningless).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import epochs as EP
from ..operators import labels as L
from ..operators import loss as LS
from ..operators import sampling as SM
from ..sources.lines import zip_by_position
from . import views
from .catalog import _r, emb_setup

ALPHA = 4.0
BATCH = 32
SEED = 42


def _train(spark, sf):
    os_, protos = emb_setup(spark, sf, margin_vectors=True)
    return os_, protos, os_.split("train").select("row_id", "y", "x")


def q_l1_inside_mask(spark, sf):
    _, protos, tr = _train(spark, sf)
    t = LS.loss_terms(tr, protos, "new", ALPHA)
    return t.select("row_id", "cls", F.col("inside").cast("int").alias("inside"))


def q_l2_vector_terms(spark, sf):
    _, protos, tr = _train(spark, sf)
    t = LS.loss_terms(tr, protos, "new", ALPHA)
    return t.select("row_id", "cls", _r(F.col("pos_cos"), "pos_cos"), _r(F.col("neg_cos"), "neg_cos"))


def q_l3_vector_exp(spark, sf):
    _, protos, tr = _train(spark, sf)
    t = LS.loss_terms(tr, protos, "new", ALPHA)
    return t.select("row_id", "cls", _r(F.col("pos_exp"), "pos_exp"), _r(F.col("neg_exp"), "neg_exp"))


def q_l4_scalar_exp(spark, sf):
    _, protos, tr = _train(spark, sf)
    t = LS.loss_terms(tr, protos, "org", ALPHA)
    return t.select("row_id", "cls", _r(F.col("pos_exp"), "pos_exp"), _r(F.col("neg_exp"), "neg_exp"))


def _class_sums(variant):
    def q(spark, sf):
        _, protos, tr = _train(spark, sf)
        s = LS.class_sums(LS.loss_terms(tr, protos, variant, ALPHA))
        return s.select("cls", _r(F.col("s_pos"), "s_pos"), _r(F.col("s_neg"), "s_neg"), "has_pos")
    return q


def _loss(variant):
    def q(spark, sf):
        _, protos, tr = _train(spark, sf)
        out = LS.proxy_loss(tr, protos, variant, ALPHA)
        return out.select(_r(F.col("loss"), "loss"), "n_valid")
    return q


def _batched(spark, sf):
    os_, protos, tr = _train(spark, sf)
    return protos, SM.shuffled_batches(tr, BATCH, seed=0)


def q_l6_valid_classes(spark, sf):
    protos, b = _batched(spark, sf)
    s = LS.class_sums(LS.loss_terms(b, protos, "wo_shared", ALPHA), by="batch")
    return s.groupBy("batch").agg(F.sum("has_pos").cast("int").alias("n_valid"))


def q_l9_epoch_loss(spark, sf):
    """Per-batch losses of all four variants in one pass, then the epoch mean."""
    protos, b = _batched(spark, sf)
    per_batch = LS.multi_variant_loss(b, protos, alpha=ALPHA, by="batch")
    e = LS.epoch_loss(per_batch, by="variant")
    return e.select("variant", _r(F.col("epoch_loss"), "epoch_loss"), "n_batches")


# --------------------------------------------------------------- sampling ---

def q_b1_balanced(spark, sf):
    e = views.embedding_splits(spark, sf).select("row_id", "label")
    return SM.balanced_sample(e, "label", 30, seed=SEED)


def q_b2_batches(spark, sf):
    from .catalog import RATIO
    from .openset import prepare
    tr = prepare(views.embedding_splits(spark, sf), RATIO).split("train")
    return SM.shuffled_batches(tr.select("row_id"), BATCH, seed=0)


def q_p17_head_slice(spark, sf):
    e = views.embedding_splits(spark, sf).select("row_id")
    return L.head_slice(e, 117, ["row_id"])


# ----------------------------------------------------------------- epochs ---

def q_m6_running_mean(spark, sf):
    """Running mean, sum and count.  Scores have two decimals: they enter as whole hundredths, so
    sums are exact integers whatever the order, and the mean is one division."""
    m = views.epoch_metrics(spark, sf).withColumn("hundredths", F.round(F.col("valid_f1") * 100).cast("long"))
    r = EP.running_mean(m, ["run_id"], "epoch", "hundredths", keep_parts=True)
    return r.select("run_id", "epoch", F.col("running_sum").cast("long").alias("running_sum"), "running_count",
                    (F.col("running_mean") / 100).alias("running_mean"))


def q_m7_best_epoch(spark, sf):
    m = views.epoch_metrics(spark, sf)
    return EP.best_epoch(m, ["run_id"])


def q_m8_improved(spark, sf):
    m = views.epoch_metrics(spark, sf)
    return EP.improved_flags(m, ["run_id"]).select("run_id", "epoch", "improved")


def q_m9_export_gate(spark, sf):
    m = views.epoch_metrics(spark, sf)
    return EP.export_gate(m, ["run_id"]).select("run_id", "epoch", "export")


# ------------------------------------------------------------------- text ---

def q_p3_normalize(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "text")
    return TX.normalize_rows(d, "text", "norm_text").select("doc_id", "norm_text")


def q_p1_html_unescape(spark, sf):
    p = views.table(spark, sf, "pages").select("page_id", "html")
    return TX.unescape_rows(p, "html", "text").select("page_id", "text")


def q_s2_positional_zip(spark, sf):
    c = views.table(spark, sf, "conversations")
    roles = c.select("conv_id", "turn", "role")
    texts = c.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), "text")
    return zip_by_position(roles, ["conv_id", "turn"], texts, ["c2", "t2"]).select("row_id", "role", "text")


def q_m11_grid(spark, sf):
    from .experiments import run_grid
    return run_grid(spark, sf)


def q_m11_grid_pivot(spark, sf):
    """The grid's comparison: macro F1, one row per (dataset, ratio), one column per variant."""
    from .experiments import pivot_grid, run_grid
    return pivot_grid(run_grid(spark, sf))


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
for _v in LS.VARIANTS:
    QUERIES[f"l5_class_sums_{_v}"] = _class_sums(_v)
    QUERIES[f"l7_loss_{_v}"] = _loss(_v)
