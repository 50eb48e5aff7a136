"""Classification metrics (M1-M5, M10, M12) as grouped aggregations.

Every metric starts from one partial aggregation of the predictions -- the
confusion cells ``groupBy(by, y, pred)`` (M2) or the per-class counts
``groupBy(by, cls)`` (M3-M5, M12) -- so at most ``n_classes^2`` rows per key
leave a task however many rows there are and however skewed the classes are;
everything after that works on the small table.

Semantics follow the reference's scikit-learn calls:
* per-class report restricted to classes present in the targets, precision
  undefined -> 1 (``zero_division=1``); F1 = 2tp / (2tp + fp + fn);
* macro F1 over the union of true and predicted classes, undefined -> 0;
* in-domain F1 = mean F1 of known classes, out-of-domain F1 = F1 of the last
  class.  ``positional=True`` reproduces the reference's rule literally
  (ids ``0..K-2`` and ``K-1`` with K = number of distinct targets; NULL where
  the reference would raise KeyError).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def accuracy(df: DataFrame, y_col: str = "y", pred_col: str = "pred",
             by: Sequence[str] | str | None = None) -> DataFrame:
    """M1: mean of (y = pred)."""
    return df.groupBy(*_by(by)).agg(
        F.avg((F.col(y_col) == F.col(pred_col)).cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, y_col: str = "y", pred_col: str = "pred",
                     by: Sequence[str] | str | None = None) -> DataFrame:
    """Non-zero confusion cells ``(by..., y, pred, n)``."""
    return df.groupBy(*_by(by), F.col(y_col).alias("y"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, n_classes: int, y_col: str = "y", pred_col: str = "pred",
                     by: Sequence[str] | str | None = None) -> DataFrame:
    """M2: full ``n_classes x n_classes`` matrix in long form, zeros included.

    The spine is generated per group key with ``explode(sequence(...))`` over
    the distinct keys (no cross join); the non-zero cells are joined onto it.
    """
    keys = _by(by)
    cells = confusion_counts(df, y_col, pred_col, keys)
    c = int(n_classes)
    if keys:
        base = df.select(*keys).distinct()
    else:
        base = df.sparkSession.range(1).select()
    spine = base.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(c * c - 1))).alias("_cell"))
    spine = spine.select(*keys, (F.col("_cell") / c).cast("int").alias("y"),
                         (F.col("_cell") % c).cast("int").alias("pred"))
    # without keys the non-zero cells are at most n_classes^2: broadcast them when that bound is
    # small; with keys their number grows with the keys, and the join is left to the planner
    cells = F.broadcast(cells) if not keys and c * c <= 250_000 else cells
    out = spine.join(cells, [*keys, "y", "pred"], "left")
    return out.select(*keys, "y", "pred", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def class_counts(df: DataFrame, y_col: str = "y", pred_col: str = "pred",
                 by: Sequence[str] | str | None = None) -> DataFrame:
    """Per class ``(by..., cls, support, predicted, tp)`` in ONE partial aggregation:
    every row contributes its true class (support, tp) and its predicted class
    (predicted) -- one shuffle of at most ``classes`` rows per key and task."""
    keys = _by(by)
    y, p = F.col(y_col), F.col(pred_col)
    roles = F.array(
        F.struct(y.alias("cls"), F.lit(1).alias("s"), F.lit(0).alias("p"), (y == p).cast("int").alias("t")),
        F.struct(p.alias("cls"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    return (df.select(*keys, F.inline(roles))
            .groupBy(*keys, "cls")
            .agg(F.sum("s").cast("long").alias("support"), F.sum("p").cast("long").alias("predicted"),
                 F.sum("t").cast("long").alias("tp")))


def _f1(tp, support, predicted):
    denom = support + predicted
    return F.when(denom > 0, 2.0 * tp / denom).otherwise(F.lit(0.0))


def class_report(df: DataFrame, y_col: str = "y", pred_col: str = "pred",
                 by: Sequence[str] | str | None = None) -> DataFrame:
    """M3: precision / recall / F1 / support for classes present in the targets."""
    keys = _by(by)
    cc = class_counts(df, y_col, pred_col, keys).filter(F.col("support") > 0)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return cc.select(
        *keys, F.col("cls").cast("int").alias("cls"),
        F.when(prd > 0, tp / prd).otherwise(F.lit(1.0)).alias("precision"),
        (tp / sup).alias("recall"),
        _f1(tp, sup, prd).alias("f1"),
        sup.alias("support"))


def macro_f1(df: DataFrame, y_col: str = "y", pred_col: str = "pred",
             by: Sequence[str] | str | None = None) -> DataFrame:
    """M4: unweighted mean F1 over the union of true and predicted classes."""
    return macro_f1_from_counts(class_counts(df, y_col, pred_col, by), by)


def macro_f1_from_counts(cc: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    keys = _by(by)
    return cc.groupBy(*keys).agg(
        F.avg(_f1(F.col("tp"), F.col("support"), F.col("predicted"))).alias("macro_f1"))


def accuracy_from_counts(cc: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """M1 from the class counts: sum tp / sum support."""
    keys = _by(by)
    return cc.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"))


def report_from_counts(cc: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """M3 from the class counts."""
    keys = _by(by)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return cc.filter(sup > 0).select(
        *keys, F.col("cls").cast("int").alias("cls"),
        F.when(prd > 0, tp / prd).otherwise(F.lit(1.0)).alias("precision"),
        (tp / sup).alias("recall"), _f1(tp, sup, prd).alias("f1"), sup.alias("support"))


def ind_ood_from_counts(cc: DataFrame, n_known: int, by: Sequence[str] | str | None = None) -> DataFrame:
    """M5 (by class id) from the class counts."""
    keys = _by(by)
    rep = report_from_counts(cc, keys)
    return rep.groupBy(*keys).agg(
        F.avg(F.when(F.col("cls") < int(n_known), F.col("f1"))).alias("ind_f1"),
        F.max(F.when(F.col("cls") == int(n_known), F.col("f1"))).alias("ood_f1"))


def ind_ood_f1(df: DataFrame, n_known: int, y_col: str = "y", pred_col: str = "pred",
               by: Sequence[str] | str | None = None, positional: bool = False) -> DataFrame:
    """M5: in-domain F1 (mean over known classes) and out-of-domain F1."""
    keys = _by(by)
    rep = class_report(df, y_col, pred_col, keys)
    if not positional:
        return rep.groupBy(*keys).agg(
            F.avg(F.when(F.col("cls") < int(n_known), F.col("f1"))).alias("ind_f1"),
            F.max(F.when(F.col("cls") == int(n_known), F.col("f1"))).alias("ood_f1"))
    k = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.count(F.lit(1)).over(Window.partitionBy())
    rep = rep.withColumn("_k", k)
    agg = rep.groupBy(*keys).agg(
        F.first("_k").alias("_k"),
        F.sum(F.when(F.col("cls") < F.col("_k") - 1, F.col("f1"))).alias("_ind_sum"),
        F.sum(F.when(F.col("cls") < F.col("_k") - 1, 1).otherwise(0)).alias("_ind_n"),
        F.max(F.when(F.col("cls") == F.col("_k") - 1, F.col("f1"))).alias("ood_f1"))
    return agg.select(
        *keys,
        F.when(F.col("_ind_n") == F.col("_k") - 1, F.col("_ind_sum") / (F.col("_k") - 1)).alias("ind_f1"),
        "ood_f1")


def weighted_scores(df: DataFrame, y_col: str = "y", pred_col: str = "pred",
                    by: Sequence[str] | str | None = None) -> DataFrame:
    """Support-weighted precision / recall / F1 (undefined precision -> 0)."""
    keys = _by(by)
    cc = class_counts(df, y_col, pred_col, keys)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    prec = F.when(prd > 0, tp / prd).otherwise(0.0)
    rec = F.when(sup > 0, tp / sup).otherwise(0.0)
    total = F.sum(sup)
    return cc.groupBy(*keys).agg(
        (F.sum(sup * prec) / total).alias("weighted_precision"),
        (F.sum(sup * rec) / total).alias("weighted_recall"),
        (F.sum(sup * _f1(tp, sup, prd)) / total).alias("weighted_f1"))


def value_counts(df: DataFrame, col: str, count_col: str = "count") -> DataFrame:
    """``value_counts`` -- descending count, value as tiebreak."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.desc(count_col), F.asc(col)))
