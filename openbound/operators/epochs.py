"""Per-run, per-epoch windows (M6-M9) without one task per run.

The reference keeps running means over batches, a best-so-far score and a
one-epoch-delayed export flag.  Written as ``Window.partitionBy(run)`` these
put a whole run in one task; a run holding a third of all rows would stall
the job.  ``segmented_scan`` is the exact two-level prefix scan instead:

1. global cells = (run, order bucket), buckets cut at approximate quantiles
   of the order column (bucket count from the row count, see
   ``indexing.quantile_buckets``), so every cell holds about N / n_buckets
   rows or fewer;
2. in-cell running aggregates with a window over the cell;
3. per-cell totals (partial aggregation, <= runs x n_buckets rows), prefixed
   across the cells of a run with a window over at most n_buckets rows;
4. the prefix of earlier cells is joined back on (run, bucket) and merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indexing import quantile_buckets

_MERGE = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b,
          "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_EMPTY = {"sum": 0.0, "count": 0, "max": None, "min": None}


def _buckets(df: DataFrame, order_col: str, n_buckets: int | None):
    return quantile_buckets(df, F.col(order_col), "_cb", n_buckets)


def segmented_scan(df: DataFrame, part_cols: Sequence[str], order_col: str,
                   aggs: dict[str, tuple[str, str]], inclusive: bool = True,
                   n_buckets: int | None = None) -> DataFrame:
    """Running aggregates per ``part_cols`` in ``order_col`` order.

    ``aggs`` maps output name -> (function, column), function in sum / count
    / max / min.  ``inclusive=False`` aggregates strictly preceding rows
    (NULL / 0 for the first row).  Order values must be unique per partition.
    """
    parts = list(part_cols)
    b = _buckets(df, order_col, n_buckets)
    hi = 0 if inclusive else -1
    wl = Window.partitionBy(*parts, "_cb").orderBy(order_col).rowsBetween(Window.unboundedPreceding, hi)
    for name, (fn, col) in aggs.items():
        b = b.withColumn(f"_l_{name}", _AGG[fn](col).over(wl))
    cells = b.groupBy(*parts, "_cb").agg(*[_AGG[fn](col).alias(f"_t_{name}")
                                           for name, (fn, col) in aggs.items()])
    wp = Window.partitionBy(*parts).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    # totals of earlier cells combine with sum (for sum and count) or max / min
    prefix = cells.select(*parts, "_cb", *[_AGG["sum" if fn == "count" else fn](f"_t_{name}").over(wp)
                                           .alias(f"_p_{name}") for name, (fn, _) in aggs.items()])
    out = b.join(prefix, [*parts, "_cb"], "left")
    for name, (fn, _) in aggs.items():
        local, pre = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if fn in ("sum", "count"):
            merged = F.coalesce(local, F.lit(_EMPTY[fn])) + F.coalesce(pre, F.lit(_EMPTY[fn]))
        else:
            merged = F.coalesce(_MERGE[fn](local, pre), local, pre)
        out = out.withColumn(name, merged)
    drop = [c for c in out.columns if c.startswith(("_l_", "_p_"))]
    return out.drop(*drop, "_cb")


# ------------------------------------------------------------ M6 - M9 -----

def running_mean(df: DataFrame, run_cols: Sequence[str], order_col: str, value_col: str,
                 out_col: str = "running_mean", n_buckets: int | None = None,
                 keep_parts: bool = False) -> DataFrame:
    """M6: mean of the values so far (the reference's running batch averages).

    ``keep_parts`` also returns ``running_sum`` and ``running_count``.
    """
    s = segmented_scan(df, run_cols, order_col,
                       {"running_sum": ("sum", value_col), "running_count": ("count", value_col)},
                       True, n_buckets)
    s = s.withColumn(out_col, F.col("running_sum") / F.col("running_count"))
    return s if keep_parts else s.drop("running_sum", "running_count")


def improved_flags(df: DataFrame, run_cols: Sequence[str], epoch_col: str = "epoch",
                   score_col: str = "valid_f1", out_col: str = "improved",
                   n_buckets: int | None = None) -> DataFrame:
    """M8: ``score >= best so far`` with the best starting at 0 (ties improve)."""
    s = segmented_scan(df, run_cols, epoch_col, {"_best": ("max", score_col)}, False, n_buckets)
    best = F.greatest(F.coalesce(F.col("_best"), F.lit(0.0)), F.lit(0.0))
    return s.withColumn(out_col, F.col(score_col) >= best).drop("_best")


def export_gate(df: DataFrame, run_cols: Sequence[str], epoch_col: str = "epoch",
                score_col: str = "valid_f1", out_col: str = "export",
                n_buckets: int | None = None) -> DataFrame:
    """M9: epoch e exports iff epoch e-1 improved; the first epoch always does.

    Needed are the previous score and the best up to e-2.  One window over the
    (run, bucket) cells gives both inside a cell; for the first rows of a cell
    they come from a summary with one row per cell (its last score, its best,
    its best before the last)."""
    runs = list(run_cols)
    b = _buckets(df, epoch_col, n_buckets)
    w = Window.partitionBy(*runs, "_cb").orderBy(epoch_col)
    upto = lambda k: F.max(score_col).over(w.rowsBetween(Window.unboundedPreceding, k))
    rows = (b.withColumn("_rn", F.row_number().over(w)).withColumn("_prev", F.lag(score_col, 1).over(w))
            .withColumn("_b1", upto(-1)).withColumn("_b2", upto(-2)))
    cells = rows.groupBy(*runs, "_cb").agg(F.max(score_col).alias("_max"), F.max_by(score_col, epoch_col).alias("_last"),
                                           F.max_by("_b1", epoch_col).alias("_but_last"))
    wc = Window.partitionBy(*runs).orderBy("_cb")
    before = cells.select(
        *runs, "_cb", F.max("_max").over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("_p1"),
        F.max("_max").over(wc.rowsBetween(Window.unboundedPreceding, -2)).alias("_p2"),
        F.lag("_last", 1).over(wc).alias("_pl"), F.lag("_but_last", 1).over(wc).alias("_pb"),
        (F.row_number().over(wc) == 1).alias("_first_cell"))
    j = rows.join(before, [*runs, "_cb"], "left")
    first = F.col("_rn") == 1
    prev = F.when(first, F.col("_pl")).otherwise(F.col("_prev"))
    best = F.greatest(F.when(first, F.greatest("_p2", "_pb")).otherwise(F.greatest("_p1", "_b2")), F.lit(0.0))
    gate = F.when(first & F.col("_first_cell"), F.lit(True)).otherwise(prev >= best)
    return j.withColumn(out_col, gate).drop("_rn", "_prev", "_b1", "_b2", "_p1", "_p2", "_pl", "_pb", "_first_cell", "_cb")


def best_epoch(df: DataFrame, run_cols: Sequence[str], epoch_col: str = "epoch",
               score_col: str = "valid_f1", carry: Sequence[str] = ()) -> DataFrame:
    """M7: the last epoch reaching the maximal score (>= 0), with its carried columns.

    ``max_by`` over ``(score, epoch)`` is a partial aggregation: a run of any
    size costs one buffer per task.
    """
    cols = [epoch_col, score_col, *carry]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(score_col), F.col(epoch_col)))
    g = (df.filter(F.col(score_col) >= 0).groupBy(*run_cols).agg(best.alias("_b")))
    return g.select(*run_cols, *[F.col(f"_b.{c}").alias(("best_" + c) if c in (epoch_col, score_col) else c)
                                 for c in cols])
