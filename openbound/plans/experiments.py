"""Experiment grid (M11): ratios x loss variants, one evaluation per cell.

The reference runs 3 datasets x 3 known-class ratios x 4 variants as 36
separate processes.  Here one setup per (dataset, ratio) -- vocabulary, known
list, centroid fixture -- is shared by its four variants; every cell is a
small aggregate (macro F1 of the variant's predictor, loss of the variant),
and all cells are unioned into one result, long or pivoted wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loss as LS
from ..operators import metrics as M
from ..operators import score as S
from . import views
from .openset import prepare_with_prototypes

RATIOS = (0.25, 0.5, 0.75)


def run_grid(spark: SparkSession, sf: str, ratios: Sequence[float] = RATIOS,
             variants: Sequence[str] = tuple(LS.VARIANTS), alpha: float = 4.0,
             split: str = "test") -> DataFrame:
    """Long result ``(dataset, ratio, variant, metric, value)``, metric in macro_f1 / loss."""
    out = None
    by_kind = {}
    for v in variants:
        by_kind.setdefault(LS.VARIANTS[v][0], []).append(v)
    for ratio in ratios:
        os_, protos = prepare_with_prototypes(views.embedding_splits(spark, sf), ratio, margin_vectors=True)
        rows = os_.split(split).select("row_id", "y", "x")
        # both predictors from one pass, stacked by margin kind
        both = S.reject_both(rows, protos)
        stacked = both.select("y", F.explode(F.array(
            F.struct(F.lit("vector").alias("kind"), F.col("pred_vector").alias("pred")),
            F.struct(F.lit("scalar").alias("kind"), F.col("pred_scalar").alias("pred")))).alias("_k")
        ).select("y", "_k.*")
        f1 = M.macro_f1(stacked, by="kind")
        kind_variants = F.create_map(*[x for k, vs in by_kind.items()
                                       for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
        f1 = f1.select(F.explode(kind_variants[F.col("kind")]).alias("variant"),
                       F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value"))
        loss = LS.multi_variant_loss(rows, protos, tuple(variants), alpha).select(
            "variant", F.lit("loss").alias("metric"), F.col("loss").alias("value"))
        cell = f1.unionByName(loss).select(
            F.lit("embeddings").alias("dataset"), F.lit(float(ratio)).alias("ratio"),
            "variant", "metric", F.round("value", 6).alias("value"))
        out = cell if out is None else out.unionByName(cell)
    return out


def pivot_grid(grid: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Wide comparison: one row per (dataset, ratio), one column per variant."""
    return (grid.filter(F.col("metric") == metric).groupBy("dataset", "ratio")
            .pivot("variant", list(LS.VARIANTS)).agg(F.first("value")))
