"""Sampling and batching (B1, B2).

All orderings are seeded functions of the row id (``mix_key``), so a sample
or a batch assignment is reproducible and survives recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import mix_key
from .indexing import dense_index

MIN_SALTS = 8
TARGET_CELL_ROWS = 2_000_000


def balanced_sample(df: DataFrame, class_col: str, k: int, seed: int = 42,
                    id_col: str = "row_id", strict: bool = True,
                    salt_buckets: int | None = None) -> DataFrame:
    """B1: exactly ``k`` rows per class, seeded.

    The k rows with the smallest seeded key are kept per class.  Top-k is
    decomposable, so it runs in two window passes: first per (class, salt),
    which splits a hot class over many tasks, then per class over at most
    ``salts * k`` survivors.  Of the per-class counts only the smallest and the
    largest reach the driver: the largest sizes the salts (about
    ``TARGET_CELL_ROWS`` rows per (class, salt) cell), the smallest serves the
    ``strict`` check: like the reference, a class with fewer than k rows is an
    error.
    """
    sizes = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"))
    smallest, biggest = sizes.agg(F.min(F.struct("_n", class_col)), F.max("_n")).first()
    if strict and smallest is not None and smallest["_n"] < k:
        raise ValueError(f"class {smallest[class_col]!r} has {smallest['_n']} rows < {k}")
    if salt_buckets is None:
        salt_buckets = max(MIN_SALTS, -(-(biggest or 0) // TARGET_CELL_ROWS))
    key = mix_key(id_col, seed)
    keyed = df.withColumn("_bk", key).withColumn("_bs", F.pmod(F.xxhash64(id_col), F.lit(salt_buckets)))
    w1 = Window.partitionBy(class_col, "_bs").orderBy("_bk", id_col)
    stage1 = keyed.withColumn("_br", F.row_number().over(w1)).filter(F.col("_br") <= k)
    w2 = Window.partitionBy(class_col).orderBy("_bk", id_col)
    out = stage1.withColumn("_br", F.row_number().over(w2)).filter(F.col("_br") <= k)
    return out.drop("_bk", "_bs", "_br")


def shuffled_batches(df: DataFrame, batch_size: int, seed: int, id_col: str = "row_id",
                     out_col: str = "batch") -> DataFrame:
    """B2: shuffled mini-batches of ``batch_size``; the last short batch is kept.

    Position in the seeded order comes from ``dense_index`` (no
    single-partition window); batch = position div batch_size.
    """
    idx = dense_index(df.withColumn("_bk", mix_key(id_col, seed)), ["_bk", id_col], "_pos")
    return (idx.withColumn(out_col, F.floor(F.col("_pos") / F.lit(int(batch_size))).cast("long"))
            .drop("_bk", "_pos"))
