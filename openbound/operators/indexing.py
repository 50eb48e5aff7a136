"""Global positions and order buckets without a single-partition window.

``Window.orderBy(...)`` with no partition pulls every row into one task.
``dense_index`` range-partitions on the whole order key instead and adds
partition offsets to places; ``quantile_buckets`` cuts a numeric key at
approximate quantiles (one distributed sketch; the bounds are literals, so
recomputation after an executor loss gives the same buckets).  The bucket
count follows the data: about ``TARGET_BUCKET_ROWS`` rows per bucket.  Up to
64 buckets the assignment is a codegen'd comparison tree; beyond that it is
Spark ML's ``Bucketizer`` (a JVM binary search over the bounds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TARGET_BUCKET_ROWS = 2_000_000
MIN_BUCKETS = 8
TREE_MAX_BOUNDS = 64


def bucket_count(n_rows: int, n_buckets: int | None = None) -> int:
    if n_buckets is not None:
        return max(1, int(n_buckets))
    return max(MIN_BUCKETS, -(-int(n_rows) // TARGET_BUCKET_ROWS))


def quantile_buckets(df: DataFrame, key: Column, out_col: str, n_buckets: int | None = None) -> DataFrame:
    """Add ``out_col`` = number of quantile bounds <= key (0 .. n_buckets-1)."""
    # nulls sort first in an ascending order: bucket them with -inf (bucket 0)
    tmp = df.withColumn("_qk", F.coalesce(key.cast("double"), F.lit(float("-inf"))))
    b = bucket_count(tmp.count() if n_buckets is None else 0, n_buckets)
    bounds: list[float] = []
    if b > 1:
        rel = min(0.001, 0.25 / b)
        q = tmp.approxQuantile("_qk", [i / b for i in range(1, b)], rel)
        # finite bounds only (null keys map to -inf); dropping bounds keeps the
        # assignment monotone, which is all exactness needs
        bounds = sorted({v for v in q if v is not None and float("-inf") < v < float("inf")})
    if len(bounds) <= TREE_MAX_BOUNDS:
        return tmp.withColumn(out_col, _bucket_expr(F.col("_qk"), bounds)).drop("_qk")
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf"), *bounds, float("inf")]
    bz = Bucketizer(splits=splits, inputCol="_qk", outputCol="_qb", handleInvalid="keep")
    out = bz.transform(tmp)
    return out.withColumn(out_col, F.col("_qb").cast("int")).drop("_qk", "_qb")


def _bucket_expr(k: Column, bounds: list[float]) -> Column:
    """Number of bounds <= k, as a balanced tree of comparisons (log depth)."""
    def build(lo: int, hi: int) -> Column:
        # bounds[lo:hi] undecided; result offset lo
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(k < F.lit(bounds[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))
    return build(0, len(bounds))


def dense_index(df: DataFrame, order_cols: Sequence[Column | str], out_col: str = "pos",
                n_buckets: int | None = None) -> DataFrame:
    """``row_number() over (order by order_cols) - 1`` of every row.

    One range partition on the whole order key (any type; a value of the first
    column that repeats is split by the others), sorted inside and
    checkpointed; the row's place in its partition and the running sum of the
    partition sizes (one row per partition) give the position.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keyed = df.select("*", *[c.alias(f"_dk{i}") for i, c in enumerate(cols)])
    keys = [f"_dk{i}" for i in range(len(cols))]
    parts = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*keys)
                       .withColumn("_dm", F.monotonically_increasing_id()))
    # the id's upper bits number the partition, its lower 33 bits the row inside
    numbered = rows.withColumn("_db", F.shiftright("_dm", 33)).withColumn("_di", F.col("_dm").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_db").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("_db").agg(F.count(F.lit(1)).alias("_dn"))
               .select("_db", F.coalesce(F.sum("_dn").over(before), F.lit(0)).alias("_off")))
    # as many rows as partitions were asked for above
    return (numbered.join(F.broadcast(offsets), "_db")
            .withColumn(out_col, (F.col("_off") + F.col("_di")).cast("long")).drop("_db", "_di", "_dm", "_off"))
