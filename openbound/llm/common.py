"""Shared helpers of the training-data operators: written intermediates and id checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers and resolve the shared folder."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor never causes more than one step to be
    computed again, and non-deterministic columns (row numbers) become fixed.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def need(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing, there are {df.columns}")
