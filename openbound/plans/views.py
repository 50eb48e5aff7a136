"""Views over the driver's tables that stand in for the reference's inputs.

* ``embedding_splits``: ``embeddings(vec_id, embedding[64], label)`` as an
  utterance-embedding table ``(row_id, split, label, x)``; split by
  ``vec_id % 10`` (<7 train, =7 valid, else test); labels become strings.
* ``document_splits``: ``documents`` as labelled utterances, label = source;
  split by ``(doc_id div 20) % 10`` (source equals ``doc_id % 20``, so this
  keeps every source in every split).
* ``epoch_metrics``: ``events`` as a per-epoch metrics log (run = user_id,
  epoch = event_id, valid score = value).

Each view projects only the columns it needs, so the parquet scan reads just
those (``ReadSchema`` in the plan) and every filter above it is pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double_vector


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_of(bucket: Column) -> Column:
    return (F.when(bucket < 7, F.lit("train")).when(bucket == 7, F.lit("valid"))
            .otherwise(F.lit("test")))


def embedding_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    split_of(F.col("vec_id") % 10).alias("split"),
                    F.col("label").cast("string").alias("label"),
                    as_double_vector("embedding").alias("x"))


def document_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"),
                    split_of(F.call_function("div", F.col("doc_id"), F.lit(20)) % 10).alias("split"),
                    F.col("source").alias("label"), "text")


def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"),
                     F.col("value").alias("valid_f1"))
