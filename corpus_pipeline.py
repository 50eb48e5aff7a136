"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, best-fit packing.

Every stage takes what its predecessor kept, as written Parquet.  All but the last return the
columns of ``documents``; the last returns the packed pieces.

1. ``quality``: rows that the weakly supervised classifier scores below its threshold go.
2. ``line_dedup``: later copies of line runs of 50 words or more are deleted from the texts.
3. ``near_dedup``: of documents linked by SimHash (3-word shingles, 3 bits) one stays.
4. ``packing``: the rest is tokenised and packed into sequences of 1024 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openbound.llm import line_dedup, packing, quality, simhash
from openbound.llm.common import shared_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.classify(docs, score_col="__quality_score", kept_col="__kept")
    return judged.filter(F.col("__kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_copied_lines), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 1000           # whole texts that a Python worker holds at a time: it stays in memory beside the next stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        for name, stage in STAGES:
            out = shared_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return docs


# the classifier's fit and the tokeniser have no SQL form: tests compare the stages with brute force
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
