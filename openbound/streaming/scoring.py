"""Structured Streaming form of the validation path (T2/T3 -> M2).

Boundary rejection is stateless per row, so the batch operators apply to a
stream unchanged: new embedding files are scored against the broadcast
prototype row as they arrive.  Per micro-batch, the confusion cells are
appended to a sink through ``foreachBatch`` (idempotent per batch id, so a
restarted query does not double count); the running matrix is a plain
aggregation over that table.  No state store is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import metrics as M
from ..operators import score as S
from ..operators.prototypes import Prototypes


def read_embedding_stream(spark: SparkSession, path: str, schema: StructType | str,
                          max_files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def score_stream(stream: DataFrame, protos: Prototypes, kind: str = "scalar",
                 x_col: str = "x", out_col: str = "pred") -> DataFrame:
    """Stateless scoring of a streaming frame (T2 ``vector`` / T3 ``scalar``)."""
    fn = S.reject_vector if kind == "vector" else S.reject_scalar
    return fn(stream, protos, x_col, out_col)


def confusion_sink(sink_path: str, y_col: str = "y", pred_col: str = "pred"):
    """``foreachBatch`` writer: confusion cells of the batch, keyed by batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        cells = M.confusion_counts(batch, y_col, pred_col).withColumn("batch_id", F.lit(int(batch_id)))
        (cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))
    return write


def running_confusion(spark: SparkSession, sink_path: str) -> DataFrame:
    """The matrix so far: sum of the per-batch cells."""
    return spark.read.parquet(sink_path).groupBy("y", "pred").agg(F.sum("n").alias("n"))
