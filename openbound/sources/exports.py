"""Sinks and their readers.

* S7  embedding export: parquet partitioned by ``run_id/epoch/split`` (the
      default; partition pruning on read), or the reference's TSV pair (one
      file of tab-separated floats, one of targets, paired by line).  Valid
      and test keep separate outputs (the reference overwrote one with the
      other).
* S8  TSV pair reader: both files numbered by line (``line_index``) and zipped.
* S9  any (features, target) frame as a TSV pair (head slices, balanced samples).
* S10 / S11 model bundle: prototypes, known labels and run config as parquet
      partitioned by ``dataset/ratio/run``; loading filters on the partition.
* S12 metrics log: append-only parquet ``(run_id, epoch, split, name, value)``.

The TSV pair is written from one checkpointed, ordered frame, so both files
get the same partitioning and row order (part files in order, lines in
order) and pair up line by line.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prototypes import Prototypes
from ..session import cut_lineage
from .lines import _with_file_pos, csv_field, line_index


def export_embeddings(df: DataFrame, path: str, run_id: str, epoch: int, split: str,
                      x_col: str = "x", y_col: str = "y", id_col: str = "row_id") -> None:
    """S7 (parquet): append one (run, epoch, split) partition."""
    out = df.select(F.lit(run_id).alias("run_id"), F.lit(int(epoch)).alias("epoch"),
                    F.lit(split).alias("split"), F.col(id_col).alias("row_id"),
                    F.col(y_col).cast("int").alias("y"), F.col(x_col).alias("embedding"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "epoch", "split").parquet(path))


def read_embeddings(spark: SparkSession, path: str, run_id: str | None = None,
                    epoch: int | None = None, split: str | None = None) -> DataFrame:
    """S11-style read of S7 parquet with partition pruning (partition names are text: run ``1``
    is not run ``01``)."""
    df = spark.read.schema("row_id long, y int, embedding array<double>, run_id string, epoch int, split string").parquet(path)
    for col, val in (("run_id", run_id), ("epoch", epoch), ("split", split)):
        if val is not None:
            df = df.filter(F.col(col) == val)
    return df


def write_tsv_pair(df: DataFrame, x_path: str, y_path: str, x_col: str = "x", y_col: str = "y",
                   order_col: str = "row_id") -> None:
    """S7 (TSV) / S9: features as tab-separated floats, targets one per line."""
    ordered = cut_lineage(df.select(order_col, x_col, y_col).orderBy(order_col))
    xs = ordered.select(F.array_join(F.transform(x_col, lambda v: v.cast("string")), "\t").alias("value"))
    ys = ordered.select(F.col(y_col).cast("string").alias("value"))
    xs.write.mode("overwrite").text(x_path)
    ys.write.mode("overwrite").text(y_path)


def read_tsv_pair(spark: SparkSession, x_path: str, y_path: str, target: str = "target") -> DataFrame:
    """``(row_id, x ARRAY<DOUBLE>, target)`` paired by line; counts must agree."""
    xs, nx = line_index(_with_file_pos(spark.read.text(x_path)))
    ys, ny = line_index(_with_file_pos(spark.read.text(y_path)))
    if nx != ny:
        raise ValueError(f"TSV pair has {nx} feature lines and {ny} target lines")
    xs = xs.select("row_id", F.transform(F.split("value", "\t"), lambda v: v.cast("double")).alias("x"))
    ys = ys.select("row_id", F.col("value").cast("int").alias(target))
    return xs.join(ys, "row_id")


def write_line_files(df: DataFrame, base: str, splits=("train", "valid", "test"),
                     label_col: str = "label", text_col: str = "text", order_col: str = "row_id",
                     vocab: DataFrame | None = None) -> None:
    """The reference's dataset layout: ``{base}/{split}/label`` and
    ``{split}/seq.in`` paired by line, plus ``intent_label.txt`` (vocab order);
    fields are quoted where CSV asks for it.  Labels and texts are sorted each for itself, by
    (order, label): rows equal in both have the same label line, so that the files pair up
    whatever the order of such rows.  ``df`` gives the same rows whenever it is read."""
    for sp in splits:
        rows = df.filter(F.col("split") == sp).select(order_col, F.col(label_col).alias("_label"), F.col(text_col).alias("_text"))
        ordered = rows.orderBy(order_col, "_label")
        ordered.select(csv_field("_label").alias("value")).write.mode("overwrite").text(f"{base}/{sp}/label")
        ordered.select(csv_field("_text").alias("value")).write.mode("overwrite").text(f"{base}/{sp}/seq.in")
    if vocab is not None:
        v = cut_lineage(vocab.select("pos", "label").orderBy("pos"))
        v.select(csv_field("label").alias("value")).write.mode("overwrite").text(f"{base}/intent_label.txt")


def write_split_tsv(df: DataFrame, path: str, text_col: str = "text", label_col: str = "label",
                    order_col: str = "row_id") -> None:
    """S13 writer: one ``text<TAB>label`` line per row, in ``order_col`` order."""
    part = cut_lineage(df.select(order_col, text_col, label_col).orderBy(order_col))
    part.select(F.concat_ws("\t", text_col, label_col).alias("value")).write.mode("overwrite").text(path)


# ------------------------------------------------------------- bundles ----

def save_bundle(protos: Prototypes, known: DataFrame, config: Mapping[str, object], path: str,
                dataset: str, ratio: float, run: str) -> None:
    """Prototypes, known labels and run config under dataset/ratio/run."""
    spark = known.sparkSession
    keys = [F.lit(dataset).alias("dataset"), F.lit(str(ratio)).alias("ratio"), F.lit(run).alias("run")]
    parts = ["dataset", "ratio", "run"]

    def put(df: DataFrame, name: str):
        (df.select(*keys, "*").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*parts).parquet(f"{path.rstrip('/')}/{name}"))

    put(protos.to_frame(spark), "prototypes")
    put(known.select("cls", "label"), "known_labels")
    cfg = spark.createDataFrame([(k, json.dumps(v)) for k, v in config.items()], "key string, value string")
    put(cfg, "run_config")


def load_bundle(spark: SparkSession, path: str, dataset: str, ratio: float, run: str):
    """``(Prototypes, known DataFrame, config dict)`` of one run (partition filters)."""
    # schemas are given: inferred partition types would merge the runs 1 and 01
    schemas = {"prototypes": "cls int, proxy array<double>, margin double, margin_vec array<double>, radius double",
               "known_labels": "cls int, label string", "run_config": "key string, value string"}

    def get(name: str) -> DataFrame:
        return (spark.read.schema(schemas[name] + ", dataset string, ratio string, run string").parquet(f"{path.rstrip('/')}/{name}")
                .filter((F.col("dataset") == dataset) & (F.col("ratio") == str(ratio)) & (F.col("run") == run))
                .drop("dataset", "ratio", "run"))

    protos = Prototypes.from_frame(get("prototypes"))
    # one row per setting that save_bundle was given
    cfg = {r["key"]: json.loads(r["value"]) for r in get("run_config").collect()}
    return protos, get("known_labels"), cfg


# ------------------------------------------------------------- metrics ----

METRICS_SCHEMA = "run_id string, epoch int, split string, name string, value double"


def append_metrics(df: DataFrame, path: str) -> None:
    """Append rows ``(run_id, epoch, split, name, value)``."""
    df.select("run_id", F.col("epoch").cast("int"), "split", "name",
              F.col("value").cast("double")).write.mode("append").parquet(path)


def metrics_wide(log: DataFrame) -> DataFrame:
    """Per (run, epoch) one column per ``split/name`` (the reference's logged dict)."""
    return (log.withColumn("key", F.concat_ws("/", "split", "name"))
            .groupBy("run_id", "epoch").pivot("key").agg(F.first("value")))
