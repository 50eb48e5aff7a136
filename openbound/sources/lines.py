"""Line-file sources.

The reference stores each split as two parallel files, ``label`` and
``seq.in``, paired purely by line number.  Spark rows have no line number, so
``line_index`` derives an exact one from the file metadata:

* every row gets its file (``_metadata.file_path``), the start of its split
  (``_metadata.file_block_start``) and a per-task increasing id
  (``monotonically_increasing_id``), which increases in line order inside one
  split; this frame is checkpointed *before* anything is counted, so a later
  change of the split size cannot separate rows from their counts;
* one aggregation of the frozen frame gives, per (file, split), its row count
  and first id; a running sum over that table (one row per split) gives the
  offsets in (file, split) order;
* line = offset(file, split) + (id - first id of the split).

CSV records, whose quoted fields may go over line ends, are read by ``csv_records``.

Two files are zipped with an equi-join on the line number, after checking
that their counts agree (the reference would silently misalign them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_line
from ..operators.indexing import dense_index
from ..operators.labels import _maybe_broadcast
from ..session import cut_lineage


def _with_file_pos(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_lf"),
                     F.col("_metadata.file_block_start").alias("_lb"),
                     F.monotonically_increasing_id().alias("_lm"))


#: Order of files: Spark part files by their numeric index (``part-100000``
#: after ``part-99999``), anything else by name.
_PART = r"^(.*/)part-([0-9]+)([^/]*)$"


def _file_order() -> list[Column]:
    f = F.col("_lf")
    number = F.regexp_extract(f, _PART, 2)
    folder = F.regexp_extract(f, "^(.*/)[^/]*$", 1)
    return [folder, number == "", F.when(number != "", number.cast("decimal(38,0)")), f]


def line_index(df_with_meta: DataFrame, out_col: str = "row_id") -> tuple[DataFrame, int]:
    """Number the rows of a freshly read file DataFrame by line; returns (df, count)."""
    rows = cut_lineage(df_with_meta)
    blocks = rows.groupBy("_lf", "_lb").agg(F.count(F.lit(1)).alias("_n"), F.min("_lm").alias("_m0"))
    before = Window.orderBy(*_file_order(), "_lb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(blocks.select("_lf", "_lb", "_n", "_m0",
                                        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    total = offsets.agg(F.sum("_n")).first()[0] or 0
    # one row per split of a file
    out = rows.join(F.broadcast(offsets.drop("_n")), ["_lf", "_lb"])
    out = out.withColumn(out_col, F.col("_off") + F.col("_lm") - F.col("_m0"))
    return out.drop("_lf", "_lb", "_lm", "_m0", "_off"), int(total)


def read_lines(spark: SparkSession, path: str, strip: bool = False) -> tuple[DataFrame, int]:
    """S1 ``lines`` mode / S1b: every line, blanks kept as ''; optional strip."""
    df = _with_file_pos(spark.read.text(path))
    df, n = line_index(df)
    v = strip_line("value") if strip else F.col("value")
    return df.select("row_id", v.alias("value")), n


def csv_field(value: Column | str) -> Column:
    """The text as a CSV field: quoted if a comma, a quote or a line end asks for it."""
    c = F.col(value) if isinstance(value, str) else value
    special = c.contains(",") | c.contains('"') | c.contains("\n") | c.contains("\r")
    return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def read_first_field(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """S1 ``csv`` mode: first column of every record; quoted fields may hold commas, quotes and
    line ends, blank lines are skipped, a record with more fields than the first is an error."""
    from .csv_records import read_column
    return read_column(spark, path)


def read_text_column(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, int]:
    if fmt == "csv":
        return read_first_field(spark, path)
    if fmt == "lines":
        return read_lines(spark, path)
    raise ValueError(f"unknown format {fmt!r}")


def zip_columns(left: DataFrame, n_left: int, right: DataFrame, n_right: int,
                what: str = "files") -> DataFrame:
    """Pair two positional columns; a count mismatch is an error."""
    if n_left != n_right:
        raise ValueError(f"{what}: {n_left} vs {n_right} lines; positional pairing impossible")
    return left.join(right, "row_id")


def load_split(spark: SparkSession, data_dir: str, split: str, fmt: str = "csv") -> DataFrame:
    """``{data_dir}/{split}/label`` zipped with ``{split}/seq.in``."""
    base = f"{data_dir.rstrip('/')}/{split}"
    lab, nl = read_text_column(spark, f"{base}/label", fmt)
    txt, nt = read_text_column(spark, f"{base}/seq.in", fmt)
    z = zip_columns(lab.withColumnRenamed("value", "label"), nl,
                    txt.withColumnRenamed("value", "text"), nt, base)
    return z.select("row_id", F.lit(split).alias("split"), "label", "text")


def load_splits(spark: SparkSession, data_dir: str, splits: Sequence[str] = ("train", "valid", "test"),
                fmt: str = "csv") -> DataFrame:
    """S3: the three splits under one schema ``(row_id, split, label, text)``."""
    out = None
    for s in splits:
        df = load_split(spark, data_dir, s, fmt)
        out = df if out is None else out.unionByName(df)
    return out


def read_vocabulary(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``intent_label.txt`` as ``(pos, label)`` in file order."""
    df, n = read_text_column(spark, path, fmt)
    return _maybe_broadcast(df.select(F.col("row_id").cast("int").alias("pos"), F.col("value").alias("label")), n)


def read_split_labels(spark: SparkSession, data_dir: str,
                      splits: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Label files of several splits for profiling ``(split, row_id, label)``."""
    out = None
    for s in splits:
        df, _ = read_first_field(spark, f"{data_dir.rstrip('/')}/{s}/label")
        df = df.select(F.lit(s).alias("split"), "row_id", F.col("value").alias("label"))
        out = df if out is None else out.unionByName(df)
    return out


def read_split_tsv(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One ``text<TAB>label`` file per split into the S3 schema."""
    raw = _with_file_pos(spark.read.option("sep", "\t").option("quote", "").schema(
        "text string, label string").csv(path))
    df, _ = line_index(raw)
    return df.select("row_id", F.lit(split).alias("split"), "label", "text")


def zip_by_position(left: DataFrame, left_order: Sequence[Column | str], right: DataFrame,
                    right_order: Sequence[Column | str]) -> DataFrame:
    """J5 for tables: number each side by its own order (``dense_index``) and
    pair rows with equal positions; unequal lengths are an error."""
    nl, nr = left.count(), right.count()        # plain scans, not the windowed plans
    li = dense_index(left, left_order, "row_id")
    ri = dense_index(right, right_order, "row_id")
    drop_l = [c if isinstance(c, str) else None for c in left_order]
    drop_r = [c if isinstance(c, str) else None for c in right_order]
    li = li.drop(*[c for c in drop_l if c])
    ri = ri.drop(*[c for c in drop_r if c])
    return zip_columns(li, nl, ri, nr, "tables")
