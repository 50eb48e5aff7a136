"""CSV records whose quoted fields go over line ends (S1), read in parallel splits.

A quote only opens a field at its start, so whether a line end closes a record depends on all
text before it.  Each line is therefore a function of two states, "between records" and "inside
quotes": keep the state, change it, or lead to one of them whatever it was.  Functions compose:
the state at a line's start follows from the last line before it that leads to a fixed state and
the number of changing lines since.  That is a scan inside every split and one over the splits of
a file (a row per split), not a pass over the file.

A record is the line that starts between records and the lines after it that start inside quotes;
only records of several lines are grouped.  They are cut into fields, blank lines go, and the
records are numbered by a running count per split plus the counts of the splits before.  Where no
line of the file ends inside quotes every line is its own record and the scans are left out.

The lines are written with their split, their place and the records before them in the split
first, so a later change of the split size has no effect.  They are kept once: a line that was cut is
kept as its records only.  Where a line ends inside quotes, lines are read again with their raw text.

Rules (of the reader that the reference uses): fields are separated by commas; a field that starts
with a quote ends at the next single quote, doubled quotes are one, and what follows up to the
comma is added; other quotes are plain text.  Records end at ``\\n``, ``\\r\\n`` or ``\\r`` outside
quotes; inside quotes these are text.  Lines that are empty or only blanks and tabs are skipped.
A record with more fields than the first one is an error, missing fields are null, and so is a
quoted field that does not end.  An empty file has no records.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import cut_lineage, written_table
from .lines import _file_order, _with_file_pos

# a field up to its separator; possessive, so a long text is one pass
_PLAIN = r'[^",\r][^,\r]*+'
_CLOSED = r'"(?:[^"]|"")*+"[^,\r]*+'
_OPEN = re.compile(rf'(?:(?:{_CLOSED}|{_PLAIN}|)[,\r])*+"(?:[^"]|"")*+\Z')
_TO_CLOSE = re.compile(r'(?:[^"]|"")*+"[^,\r]*+')
_FIELD = re.compile(r'("(?:[^"]|"")*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)(,|\r\n|\n|\r|\Z)')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line (without its ``\\n``) that starts between records, or inside quotes, ends
    inside quotes."""
    if inside:
        m = _TO_CLOSE.match(line)
        if m is None:
            return True
        if m.end() == len(line):
            return False
        line = line[m.end() + 1:]
    return _OPEN.match(line) is not None


def cut_records(text: str) -> list[list[str]]:
    """The records of a text that ends between records."""
    out: list[list[str]] = []
    at, fields = 0, []
    while at < len(text) or fields:
        m = _FIELD.match(text, at)
        if not fields and m.group(2) != "," and m.group(1).strip(" \t") == "":
            at = m.end()                       # a blank line
            continue
        raw = m.group(1)
        if raw.startswith('"'):
            close = re.match(r'"(?:[^"]|"")*+"', raw).end()
            raw = raw[1:close - 1].replace('""', '"') + raw[close:]
        fields.append(raw)
        at = m.end()
        if m.group(2) != ",":
            out.append(fields)
            fields = []
    return out


TEXT_BYTES = 1 << 20       # text that a Python worker cuts at a time, beside one long line
_RECORDS = pa.list_(pa.list_(pa.string()))


def _runs(length: np.ndarray):
    """``(first, end)`` of runs of texts that hold about ``TEXT_BYTES`` together."""
    run = np.cumsum(length + 64) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(length)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if lo < hi]


def _line_function(x: str | None) -> tuple[int | None, list | None]:
    """A line's function: 0 keeps the state, 1 changes it, 2 leads between records, 3 inside quotes;
    and its records, if it starts and ends between records."""
    if x is None:
        return None, None
    quotes = '"' in x
    out, inside = quotes and ends_inside(x, False), not quotes or ends_inside(x, True)
    return (3 if inside else 1) if out else (0 if inside else 2), None if out else cut_records(x)


def _cut_lines(batches, raw: bool = False):
    """Lines ``(value, _lf, _lb, _lm, _hard)``, in order within their split, ``_hard`` the text of a
    line that is not simple, with the function and the records of the hard ones, their number of
    records and that of the split's lines before.  The text of a line that has records is kept if
    ``raw``.  A batch goes on in pieces, so that records of few lines are objects at a time."""
    at, before = None, 0
    for batch in batches:
        length = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False) for i in (0, 4))
        for lo, hi in _runs(length):
            part = batch.slice(lo, hi - lo)
            plain, hard = part.column(0).to_pylist(), part.column(4).to_pylist()
            got = [_line_function(x) for x in hard]
            count = [int(p.strip(" \t") != "") if x is None else len(r or ()) for p, x, (_, r) in zip(plain, hard, got)]
            places = []
            for split, k in zip(zip(part.column(1).to_pylist(), part.column(2).to_pylist()), count):
                at, before = split, before if split == at else 0
                places.append(before)
                before += k
            value = pa.array([p if x is None else x if raw or r is None else None for p, x, (_, r) in zip(plain, hard, got)], pa.string())
            yield pa.RecordBatch.from_arrays([value, *part.columns[1:4], pa.array([f for f, _ in got], pa.int32()), pa.array([r for _, r in got], _RECORDS),
                                              pa.array(count, pa.int64()), pa.array(places, pa.int64())],
                                             names=["value", "_lf", "_lb", "_lm", "_u", "_r", "_k", "_n"])


def _cut_table(spark: SparkSession, path: str, raw: bool) -> DataFrame:
    """The lines of a file, cut by ``_cut_lines`` and written; ``_r``: the records of a line that does
    not end inside quotes when it starts between records."""
    lines = _with_file_pos(spark.read.option("lineSep", "\n").text(path))
    simple = ~F.col("value").contains('"') & ~F.col("value").contains(",") & ~F.col("value").contains("\r")
    split = lines.select(F.when(simple, F.col("value")).alias("value"), "_lf", "_lb", "_lm", F.when(~simple, F.col("value")).alias("_hard"))
    cut = written_table(split.mapInArrow(lambda batches: _cut_lines(batches, raw),
                                         "value string, _lf string, _lb long, _lm long, _u int, _r array<array<string>>, _k long, _n long"))
    one = F.when(F.col("_k") == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array("value")))
    return cut.select("value", "_lf", "_lb", "_lm", F.coalesce("_u", F.lit(0)).alias("_fn"), F.when(F.col("_u").isNull(), one).otherwise(F.col("_r")).alias("_r"), "_k", "_n")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _records_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else cut_records(x) for x in text], dtype=object)


def _scan(fn: Column, part: list, order: list) -> tuple[Column, Column]:
    """Of the functions before a row: the last fixed state (null if none), and the parity of the
    changes since."""
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    changes = F.sum((fn == 1).cast("long"))
    fixed = F.last(F.when(fn >= 2, F.struct((fn - 2).alias("state"), F.col("_changes").alias("at"))), ignorenulls=True).over(before)
    return changes.over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), fixed


def _states(lines: DataFrame, start: Column, part: list, order: list, fn: str = "_fn") -> DataFrame:
    """``_in``: the state at the start of every row (0 between records, 1 inside quotes) when the
    rows of a part start with ``start``; ``_out``: the state after it."""
    changes, fixed = _scan(F.col(fn), part, order)
    x = lines.withColumn("_changes", changes).withColumn("_fixed", fixed)
    upto = F.col("_changes") - (F.col(fn) == 1).cast("long")         # changes before this row
    state = F.when(F.col("_fixed").isNull(), (start + upto) % 2).otherwise((F.col("_fixed.state") + upto - F.col("_fixed.at")) % 2).cast("int")
    x = x.withColumn("_in", state)
    after = F.when(F.col(fn) >= 2, F.col(fn) - 2).when(F.col(fn) == 1, 1 - F.col("_in")).otherwise(F.col("_in"))
    return x.withColumn("_out", after.cast("int")).drop("_changes", "_fixed")


def _split_starts(lines: DataFrame) -> DataFrame:
    """State at the start of every split: a scan over a row per split, each file from the start."""
    once = _states(lines, F.lit(0), ["_lf", "_lb"], ["_lm"]).withColumn("_a", F.col("_out"))
    twice = _states(once.drop("_in", "_out"), F.lit(1), ["_lf", "_lb"], ["_lm"])
    ends = twice.groupBy("_lf", "_lb").agg(F.max_by("_a", "_lm").alias("a"), F.max_by("_out", "_lm").alias("b"))
    # a split's function from its two ends
    fn = F.when(F.col("a") == F.col("b"), F.col("a") + 2).otherwise(F.col("a"))
    out = _states(ends.select("_lf", "_lb", fn.alias("_fn")), F.lit(0), ["_lf"], ["_lb"])
    return out.select("_lf", "_lb", F.col("_in").alias("_start"), F.col("_out").alias("_end"))


def _count_before(rows: DataFrame, count: Column) -> DataFrame:
    """Per split (a row each): the sum of ``count`` in the splits before."""
    per = rows.groupBy("_lf", "_lb").agg(F.sum(count).alias("_k"))
    before = Window.orderBy(*_file_order(), "_lb").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_lf", "_lb", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(row_id, fields)``: every record with its fields, numbered in file order; and their number."""
    lines = _cut_table(spark, path, raw=False)
    if lines.filter(F.col("_fn").isin(1, 3)).isEmpty():
        cut = lines.select("_lf", "_lb", "_lm", "_r", "_k", "_n")
    else:
        lines = _cut_table(spark, path, raw=True).drop("_k", "_n")
        starts = cut_lineage(_split_starts(lines))
        known = _states(lines.join(F.broadcast(starts.select("_lf", "_lb", "_start")), ["_lf", "_lb"]), F.col("_start"), ["_lf", "_lb"], ["_lm"])
        known = written_table(known.select("_lf", "_lb", "_lm", "value", "_r", "_in", "_out"))
        # records begun in a split, numbered on from those of the splits before
        off = _count_before(known, (F.col("_in") == 0).cast("long"))
        upto = Window.partitionBy("_lf", "_lb").orderBy("_lm").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = (known.withColumn("_g", F.sum((F.col("_in") == 0).cast("long")).over(upto))
                 .join(F.broadcast(off), ["_lf", "_lb"]).withColumn("_g", F.col("_g") + F.col("_off")))
        torn = starts.groupBy("_lf").agg(F.max_by("_end", "_lb").alias("_end")).filter(F.col("_end") == 1).select("_lf")
        torn = known.join(torn, "_lf").groupBy("_lf").agg(F.max("_g").alias("g")).first()
        if torn is not None:
            raise ValueError(f"{torn['_lf']}: line {torn['g'] - 1} opens a quoted field that does not end")
        alone = (F.col("_in") == 0) & (F.col("_out") == 0)
        # a file's lines follow each other by split and place
        several = (known.filter(~alone).groupBy("_lf", "_g")
                   .agg(F.array_sort(F.collect_list(F.struct("_lb", "_lm", "value"))).alias("l"))
                   .select("_lf", F.col("l")[0]["_lb"].alias("_lb"), F.col("l")[0]["_lm"].alias("_lm"),
                           F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value")))
        several = several.withColumn("_r", _records_udf("value"))
        cut = written_table(known.filter(alone).select("_lf", "_lb", "_lm", "_r").unionByName(several.select("_lf", "_lb", "_lm", "_r")))
        before = Window.partitionBy("_lf", "_lb").orderBy("_lm").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("_k", F.size("_r").cast("long")).withColumn("_n", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    cut = cut.filter(F.col("_k") > 0)
    off = _count_before(cut, F.col("_k"))
    out = (cut.join(F.broadcast(off), ["_lf", "_lb"])
           .select((F.col("_n") + F.col("_off")).alias("_n"), F.posexplode("_r").alias("_i", "fields"))
           .select((F.col("_n") + F.col("_i")).cast("long").alias("row_id"), "fields"))
    # the first record sets the number of fields
    place = F.struct(*_file_order(), "_lb", "_lm")
    seen = cut.agg(F.sum("_k").alias("n"), F.min_by(F.size(F.col("_r")[0]), place).alias("first"),
                   F.max(F.array_max(F.transform("_r", F.size))).alias("most")).first()
    if seen["n"] and seen["most"] > seen["first"]:
        bad = out.filter(F.size("fields") > seen["first"]).agg(F.min("row_id")).first()[0]
        raise ValueError(f"{path}: line {bad} has more fields than the first line")
    return out, int(seen["n"] or 0)


def read_column(spark: SparkSession, path: str, column: int = 0) -> tuple[DataFrame, int]:
    """``(row_id, value)``: one column, the first by default; a record without it has null."""
    out, n = read_records(spark, path)
    return out.select("row_id", F.get("fields", F.lit(column)).alias("value")), n
