"""Line dedup over line-ID sequences: prefix doubling, common-prefix intervals, later copies go.

Every document is a sequence of line identifiers; the suffixes of all sequences are grouped
by their first 1, 2, 4, ... lines (prefix doubling).  The rank of a prefix is the smallest
text position where it starts, so two positions share a rank at depth d exactly if their
first d lines are equal, and one partial aggregation names all of them.  Positions whose
prefix occurs once leave at once; a sequence ends where a line occurs once.  The suffixes
that share their first q lines form the longest-common-prefix interval of depth q, keyed by
the ranks of its two overlapping power-of-two halves.  The first member of an interval stays,
the run of every later member is deleted.

A run counts once it has ``min_words`` words: for every position the shortest run that starts
there and reaches ``min_words``, and the shortest that ends there, are looked up.  The union of
the runs found is exactly the union of all maximal repeated runs of ``min_words`` words or
more, because each line of such a run lies in a shortest run inside it.

Only DataFrame expressions are used.  Text positions come from a range sort on
``(doc_id, text digest, line)`` written to the shared folder, so they survive lost executors.

Defined results: documents are ordered by id (null first), then by the digest of their text.
Rows with equal id and equal text are one document and get the same result.  Null text is the
empty text and stays null.  Lines are separated by ``\\n`` and compared byte for byte.  A
document that consists of copies only becomes the empty text.  Other columns are kept, and may
have any names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, prepare, written

MIN_WORDS = 50


WORD = r"[^\x20\x09-\x0D]+"


def _doc_key(doc_id: Column, text: Column) -> Column:
    """Digest that stands for the document: of its id and of the digest of its text."""
    return F.unhex(F.md5(F.concat_ws(":", F.md5(F.encode(text, "UTF-8")), doc_id.cast("string"))))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, ln, line, words, pos)``: one row per line; ``doc`` and ``line`` are digests, ``pos``
    is an order-preserving position over all documents.  Written to the shared folder."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    lines = (src.select("doc_id", _doc_key(F.col("doc_id"), F.col("t")).alias("doc"),
                        F.posexplode(F.split("t", "\n", -1)).alias("ln", "s"))
             .select("doc_id", "doc", "ln", F.unhex(F.md5(F.encode("s", "UTF-8"))).alias("line"),
                     F.regexp_count("s", F.lit(WORD)).alias("words")))
    # written before the range sort, whose sampling would read and split every text once more
    lines = written(lines, "split")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # repeated rows meet in the range partition of their key, so dropping them needs no further shuffle
    placed = (lines.repartitionByRange(parts, "doc_id", "doc", "ln").dropDuplicates(["doc_id", "doc", "ln"])
              .sortWithinPartitions("doc_id", "doc", "ln").withColumn("pos", F.monotonically_increasing_id()))
    return written(placed.drop("doc_id"), "lines")


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``pairs`` whose key occurs at two positions or more, with the key's rank."""
    rank = (pairs.groupBy(*keys).agg(F.min("pos").alias("rank"), F.max("pos").alias("top"))
            .filter("rank < top").select(*keys, "rank"))
    # written: a join of two plain exchanges is one that adaptive execution splits at a hot key
    return pairs.join(written(rank, "names"), keys).select("doc", "ln", "pos", "words", "rank")


def _shortest_runs(first: DataFrame, min_words: int) -> DataFrame:
    """``(doc, start, q)``: for every repeated line the shortest run of consecutive repeated
    lines with ``min_words`` words that starts there, and the one that ends there."""
    seg = first.select("doc", "ln", "words",
                       (F.col("ln") - F.row_number().over(Window.partitionBy("doc").orderBy("ln"))).alias("seg"))
    ws = Window.partitionBy("doc", "seg").orderBy("ln")
    cum = seg.withColumn("upto", F.sum("words").over(ws)).withColumn("before", F.col("upto") - F.col("words"))

    def nearest(ask: Column, answer: Column, ahead: bool) -> DataFrame:
        """Every line asks at one key and answers at another: sorted by key, the nearest
        answer is the last one seen."""
        ev = cum.select("doc", "seg", "ln", F.explode(F.array(
            F.struct(F.lit(0).alias("asks"), answer.alias("at")), F.struct(F.lit(1).alias("asks"), ask.alias("at")))).alias("e"))
        order = [F.desc("e.at"), F.asc("e.asks"), F.desc("ln")] if ahead else [F.asc("e.at"), F.asc("e.asks"), F.asc("ln")]
        seen = (Window.partitionBy("doc", "seg").orderBy(*order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = F.last(F.when(F.col("e.asks") == 0, F.col("ln")), ignorenulls=True).over(seen)
        return ev.withColumn("hit", hit).filter("e.asks = 1 AND hit IS NOT NULL")
    starts = nearest(F.col("before") + min_words, F.col("upto"), True).select(
        "doc", F.col("ln").alias("start"), (F.col("hit") - F.col("ln") + 1).alias("q"))
    ends = nearest(F.col("upto") - min_words, F.col("before"), False).select(
        "doc", F.col("hit").alias("start"), (F.col("ln") - F.col("hit") + 1).alias("q"))
    return starts.unionByName(ends).distinct()


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, start, end)``: the maximal spans of lines that copy an earlier run; ``doc`` is
    the document's digest, lines count from 0."""
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    level = written(_ranked(line_table(docs, id_col, text_col), ["line"]), "rank")
    runs = written(_shortest_runs(level, min_words), "runs")
    longest = runs.agg(F.max("q")).first()[0] or 0
    levels, width = [level.select(F.lit(1).alias("width"), "doc", "ln", "pos", "rank")], 1
    while 2 * width <= longest:
        # the rank ``width`` lines further on in the same document, if that position still counts
        ahead = Window.partitionBy("doc").orderBy("ln").rangeBetween(width, width)
        pairs = (level.withColumn("next", F.max("rank").over(ahead)).filter("next IS NOT NULL")
                 .withColumnRenamed("rank", "here"))
        level = written(_ranked(pairs, ["here", "next"]), "rank")
        width *= 2
        levels.append(level.select(F.lit(width).alias("width"), "doc", "ln", "pos", "rank"))
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.unionByName(x)
    # the interval of depth q: the ranks of its first and of its last 2^k lines, 2^k <= q < 2^(k+1)
    width_of_q = F.lit(1)
    for i in range(1, len(levels)):
        width_of_q = F.when(F.col("q") >= 1 << i, 1 << i).otherwise(width_of_q)
    keyed = runs.withColumn("width", width_of_q).withColumn("tail_ln", F.col("start") + F.col("q") - F.col("width"))
    head = ranks.select("width", "doc", F.col("ln").alias("start"), "pos", F.col("rank").alias("head"))
    tail = ranks.select("width", "doc", F.col("ln").alias("tail_ln"), F.col("rank").alias("tail"))
    found = written(keyed.join(head, ["width", "doc", "start"]).join(tail, ["width", "doc", "tail_ln"])
                    .select("doc", "start", "q", "pos", "head", "tail"), "intervals")
    first = written(found.groupBy("q", "head", "tail").agg(F.min("pos").alias("least")), "first")
    later = found.join(first, ["q", "head", "tail"]).filter("pos > least").select(
        "doc", "start", (F.col("start") + F.col("q")).alias("end"))
    # overlapping and touching spans of a document become one
    w = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    return (fresh.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy("doc", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
               removed_col: str | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from the text column;
    ``removed_col`` adds the number of deleted lines."""
    need(docs, id_col, text_col)
    prepare(docs.sparkSession)
    spans = (repeated_runs(docs, id_col, text_col, min_words)
             .groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`")
    doc = _doc_key(F.col(f"row.`{id_col}`").cast("long"), F.coalesce(text.cast("string"), F.lit("")))
    out = row.withColumn("doc", doc).join(spans, "doc", "left")
    lines = F.split(text, "\n", -1)
    n = F.size("spans")
    # the kept stretches lie between the spans
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(
        lines,
        F.when(i == 0, 0).otherwise(F.col("spans")[F.greatest(i - 1, F.lit(0))]["end"]) + 1,
        F.when(i == n, F.size(lines)).otherwise(F.col("spans")[F.least(i, n - 1)]["start"])
        - F.when(i == 0, 0).otherwise(F.col("spans")[F.greatest(i - 1, F.lit(0))]["end"]))))
    new = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(kept, "\n"))
    cols = [(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    if removed_col:
        cols.append(F.coalesce(F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"]), F.lit(0)).alias(removed_col))
    return out.select(*cols)
