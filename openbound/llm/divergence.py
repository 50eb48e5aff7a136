"""Source divergence audit by Gustavson's row accumulation.

Every (language, source) group and every language gives each kept term of the language the weight
``p = 1 + floor(UNIT * (count + 2) / (N + 2V))``; two groups differ in a term by
``f = floor((p - q)^2 / (p + q))`` and in all by the sum over the V kept terms.  All arithmetic is in
whole numbers.

The matrix of terms by groups is sparse, the sum is not: a term that a group does not have still
weighs ``p0 = 1 + floor(2 UNIT / (N + 2V))``.  So for groups i and j the sum is split into

    V f(p0, q0)  +  sum over i's terms of f(p, q0) - f(p0, q0)  +  the same for j's terms
                 +  sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The last sum is Gustavson's: the term-major index (postings of groups by term) is cut into blocks
of whole terms; in a block each group scatters its terms through the postings into one dense
accumulator with a place for every peer, and only the accumulator leaves the task, never a pair of
postings.  The middle sums need no index: weights repeat, so a group's histogram of weights is
scattered over the peers' baselines.  Peers are taken in tiles of ``PEERS`` at most, so that what a
task holds is bounded however many groups there are.

Terms are counted in the map: texts are cut as bytes (all separators are ASCII), counted per group
and handed on whenever ``FLUSH`` entries are held.

Defined results: null text, language and source are ''.  A group without terms is a group; a
language without kept terms gives pairs of value 0.  Repeated rows count as often as they stand,
each a document of its own; ids are not read.  Other columns are ignored; an empty table gives an
empty result.  Ranks: value falling, then item by its UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, prepare, written

# fixed values of the query contract
UNIT, MIN_DOCS, TOP_TERMS = 1_000_000_000, 10, 10
FLUSH = 400_000        # counted entries a task holds
BLOCK = 500_000        # postings of a block of whole terms
PEERS = 20_000         # groups of a tile


def _cut_table() -> bytes:
    """A-Z to lower case, every other ASCII character but a-z to a space."""
    out = bytearray(range(256))
    for c in range(128):
        out[c] = c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32
    return bytes(out)


def _count(batches):
    """Term counts per group: ``lang, source, term, n, docs``."""
    table = _cut_table()
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, docs) in held.items():
            m = len(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()),
                pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()
    size = 0
    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, b.column(2)):
            raw = text.as_buffer().to_pybytes()
            terms = raw.translate(table).split()
            n, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size >= FLUSH:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of a term in a group."""
    src = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
                        for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = src.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # the map has combined its rows already: dealt out first, they are not hashed once more before the shuffle
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _weight(n: str, total: str, terms: str) -> Column:
    """``1 + floor(UNIT * (n + 2) / (total + 2 * terms))``, in long numbers while they hold it."""
    small = (1 << 63) // UNIT - 3
    return F.expr(f"CASE WHEN {n} < {small}L THEN 1L + ({UNIT}L * ({n} + 2L)) div ({total} + 2L * {terms}) "
                  f"ELSE 1L + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0)) END")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(p, q):
    d = p - q
    return d * d // (p + q)


# -- the accumulation -------------------------------------------------------------------------

ACC = "lang string, a int, b int, v long"


def _emit(lang: str, a: int, at: np.ndarray, acc: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), a, np.int32)),
                                       pa.array(at.astype(np.int32)), pa.array(acc[at].astype(np.int64))], names=["lang", "a", "b", "v"])


def _scatter(lang: str, ptr: np.ndarray, term: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray, lo: int, hi: int):
    """Postings of whole terms of one language in term order: a dense row of peers ``lo..hi-1`` for
    each group, zeros left out."""
    mine = np.argsort(group, kind="stable")
    ends = np.flatnonzero(np.diff(group[mine], append=-1))
    start = 0
    for end in ends + 1:
        rows = mine[start:end]
        start = end
        first, count = ptr[term[rows]], ptr[term[rows] + 1] - ptr[term[rows]]
        # positions of all postings of this group's terms
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        left = np.repeat(rows, count)
        peer = group[at]
        ok = (peer >= lo) & (peer < hi)
        at, left, peer = at[ok], left[ok], peer[ok]
        a, a0, b, b0 = p[left], p0[left], p[at], p0[at]
        # sums stay far below 2**53: weights of a group add up to about UNIT
        acc = np.bincount(peer - lo, weights=_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0), minlength=hi - lo)
        there = np.flatnonzero(acc)
        if len(there):
            out = np.zeros(hi, np.int64)
            out[lo:hi] = acc
            yield _emit(lang, int(group[rows[0]]), there + lo, out)


def _gustavson(tile: dict[str, tuple[int, np.ndarray]]):
    """``lang, term, g, p, p0`` sorted by language and term, in blocks of whole terms."""
    def block(t: pa.Table):
        langs = t.column("lang").combine_chunks().dictionary_encode()
        code = langs.indices.to_numpy()
        for c, lang in enumerate(langs.dictionary.to_pylist()):
            if lang not in tile:
                continue
            part = t.filter(pa.array(code == c))
            term = part.column("term").combine_chunks().dictionary_encode().indices.to_numpy()      # rising: terms stand together
            ptr = np.concatenate([np.flatnonzero(np.diff(term, prepend=-1)), [len(term)]])
            lo, base = tile[lang]
            yield from _scatter(lang, ptr, term, *[part.column(x).to_numpy() for x in ("g", "p", "p0")], lo, lo + len(base))

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                t = pa.Table.from_batches(held)
                # the last term may go on in the next batch
                lang, term = t.column("lang"), t.column("term")
                last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy()
                cut = int(np.argmax(last))
                if cut:
                    yield from block(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                rows = t.num_rows - cut
        if rows:
            yield from block(pa.Table.from_batches(held))
    return run


def _baselines(tile: dict[str, tuple[int, np.ndarray]]):
    """``lang, g, p, p0, m``: a group's weights and how many terms have them, against the peers'
    baselines."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            langs = b.column(0).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            group, p, p0, m = [b.column(i).to_numpy() for i in range(1, 5)]
            order = np.lexsort((group, code))
            new = (np.diff(code[order]) != 0) | (np.diff(group[order]) != 0)
            for mine in np.split(order, np.flatnonzero(new) + 1):
                lang = names[code[mine[0]]]
                if lang not in tile:
                    continue
                lo, base = tile[lang]
                acc = np.zeros(lo + len(base), np.int64)
                for r in np.array_split(mine, 1 + len(mine) * len(base) // 4_000_000):
                    acc[lo:] += ((_f(p[r][:, None], base) - _f(p0[r][:, None], base)) * m[r][:, None]).sum(axis=0)
                yield _emit(lang, int(group[mine[0]]), np.arange(lo, len(acc)), acc)
    return run


def _tiles(groups: DataFrame, n: int):
    """Baselines of at most ``PEERS`` groups at a time: language -> first number, baselines."""
    for lo in range(0, n, PEERS):
        rows = groups.filter((F.col("place") >= lo) & (F.col("place") < lo + PEERS)).select("lang", "g", "p0").collect()
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r["lang"], []).append((r["g"], r["p0"]))
        yield {lang: (min(x)[0], np.array([b for _, b in sorted(x)], np.int64)) for lang, x in by.items()}


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: ``pair`` rows against every other source of the
    language, ``term`` rows for the terms that a group uses more than its language."""
    need(docs, lang_col, source_col, text_col)
    spark = docs.sparkSession
    prepare(spark)
    counts = written(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    term = Window.partitionBy("lang", "term")
    kept = (counts.withColumn("df", F.sum("docs").over(term)).filter(F.col("df") >= min_docs)
            .withColumn("lang_n", F.sum("n").over(term))
            .withColumn("lead", F.row_number().over(term.orderBy("source")) == 1).select("lang", "term", "source", "n", "lang_n", "lead"))
    kept = written(kept, "terms-kept")

    every = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count(F.when(F.col("lead"), 1)).alias("terms"))
    groups = (every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own_n", "all_n", "terms"])
              .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
              .withColumn("p0", F.when(F.col("terms") > 0, _weight("0L", "own_n", "terms")).otherwise(1)))
    # one row per group; a language's rows stand together
    per_lang = written(groups.groupBy("lang").agg(F.count("*").alias("size")), "lang-sizes")
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    places = per_lang.select("lang", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("from"))
    groups = written(groups.join(places, "lang").withColumn("place", F.col("from") + F.col("g")).drop("from"), "groups")

    weighed = written(kept.join(groups.select("lang", "source", "g", "p0", "own_n", "all_n", "terms"), ["lang", "source"])
                      .withColumn("p", _weight("n", "own_n", "terms")).withColumn("q", _weight("lang_n", "all_n", "terms"))
                      .select("lang", "term", "source", "g", "p", "p0", "q"), "weighed")

    term_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = (weighed.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
            .withColumn("rank", F.row_number().over(term_rank)).filter(F.col("rank") <= top_terms))

    n_groups, n_postings = groups.count(), weighed.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_postings // BLOCK))
    index = (weighed.select("lang", "term", "g", "p", "p0").repartition(blocks, "lang", "term").sortWithinPartitions("lang", "term"))
    weights = weighed.groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("m"))
    rows = spark.createDataFrame([], ACC)
    for tile in _tiles(groups, n_groups):
        common = index.mapInArrow(_gustavson(tile), ACC)
        lone = weights.mapInArrow(_baselines(tile), ACC)
        rows = rows.unionByName(common).unionByName(lone).unionByName(
            lone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    sums = written(rows.groupBy("lang", "a", "b").agg(F.sum("v").alias("v")), "pair-sums")
    x = groups.select("lang", "source", F.col("g").alias("a"), F.col("p0").alias("pa"), "terms")
    y = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("p0").alias("pb"))
    pair_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (x.join(y, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
             .withColumn("value", F.col("terms") * _gap("pa", "pb") + F.coalesce("v", F.lit(0)))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(pair_rank)))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
