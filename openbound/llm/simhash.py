"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact Hamming check.

Fingerprint: ASCII letters are lower-cased, words are runs of non-white-space, features are
the XXH64 (seed 42) of every k-word shingle; bit i is set if more than half of the features
have it.  A fingerprint of 64 bits is embedded as the bit counts of its 2-bit segments.  The
Manhattan distance of two embeddings is a lower bound of their Hamming distance, so pairs
within ``max_bits`` lie within that range of each other on the grid of bit counts.  The axes
are dealt into ``2 * max_bits`` blocks: at most ``max_bits`` blocks differ, so a pair shares
the grid cell of at least one choice of ``max_bits`` whole blocks.  Points that share a cell
are compared: first by the Manhattan bound over all axes, then exactly.

Only distinct fingerprints are joined (copies collapse first), and a cell gives a spanning
forest of its links, never all pairs.  A cell with more than ``CELL_ROWS`` points is cut into
blocks that meet two at a time, so no task holds a cell of unbounded size.

Defined results: null and empty texts have fingerprint zero and link like any other; a text
with fewer words than the shingle length is one shingle.  A null id gives a row, but never
names a component unless every id in it is null.  Repeated rows are ordinary members.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, prepare, written
from .components import connected_components

# fixed values of the query contract: shingle length, maximum bit distance, hash seed
SHINGLE, MAX_BITS, SEED = 3, 3, 42
CELL_ROWS = 1024
SEGMENT_MASK = 0x5555555555555555


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    for lo in range(0, n, 4096):
        hi = min(n, lo + 4096)
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[lo:hi], ends[lo + k - 1:hi + k - 1])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(k: int):
    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""
    need(docs, id_col, text_col)
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_fingerprints(k), "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments in unary (0 -> 00, 1 -> 01, 2 -> 11), packed in one
    word; the Manhattan distance of two embeddings is the bit count of their difference."""
    m = np.uint64(SEGMENT_MASK)
    hi = (fp >> np.uint64(1)) & m
    lo = fp & m
    return (lo | hi) | ((lo & hi) << np.uint64(1))


def _axis_blocks(n_blocks: int) -> list[int]:
    """Bit masks (over the packed embedding) of the blocks of axes."""
    cut = np.linspace(0, 32, n_blocks + 1).round().astype(int)
    return [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(cut, cut[1:])]


def cell_masks(max_bits: int) -> list[int]:
    """One mask per sub-grid: every choice of ``max_bits`` (at least one) of the blocks."""
    if max_bits == 0:
        return [(1 << 64) - 1]
    blocks = _axis_blocks(2 * max_bits)
    return [sum(c) for c in combinations(blocks, max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cells(points: DataFrame, max_bits: int) -> DataFrame:
    """``(grid, cell, fp)``: the cell of each point in every sub-grid (JVM expressions only)."""
    seg = F.lit(SEGMENT_MASK)
    one = F.col("fp").bitwiseAND(seg)
    two = F.shiftrightunsigned("fp", 1).bitwiseAND(seg)
    unary = one.bitwiseOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))
    keyed = points.select("fp", unary.alias("e"))
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("e").bitwiseAND(F.lit(_signed(m))).alias("cell"))
                      for i, m in enumerate(cell_masks(max_bits))])
    return keyed.select("fp", F.explode(grids).alias("g")).select("g.grid", "g.cell", "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Spanning forest of the links a-b (positions of rows)."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x
    keep_a, keep_b = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep_a.append(x)
            keep_b.append(y)
    return keep_a, keep_b


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int):
    """Spanning links among rows sorted by group: Manhattan bound first, then exact."""
    e = embed(fp)
    n = len(fp)
    later = np.searchsorted(key, key, "right") - np.arange(n) - 1    # later rows in the group
    rows = np.flatnonzero(later > 0)
    out_a, out_b, off = [rows[:0]], [rows[:0]], 1
    while len(rows):
        near = rows[np.bitwise_count(e[rows] ^ e[rows + off]) <= max_bits]
        close = near[np.bitwise_count(fp[near] ^ fp[near + off]) <= max_bits]
        out_a.append(close)
        out_b.append(close + off)
        off += 1
        rows = rows[later[rows] >= off]
    return _forest(np.concatenate(out_a), np.concatenate(out_b))


def _join(max_bits: int):
    """Rows come sorted by group; whole groups are compared, the last one waits for the next batch."""
    def run(batches):
        held = None

        def done(t):
            key = t[0]
            ka, kb = _links(key, t[1].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(t[1][ka]), pa.array(t[1][kb])], names=["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            t = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.searchsorted(t[0], t[0][-1], "left"))
            if last:
                yield done([x[:last] for x in t])
            held = [x[last:] for x in t]
        if held is not None:
            yield done(held)
    return run


def near_links(points: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(a, b)``: links that connect every two distinct fingerprints within ``max_bits``
    (a spanning forest per cell and block pair, so the transitive closure is exact)."""
    placed = written(cells(points, max_bits), "cells")
    big = (placed.groupBy("grid", "cell").count().filter(F.col("count") > cell_rows)
           .select("grid", "cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("nb")))
    # rows of a large cell go to the pair (own block, other block) for every other block
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb")).cast("int")
    dealt = (placed.join(big, ["grid", "cell"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
             .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select(F.xxhash64("grid", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "fp"))
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (dealt.repartition(parts, "g").sortWithinPartitions("g", "fp")
            .mapInArrow(_join(max_bits), "a long, b long").distinct())


def _components(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, c)``: the component of every distinct fingerprint."""
    if not 0 <= max_bits <= 8:
        raise ValueError("max_bits must lie in 0..8")
    points = written(fps.select("fp").distinct(), "points")
    if not max_bits:
        return points.withColumn("c", F.col("fp"))
    comp = connected_components(near_links(points, max_bits))
    return points.join(comp, points["fp"] == comp["id"], "left").select("fp", F.coalesce("component", "fp").alias("c"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest id reachable, itself included)."""
    fps = written(fingerprints(docs, id_col, text_col, k), "fp")
    named = written(_components(fps, max_bits), "named")
    least = named.join(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp").groupBy("c").agg(F.min("first").alias("component_id"))
    by_fp = written(named.join(least, "c").select("fp", "component_id"), "by_fp")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every group: the smallest id (null last), then the smallest text
    digest; of rows that repeat both, one."""
    need(docs, id_col, text_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.unhex(F.md5(F.concat_ws(":", F.md5(F.encode(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")), "UTF-8")),
                                    F.col(f"row.`{id_col}`").cast("string"))))
    keyed = row.withColumn("key", key)
    texts = keyed.select(F.struct(F.col(f"row.`{id_col}`").cast("long").alias("id"), "key").alias("doc"), F.col(f"row.`{text_col}`").alias("text"))
    prepare(docs.sparkSession)
    fps = written(texts.select("doc", F.col("text").cast("string")).mapInArrow(
        _fingerprints(k), "doc_id struct<id:bigint,key:binary>, fp long").select("doc_id.id", "doc_id.key", "fp"), "fp")
    order = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key"))
    first = fps.groupBy("fp").agg(order.alias("first"))
    stay = (written(_components(fps, max_bits), "named").join(first, "fp").groupBy("c").agg(F.min("first").alias("first"))
            .select(F.col("first.key").alias("key")).distinct())
    kept = keyed.join(written(stay, "stay"), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
