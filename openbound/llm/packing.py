"""Best-fit packing: bin completion branch-and-bound over the histogram of lengths.

Documents are tokenised and those longer than a sequence are cut (the first piece takes the
remainder).  How the lengths are combined depends only on how many pieces there are of each
length, so the search runs on that histogram: at most ``capacity`` numbers, whatever the
corpus holds.  Bin completion takes the largest length left, lists fillings of the space beside
it, drops the dominated ones (a filling is dominated if another of the list holds each of its
parts, or a sum of them, in one of its own), and branches on them, least waste first.  A filling
is used for as many sequences at once as the counts allow.  Branches whose bins so far plus the
waste bound of the rest reach the incumbent are pruned.

The search is a beam, not an enumeration: a level of a filling tries ``BRANCH`` lengths, a
filling branches on ``PARTS`` parts and best fit fills the rest, about ``20 * BRANCH`` tries give
``BRANCH`` fillings at most, and ``NODES`` nodes are taken from the stack in all; what is left
on it then is given up.  Best-fit decreasing gives the first incumbent and completes every 16th
node that is taken, so the result is never worse than best fit, but it need not be the optimum;
the search ends early when an incumbent meets the bound.

Pieces get their place in parallel: the r-th piece of a length goes to the r-th slot of that
length.  Ranks come from counts per (length, salt) cell and row numbers inside a cell, so a
length that a third of all pieces have is never in one task.

Defined results: null text is the empty text, one end id long.  Repeated rows are separate
documents, null ids are kept.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, prepare, written
from .tokens import encoder, ship_tokenizer

# fixed values of the query contract
CAPACITY, END_ID = 1024, 2
NODES = 3000           # fillings tried by the search before the incumbent is taken
BRANCH = 6             # fillings tried for one largest length
PARTS = 4              # lengths beside the largest that a branching filling may have
CELL_ROWS = 1000       # pieces in one rank cell, on average, at most
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: the first takes the remainder."""
    first = (n - 1) % capacity + 1 if n else 0
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def _pieces(shipped, end_id: int, capacity: int, with_ids: bool):
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc = encoder(shipped)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()])):
                raw += tail
                for i, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * s:4 * (s + n)]
                    rows.append((doc_id, i, s, n, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)``: the token pieces of every row
    (``ids``: little-endian unsigned 32-bit, only if asked for)."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_pieces(ship_tokenizer(spark, tokenizer), end_id, capacity, with_ids), PIECE_SCHEMA)


# -- the search ------------------------------------------------------------------------------

def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each threshold k, lengths over ``capacity - k`` stand
    alone, other lengths over half a sequence need one each, and what the lengths from k to a
    half exceed the room beside those is divided by the capacity."""
    n_of = np.zeros(capacity + 1, np.int64)
    n_of[list(counts)] = list(counts.values())
    upto, mass = np.cumsum(n_of), np.cumsum(n_of * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    wide = upto[-1] - upto[half]                     # one sequence each, over capacity - k or not
    room = (upto[capacity - k] - upto[half]) * capacity - (mass[capacity - k] - mass[half])
    small = mass[half] - np.where(k > 0, mass[k - 1], 0)
    return int((wide + np.maximum(0, -((room - small) // capacity))).max(initial=0))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: ``(lengths in one sequence, number of such sequences)``."""
    open_by_room: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []              # sorted rooms that have open bins
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_right(rooms, s - 1)
            if i == len(rooms):
                per = min(left, capacity // s)
                n = left // per
                bins, room, pattern = {(s,) * per: n}, capacity - s * per, (s,) * per
                left -= n * per
            else:
                room = rooms[i]
                bins = open_by_room[room]
                pattern, have = next(iter(bins.items()))
                n = min(left, have)
                if n == have:
                    del bins[pattern]
                else:
                    bins[pattern] = have - n
                if not bins:
                    del open_by_room[room]
                    rooms.pop(i)
                left -= n
                pattern, room = pattern + (s,), room - s
            there = open_by_room.setdefault(room, {})
            if not there and room not in rooms:
                rooms.insert(bisect_right(rooms, room), room)
            there[pattern] = there.get(pattern, 0) + n
    return [(p, n) for bins in open_by_room.values() for p, n in bins.items()]


def _dominates(a: tuple, b: tuple) -> bool:
    """Every part of ``b`` fits, in groups, into parts of ``a``."""
    if sum(b) > sum(a):
        return False
    if not b:
        return True
    x = b[0]
    for i, y in enumerate(a):
        if y >= x and (i == 0 or a[i - 1] != y):
            rest = tuple(sorted(a[:i] + a[i + 1:] + ((y - x,) if y > x else ()), reverse=True))
            if _dominates(rest, b[1:]):
                return True
    return False


def _best_tail(counts: dict[int, int], sizes: list[int], falling: list[int], pattern: tuple, left: int) -> tuple:
    """Largest lengths first into what is left beside ``pattern``."""
    tail: tuple[int, ...] = ()
    i = bisect_left(falling, -left)
    while i < len(sizes) and left:
        s = sizes[i]
        n = min(left // s, counts[s] - pattern.count(s))
        tail += (s,) * n
        left -= n * s
        i = max(i + 1, bisect_left(falling, -left))
    return tail


def fillings(counts: dict[int, int], room: int, branch: int = BRANCH, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths left, least waste first (``branch`` at most)."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    if not sizes:
        return [()]
    found: list[tuple[int, ...]] = []
    tries = 0

    falling = [-x for x in sizes]

    def grow(pattern: tuple, left: int, lo: int):
        nonlocal tries
        tries += 1
        i = max(lo, bisect_left(falling, -left))
        fits = []
        while i < len(sizes) and len(fits) < branch:
            if counts[sizes[i]] > pattern.count(sizes[i]):
                fits.append(i)
            i += 1
        if not fits or len(pattern) == parts:
            # what the branching leaves open is filled by best fit
            found.append(pattern if not fits else pattern + _best_tail(counts, sizes, falling, pattern, left))
            return
        for i in fits:
            if tries > 20 * branch:
                return
            grow(pattern + (sizes[i],), left - sizes[i], i)
            if sizes[i] == left:       # an exact part dominates every other way to use this space
                break
    grow((), room, 0)
    found = sorted(set(found), key=lambda p: (-sum(p), len(p)))
    out: list[tuple[int, ...]] = []
    for p in found:
        if not any(_dominates(q, p) for q in out):
            out.append(p)
        if len(out) == branch:
            break
    return out


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their number of sequences, as few sequences as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must lie in 1..capacity")
    bound = waste_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    done, tried = [], 0
    # depth first; an entry holds what is left, the patterns chosen and their number
    stack = [(counts, (), 0)]
    while stack and best_n > bound and tried < nodes:
        left, chosen, used = stack.pop()
        tried += 1
        if not left:
            if used < best_n:
                best_n, best = used, _unroll(chosen)
            continue
        if used + waste_bound(left, capacity) >= best_n:
            continue
        if tried % 16 == 1:             # complete the branch by best fit: a new incumbent, perhaps
            done = best_fit(left, capacity)
            if used + sum(n for _, n in done) < best_n:
                best, best_n = _unroll(chosen) + done, used + sum(n for _, n in done)
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        for fill in reversed(fillings(rest, capacity - top)):
            pattern = (top, *fill)
            n = min(left[s] // pattern.count(s) for s in set(pattern))
            after = {s: c - n * pattern.count(s) for s, c in left.items()}
            stack.append(({s: c for s, c in after.items() if c}, (chosen, (pattern, n)), used + n))
    return best


def _unroll(chosen: tuple) -> list:
    out = []
    while chosen:
        chosen, last = chosen
        out.append(last)
    return out[::-1]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, ranks, sequence base, parts, offset)``: ranks ``r`` of a length go to
    sequence ``base + k // parts`` at ``offset + (k % parts) * length``, ``k = r - first rank``."""
    nxt: dict[int, int] = {}
    out, base = [], 0
    for pattern, n in patterns:
        offset, i = 0, 0
        while i < len(pattern):
            s = pattern[i]
            m = 1
            while i + m < len(pattern) and pattern[i + m] == s:
                m += 1
            out.append((s, nxt.get(s, 0), n * m, base, m, offset))
            nxt[s] = nxt.get(s, 0) + n * m
            offset += s * m
            i += m
        base += n
    return out


def pack(items: DataFrame, order: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``items`` (a written table) with ``sequence_id`` and ``offset``; ``order`` are columns that
    spread and order items of one length.  The histogram of lengths, at most ``capacity`` rows,
    and its slots, bounded by the search's patterns, are all that the driver sees."""
    spark = items.sparkSession
    hist = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}
    found = slots(bin_completion(hist, capacity))
    table = F.broadcast(spark.createDataFrame(
        found, "slot_length long, slot_first long, slot_ranks long, slot_base long, slot_parts long, slot_offset long"))
    salts = spark.createDataFrame([(s, max(1, n // CELL_ROWS)) for s, n in hist.items()], "__size long, __salts long")
    salted = (items.join(F.broadcast(salts), F.col(length_col) == F.col("__size"))
              .withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts"))))
    cells = salted.groupBy(F.col(length_col).alias("__len"), F.col("__salt").alias("__cell")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__len").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__len", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(length_col, "__salt").orderBy(*order)
    ranked = (salted.withColumn("__rn", F.row_number().over(inside) - 1)
              .join(written(cells, "cells"), (F.col(length_col) == F.col("__len")) & (F.col("__salt") == F.col("__cell")))
              .withColumn("__k", F.col("__before") + F.col("__rn")))
    placed = ranked.join(table, (F.col(length_col) == F.col("slot_length")) & (F.col("__k") >= F.col("slot_first"))
                         & (F.col("__k") < F.col("slot_first") + F.col("slot_ranks")))
    k = F.col("__k") - F.col("slot_first")
    return placed.select(*[F.col(f"`{c}`") for c in items.columns],
                         (F.col("slot_base") + F.floor(k / F.col("slot_parts"))).cast("long").alias("sequence_id"),
                         (F.col("slot_offset") + (k % F.col("slot_parts")) * F.col(length_col)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and
    ``ids`` if asked for)."""
    made = pieces(docs, id_col, text_col, tokenizer, end_id, capacity, with_ids)
    if not with_ids:
        made = made.drop("ids")
    rows = written(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(rows, ["row"], "length", capacity).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences (pieces packed with their ids); a sequence has
    ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
