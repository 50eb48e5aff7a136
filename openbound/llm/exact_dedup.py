"""Exact dedup by content-defined chunk recipes.

A text is normalised (each run of ASCII white space becomes one space) and cut where a
rolling hash of its last 32 bytes has its low bits zero, so equal passages give equal chunks
wherever they stand.  A chunk's identifier is its SHA-256; every identifier is verified by
comparing the bytes of all its chunks.  Documents are then compared by their ordered
identifier lists: a document's bytes move once, into the chunk verification, where copies
already collapse in the tasks that read them.

Defined results: a null text is the empty text, whose recipe is the empty list (all empty
texts are equal).  A null id sorts after all others.  Of repeated rows with one id and equal
texts exactly one stays.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, prepare, written

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 1 << 10, 12, 1 << 16
SPACES = b"\t\n\v\f\r "
SCHEMA = "doc_id long, text_sha256 string, ids array<binary>, bodies array<binary>"


def _gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit words from a fixed rule."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


GEAR = _gear_table()


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with every run of ASCII white space as one space (ends kept)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return b
    head = b" " if b[0] in SPACES else b""
    body = b" ".join(b.split())
    return head + body + (b" " if body and b[-1] in SPACES else b"")


def boundaries(b: bytes, min_chunk: int = MIN_CHUNK, bits: int = MEAN_BITS, max_chunk: int = MAX_CHUNK) -> list[int]:
    """Chunk ends.  A cut depends only on the 32 bytes before it and on the cut before."""
    n = len(b)
    if n <= min_chunk:
        return [n] if n else []
    h = GEAR[np.frombuffer(b, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        # after the last round h[i] is the sum of GEAR[b[i-j]] << j for j < 32
        t = h.copy()
        t[step:] += h[:-step] << np.uint32(step)
        h = t
    cand = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    ends, last = [], 0
    for c in cand + [n]:
        while c - last > max_chunk:
            last += max_chunk
            ends.append(last)
        if c - last >= min_chunk or (c == n and c > last):
            ends.append(c)
            last = c
    return ends


def _chunk(batches):
    for batch in batches:
        cols: tuple[list, list, list, list] = ([], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            b = normalise(text.as_py())
            ids, bodies, last = [], [], 0
            for end in boundaries(b):
                body = b[last:end]
                ids.append(hashlib.sha256(body).digest())
                bodies.append(body)
                last = end
            for col, v in zip(cols, (doc_id, hashlib.sha256(b).hexdigest(), ids, bodies)):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
             pa.array(cols[2], pa.list_(pa.binary())), pa.array(cols[3], pa.list_(pa.binary()))],
            names=["doc_id", "text_sha256", "ids", "bodies"])


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, text_sha256, ids, bodies)``: the ordered chunks of every row, written to
    the shared folder; ``row`` numbers the rows of the written table."""
    need(docs, id_col, text_col)
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(src.mapInArrow(_chunk, SCHEMA).withColumn("row", F.monotonically_increasing_id()), "recipes")


def chunk_store(recipes: DataFrame) -> DataFrame:
    """``(id, body, copies, verified)``: each chunk once; ``verified`` says that all bodies under
    the identifier were equal byte for byte.  Copies collapse before the shuffle."""
    c = recipes.select(F.explode(F.arrays_zip("ids", "bodies")).alias("c"))
    return (c.groupBy(F.col("c.ids").alias("id"))
            .agg(F.min("c.bodies").alias("body"), F.max("c.bodies").alias("high"), F.count("*").alias("copies"))
            .select("id", "body", "copies", (F.col("body") == F.col("high")).alias("verified")))


def verify(recipes: DataFrame) -> None:
    """Raise if one identifier stands for two different chunks."""
    bad = chunk_store(recipes).filter(~F.col("verified")).select(F.hex("id")).head(1)
    if bad:
        raise ValueError(f"chunk identifier {bad[0][0]} stands for different chunks")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Groups are formed on the identifier lists themselves (partial aggregation, so a group of
    any size is one buffer per task).
    """
    recipes = chunk_recipes(docs, id_col, text_col)
    verify(recipes)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    groups = (recipes.groupBy("ids").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
              .select("ids", F.col("first.d").alias("keep_id"), F.col("first.r").alias("keep_row"), "group_size"))
    # written, so that the join is one of two plain exchanges, split at a group of many copies
    return (recipes.select("doc_id", "row", "text_sha256", "ids").join(written(groups, "groups"), "ids")
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    "text_sha256", F.size("ids").alias("n_chunks")))
