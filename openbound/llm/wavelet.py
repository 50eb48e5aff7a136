"""Token-ID output: one wavelet matrix file per shard.

Documents are range-partitioned by id and tokenised; every task cuts its ids into shards and
writes each as one file: a document table and the shard's wavelet matrix.  The matrix holds
one bit-plane per bit of the id, highest first; each plane has the ids in the order that the
stable partitions by the planes above leave, with the counts of ones before every 512 bits.
Planes and counts are compressed one by one.  Access, rank, select, counting and the look-up
of occurrences read a few words of each plane and never the plain ids.

File: ``WMX1``, the header's length (unsigned 32-bit, little-endian), a JSON header, then the
parts named in it, each compressed by zstd.

Defined results: null text is the empty text, which gives the end id alone.  Null ids come
first; rows with equal ids are ordered by a hash of their text.  An empty table gives no
shards and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import need, prepare, shared_path, written
from .tokens import encoder, ship_tokenizer

# fixed value of the query contract
END_ID = 2
SHARD_TOKENS = 1 << 20     # a shard ends with the document that reaches this many ids
BLOCK = 512                # bits between two stored counts of ones
MAGIC = b"WMX1"
MANIFEST = "part int, shard int, path string, part_start long, n_tokens long, n_docs long"


class Plane:
    """One bit-plane with rank and select."""

    def __init__(self, words: np.ndarray, ones_before: np.ndarray, n: int):
        self.words, self.before, self.n = words, ones_before, n

    @classmethod
    def build(cls, bits: np.ndarray) -> "Plane":
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-max(n, 1) // BLOCK) * BLOCK // 8, np.uint8)
        padded[:len(packed)] = packed
        words = padded.view(np.uint64)
        per = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return cls(words, np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)]), n)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        return int(self.words[i >> 6]) >> (i & 63) & 1

    def ones(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        b = i // BLOCK
        n, w = int(self.before[b]), i >> 6
        for j in range(b * BLOCK >> 6, w):
            n += int(self.words[j]).bit_count()
        if i & 63:
            n += (int(self.words[w]) & ((1 << (i & 63)) - 1)).bit_count()
        return n

    def place(self, k: int, one: bool) -> int:
        """Position of the ``k``-th (from 0) one or zero bit."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            seen = self.ones(mid + 1) if one else mid + 1 - self.ones(mid + 1)
            lo, hi = (mid + 1, hi) if seen <= k else (lo, mid)
        return lo


class WaveletMatrix:
    """Sequence of non-negative integers below ``2 ** levels``, one bit-plane per bit."""

    def __init__(self, planes, zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> "WaveletMatrix":
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            ones = (a & a.dtype.type(1 << level)) != 0
            planes.append(Plane.build(ones))
            low = a.compress(~ones)
            zeros.append(len(low))
            a = np.concatenate([low, a.compress(ones)])
        return cls(planes, zeros, len(ids))

    def decode(self) -> np.ndarray:
        """The whole sequence: the planes are undone from the lowest up."""
        levels = len(self.planes)
        a = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for i in range(levels - 1, -1, -1):
            ones = self.planes[i].bits()
            up = np.empty_like(a)
            up[np.flatnonzero(~ones)] = a[:self.zeros[i]]
            up[np.flatnonzero(ones)] = a[self.zeros[i]:] | a.dtype.type(1 << (levels - 1 - i))
            a = up
        return a.astype(np.uint32)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, zeros in zip(self.planes, self.zeros):
            one = plane.bit(i)
            value = value << 1 | one
            i = zeros + plane.ones(i) if one else i - plane.ones(i)
        return value

    def _interval(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where positions ``lo..hi`` that hold ``value`` stand below the lowest plane."""
        if value >> len(self.planes):
            return 0, 0
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            a, b = plane.ones(lo), plane.ones(hi)
            one = value >> (len(self.planes) - 1 - level) & 1
            lo, hi = (zeros + a, zeros + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` places."""
        lo, hi = self._interval(value, 0, i)
        return hi - lo

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._interval(value, min(lo, hi), hi)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``value``."""
        lo, hi = self._interval(value, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(value >> (len(self.planes) - 1 - level) & 1)
            i = self.planes[level].place(i - self.zeros[level] if one else i, one)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def dump(ids: np.ndarray, levels: int, doc_ids: list, lengths: list[int], extra: dict | None = None) -> bytes:
    """A shard file's bytes."""
    wm = WaveletMatrix.build(ids, levels)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], bool)
    parts = {"known": np.packbits(known), "docs": np.array([d or 0 for d in doc_ids], "<i8"), "lengths": np.array(lengths, "<i8")}
    for i, p in enumerate(wm.planes):
        parts[f"plane{i}"], parts[f"ones{i}"] = p.words, p.before
    blobs = {k: squeeze(np.ascontiguousarray(v).tobytes()) for k, v in parts.items()}
    at, where = 0, {}
    for k, v in blobs.items():
        where[k] = [at, len(v)]
        at += len(v)
    head = json.dumps({"n": wm.n, "levels": levels, "zeros": wm.zeros, "n_docs": len(doc_ids), "parts": where, **(extra or {})}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(blobs.values())


class Shard:
    """A shard file: header at once, every part when it is first needed."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        n = int.from_bytes(data[4:8], "little")
        self.head, self.data = json.loads(data[8:8 + n]), memoryview(data)[8 + n:]
        self._wm = None

    def part(self, name: str, dtype: str) -> np.ndarray:
        at, size = self.head["parts"][name]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[at:at + size]), dtype)

    @property
    def matrix(self) -> WaveletMatrix:
        if self._wm is None:
            planes = [Plane(self.part(f"plane{i}", "<u8"), self.part(f"ones{i}", "<u4"), self.head["n"])
                      for i in range(self.head["levels"])]
            self._wm = WaveletMatrix(planes, self.head["zeros"], self.head["n"])
        return self._wm

    def documents(self) -> list[tuple]:
        """``(doc_id, start in the shard, n_tokens)``."""
        n = self.head["n_docs"]
        known = np.unpackbits(self.part("known", "u1"), count=n)
        lengths = self.part("lengths", "<i8")
        starts = np.cumsum(lengths) - lengths
        return [(int(d) if k else None, int(s), int(m)) for d, k, s, m in zip(self.part("docs", "<i8"), known, starts, lengths)]


def _write(shipped, folder: str, end_id: int, shard_tokens: int):
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc = encoder(shipped)
        levels = max(enc.tok.get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
        part = TaskContext.get().partitionId()
        docs, raws, n, start, shard = [], [], 0, 0, 0
        rows = []

        def flush():
            nonlocal docs, raws, n, start, shard
            path = f"{folder}/part-{part:06d}-{shard:06d}.wmx"
            ids = np.frombuffer(b"".join(raws), "<u4")
            files.put(path, dump(ids, levels, docs, [len(r) // 4 for r in raws], {"part": part, "shard": shard, "start": start}))
            rows.append((part, shard, path, start, n, len(docs)))
            start, shard, docs, raws, n = start + n, shard + 1, [], [], 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo in range(0, len(ids), 2048):
                for doc_id, raw in zip(ids[lo:lo + 2048], enc.encode(texts[lo:lo + 2048])):
                    docs.append(doc_id)
                    raws.append(raw + tail)
                    n += len(raw) // 4 + 1
                    if n >= shard_tokens:
                        flush()
        if docs:
            flush()
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["part", "shard", "path", "part_start", "n_tokens", "n_docs"])
    return run


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shard files of ``docs`` in ascending id order; returns the manifest (a written
    table) ``part, shard, path, part_start, n_tokens, n_docs``."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = (src.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h")
               .sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    run = _write(ship_tokenizer(spark, tokenizer), folder, end_id, shard_tokens)
    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def _read(batches):
    for b in batches:
        for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            shard = Shard(files.get(path))
            raw = memoryview(shard.matrix.decode().astype("<u4").tobytes())
            rows = [(d, base + s, n, zlib.crc32(raw[4 * s:4 * (s + n)])) for d, s, n in shard.documents()]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files.

    The driver sees one number per writing partition (its ids), for the starts of the parts."""
    spark = manifest.sparkSession
    totals = {r[0]: r[1] for r in manifest.groupBy("part").agg(F.sum("n_tokens")).collect()}
    base, bases = 0, []
    for part in sorted(totals):
        bases.append((part, base))
        base += totals[part]
    starts = spark.createDataFrame(bases, "part int, base long")
    todo = manifest.join(starts, "part").select("path", (F.col("base") + F.col("part_start")).alias("base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return todo.repartition(parts, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, **how) -> DataFrame:
    """Write the shards (below the shared folder unless ``folder`` is given) and read them back."""
    prepare(docs.sparkSession)
    return read_shards(write_shards(docs, folder or shared_path(docs.sparkSession, "shards"), id_col, text_col, **how))
