"""WARC archives as a PySpark data source: ``spark.read.format("warc")``, ``df.write.format("warc")``.

Reading plans one input partition per stretch of an archive file (the driver lists files, no more).  Archives are gzip members,
one per record, with a side index (``.idx``) of member offsets, record types and targets; a
file without an index is one partition.  Predicates on ``warc_type`` and on header columns are
pushed down: the index drops records without touching the archive, the parsed header drops the
rest, and payload bytes are decoded only for records that pass and only if the ``payload``
column is asked for (option ``payload``, default true): otherwise a member is inflated up to
the end of its header.

Writing: every task writes its own files through the shared folder's file system and names
them on commit; a lost or repeated attempt leaves nothing under a final name.

``dedup_payloads`` turns pages into records: of equal payloads the record with the largest id
is a response, the others are revisits that refer to it.  Equality is SHA-1, SHA-256 and length
of the payload bytes; the largest id per digest comes from a partial aggregation, so a payload
that a third of all pages have is one buffer per task.

Defined results: null payload is the empty payload; null ids are kept and never named by a
revisit unless all ids of the group are null; rows that
repeat the largest id with one payload are all responses.  Control characters and white space at
the ends of a URL (or any other header value) are percent-encoded in the header, and the value as
it was stands beside it and is what a reader gets.  An empty table writes an archive folder without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

from . import files
from .common import need, prepare, shared_path, written

FILE_BYTES = 64 << 20       # an archive file is closed once it holds this many bytes
SPLIT_BYTES = 16 << 20      # compressed bytes of an input partition, about
MIN_PAYLOAD = 0             # payloads of at least so many bytes are compared
# fixed values of the WARC format
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
DATE = "2000-01-01T00:00:00Z"      # pages hold no date of their own
SCHEMA = ("warc_type string, record_id string, target_uri string, date string, payload_digest string, "
          "refers_to string, payload_length long, content_length long, payload binary")
#: Column -> header that it is read from; these columns take pushed-down equality and IN.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
INDEXED = ("warc_type", "target_uri")
EXACT = "X-Exact-"          # before the name of a header whose value had to be encoded: the value itself


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- records -------------------------------------------------------------------------------------

def header_value(value: str) -> str:
    """The value as a header can hold it: control characters, and white space at its ends, are
    percent-encoded."""
    inner = len(value.lstrip()), len(value.rstrip())
    lo, hi = len(value) - inner[0], inner[1]
    return "".join(quote(c, safe="") if i < lo or i >= hi or unicodedata.category(c) in ("Cc", "Zl", "Zp") else c for i, c in enumerate(value))


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A record; a value that had to be encoded stands in a header of its own as well, as it was."""
    lines = ""
    for k, v in headers.items():
        if v is not None:
            plain = header_value(v)
            lines += f"{k}: {plain}\r\n"
            if plain != v:
                lines += f"{EXACT}{k}: {base64.b64encode(v.encode()).decode()}\r\n"
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http_block(payload: bytes | None, length: int) -> bytes:
    """HTTP response message; a revisit has its header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return head.encode() + (payload or b"")


def member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields of a record; the version line must come first, folded lines are joined."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, v = line.split(":", 1)
            last = last.strip().lower()
            out[last] = v.strip()
    return out


class _Inflater:
    """One record of a stretch of bytes: inflates only as far as it is asked to."""

    STEP = 1 << 13

    def __init__(self, data: memoryview, at: int, packed: bool):
        self.data, self.at, self.packed = data, at, packed
        self.z = zlib.decompressobj(31) if packed else None
        self.out = bytearray()

    def more(self, want: int) -> bool:
        """Have ``want`` bytes of the record, if it has so many."""
        while len(self.out) < want:
            if not self.packed:
                chunk = bytes(self.data[self.at:self.at + max(self.STEP, want - len(self.out))])
                if not chunk:
                    return False
                self.out += chunk
                self.at += len(chunk)
                continue
            if self.z.eof:
                return False
            chunk = self.z.unconsumed_tail or bytes(self.data[self.at:self.at + self.STEP])
            if not self.z.unconsumed_tail:
                self.at += len(chunk)
            if not chunk:
                return False
            self.out += self.z.decompress(chunk, self.STEP * 4)
        return True

    def header(self) -> bytes | None:
        n = 0
        while (end := self.out.find(b"\r\n\r\n", max(0, n - 3))) < 0:
            n = len(self.out)
            if not self.more(n + 1):
                if not bytes(self.out).strip():
                    return None
                raise ValueError("a record ends inside its header")
        return bytes(self.out[:end])

    def http_header(self, start: int, size: int) -> int:
        """Length of the HTTP header at the start of a block (0 if it has none)."""
        n = start
        while (end := self.out.find(b"\r\n\r\n", max(start, n - 3), start + size)) < 0:
            n = len(self.out)
            if n >= start + size or not self.more(n + 1):
                return 0
        return end + 4 - start

    def skip(self, record_end: int) -> int:
        """Position after the record (the compressed rest is inflated, but not kept)."""
        if not self.packed:
            return self.at - len(self.out) + record_end
        while not self.z.eof:
            chunk = self.z.unconsumed_tail or bytes(self.data[self.at:self.at + self.STEP])
            if not self.z.unconsumed_tail:
                self.at += len(chunk)
            if not chunk:
                raise ValueError("a record ends inside its block")
            self.z.decompress(chunk, self.STEP * 8)
        return self.at - len(self.z.unused_data)


def scan(data: memoryview, wanted: dict[str, set], payload: bool, offsets: list[int] | None = None) -> Iterator[tuple]:
    """Records of a stretch of whole records (members one by one, or plain), as rows of ``SCHEMA``.
    ``wanted``: allowed values of header columns; ``offsets``: the records to look at."""
    at, queue = 0, None if offsets is None else iter(offsets)
    while True:
        if queue is not None:
            at = next(queue, -1)
            if at < 0:
                return
        if at >= len(data):
            return
        r = _Inflater(data, at, bytes(data[at:at + 2]) == b"\x1f\x8b")
        head = r.header()
        if head is None:
            return
        h = parse_headers(head)
        if not h.get("content-length", "").isdigit():
            raise ValueError(f"the record at byte {at} has no length")
        size = int(h["content-length"])
        row = {c: h.get(name.lower()) for c, name in HEADERS.items()}
        for c, name in HEADERS.items():
            exact = h.get((EXACT + name).lower())
            if exact is not None:
                row[c] = base64.b64decode(exact).decode()
        body = len(head) + 4
        if all(row[c] in values for c, values in wanted.items()):
            lead = r.http_header(body, size) if h.get("content-type", "").startswith("application/http") else 0
            given, block = h.get("x-payload-length"), None
            if payload:
                if not r.more(body + size):
                    raise ValueError("a record ends inside its block")
                block = bytes(r.out[body + lead:body + size])
            yield (*row.values(), int(given) if given is not None else size - lead, size, block)
        if queue is None:
            at = r.skip(body + size + 4)


# -- data source -----------------------------------------------------------------------------------

@dataclass
class Stretch(InputPartition):
    path: str
    start: int        # records that begin in start..end, by the index
    end: int
    indexed: bool


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                c = f.attribute[0]
                self.wanted[c] = self.wanted[c] & values if c in self.wanted else values
            else:
                yield f

    def partitions(self):
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        base = self.options["path"]
        out: list[Stretch] = []
        names = dict(files.listing(base, ".warc.gz") + files.listing(base, ".warc"))
        indexes = {p for p, _ in files.listing(base, ".idx")}
        for path, size in sorted(names.items()):
            uri = base.rstrip("/") + "/" + path.rsplit("/", 1)[1]
            indexed = path + ".idx" in indexes
            step = split if indexed else max(size, 1)
            out += [Stretch(uri, at, min(at + step, size), indexed) for at in range(0, size, step)]
        return out or [Stretch("", 0, 0, False)]

    def _scanned(self, data, path, start, payload, offsets):
        try:
            yield from scan(data, self.wanted, payload, offsets)
        except ValueError as e:
            raise ValueError(f"{path}, from byte {start}: {e}") from e

    def read(self, partition: Stretch):
        if not partition.path:
            return
        start, end, offsets = partition.start, partition.end, None
        if partition.indexed:
            # the file's own index (a file is closed at a fixed size) tells what to skip unread
            entries = [json.loads(x) for x in files.get(partition.path + ".idx").splitlines()]
            ends = [*(x["at"] for x in entries[1:]), None]
            mine = [(e["at"], z) for e, z in zip(entries, ends) if start <= e["at"] < end
                    and all(e.get(c) in v for c, v in self.wanted.items() if c in INDEXED)]
            if not mine:
                return
            start, end = mine[0][0], mine[-1][1]
            offsets = [at - start for at, _ in mine]
        fs, path = files.filesystem(partition.path)
        with fs.open_input_file(path) as f:
            data = memoryview(f.read_at((f.size() if end is None else end) - start, start))
        payload = str(self.options.get("payload", "true")).lower() == "true"
        rows, held = [], 0
        for row in self._scanned(data, partition.path, start, payload, offsets):
            rows.append(row)
            held += len(row[-1] or b"")
            if len(rows) == 2000 or held > 16 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()),
                    ("content_length", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of ``SCHEMA`` (``payload`` is the record's block)."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.file_bytes = options["path"].rstrip("/"), int(options.get("filebytes", FILE_BYTES))
        self.pending, self.overwrite = f"{self.folder}/_pending", overwrite

    def write(self, batches):
        names, parts, index, size = [], [], [], 0
        task = uuid.uuid4().hex

        def close():
            nonlocal parts, index, size
            name = f"part-{task}-{len(names):05d}.warc.gz"
            files.put(f"{self.pending}/{name}", b"".join(parts))
            files.put(f"{self.pending}/{name}.idx", "\n".join(map(json.dumps, index)).encode())
            names.append(name)
            parts, index, size = [], [], 0
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                v = {n: c[i].as_py() for n, c in cols.items()}
                head = {name: v.get(c) for c, name in HEADERS.items()}
                head |= {"X-Payload-Length": str(v["payload_length"]), "Content-Type": HTTP_TYPE}
                if v["warc_type"] == "revisit":
                    head["WARC-Profile"] = REVISIT_PROFILE
                m = member(record_bytes(head, http_block(v["payload"], v["payload_length"])))
                index.append({"at": size, **{c: v.get(c) for c in INDEXED}})
                parts.append(m)
                size += len(m)
                if size >= self.file_bytes:
                    close()
        if parts:
            close()
        return Written(names)

    def commit(self, messages):
        fs, folder = files.filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for old, _ in files.listing(self.folder, ".warc.gz") + files.listing(self.folder, ".idx"):
                fs.delete_file(old)
        for m in messages:
            for name in m.names if m else []:
                # the index first: an archive never stands under its name without it
                fs.move(f"{folder}/_pending/{name}.idx", f"{folder}/{name}.idx")
                fs.move(f"{folder}/_pending/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, pending = files.filesystem(self.pending)
        if fs.get_file_info(pending).type == pafs.FileType.Directory:
            fs.delete_dir(pending)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# -- pages to records and back ------------------------------------------------------------------------



def _base32(hexed: pd.Series) -> pd.Series:
    return hexed.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())


base32_of_hex = F.pandas_udf(_base32, T.StringType())


def dedup_payloads(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                   min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Rows of the writer's schema, one per page."""
    need(pages, id_col, uri_col, payload_col)
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{uri_col}`").cast("string").alias("uri"),
                     payload.alias("payload"))
    keyed = p.select("id", "uri", "payload", F.sha1("payload").alias("h1"), F.sha2("payload", 256).alias("h2"),
                     F.length("payload").cast("long").alias("n"))
    # written, so that the join below is one of two plain exchanges, split at a hot digest
    first = written(keyed.filter(F.col("n") >= min_payload).groupBy("h1", "h2", "n").agg(F.max("id").alias("top")), "payloads")
    j = keyed.join(first, ["h1", "h2", "n"], "left")
    revisit = F.coalesce(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return j.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"), urn(F.col("id")).alias("record_id"),
        F.col("uri").alias("target_uri"), F.lit(DATE).alias("date"),
        F.concat(F.lit("sha1:"), base32_of_hex("h1")).alias("payload_digest"),
        F.when(revisit, urn(F.col("top"))).alias("refers_to"), F.col("n").alias("payload_length"),
        F.lit(None).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_archive(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    register(records.sparkSession)
    records.write.format("warc").option("filebytes", file_bytes).mode("append").save(folder)


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def page_records(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Write ``pages`` as an archive and read it back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url``.  Responses are measured on the payloads read back; revisits
    are read by their headers alone."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or shared_path(spark, "warc")
    write_archive(dedup_payloads(pages, **how), folder)
    page = lambda c: F.regexp_extract(c, "x-page:(-?[0-9]*)>", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    full = read_archive(spark, folder).filter(F.col("warc_type") == "response").select(
        number(F.col("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"), F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.col("target_uri").alias("url"))
    brief = read_archive(spark, folder, payload=False).filter(F.col("warc_type") == "revisit").select(
        number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"), F.col("target_uri").alias("url"))
    return full.unionByName(brief)
