"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (rewrite rules, dummy prefix,
white space to U+2581), the lexicon (a path of characters for every piece, emitting its id;
characters without a piece emit their byte pieces) and, for merge models, a bigram acceptor
over pieces.  A text is encoded by composing it with them and taking the shortest path in the
tropical semiring.

* Unigram models weigh a piece by its negated score; the best path is found position by position.
* Merge (BPE) models weigh all arcs alike, but two pieces may follow each other only if merging
  their joined text would not join across their border.  A sequence of pieces is what the merges
  give exactly if every neighbouring pair is allowed, so one path alone is accepted; it is found
  depth first, longest arcs first, with dead states remembered.  Bigram arcs are built when
  composition first reaches them, by replaying the merges of both pieces in order of priority.

No piece of the usual models goes on behind a space, which the compiler checks: then the machine
is back in its start state at every word, and a word's path is kept for when it comes again.

Defined results: null text is the empty text, which has no pieces.  Null ids and repeated rows
are kept, each with its result.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, prepare

# fixed values of the model format
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0

MEMO_WORDS = 600_000
MEMO_PAIRS = 400_000
MEMO_CHARS = 64           # longer words are not kept


# -- model file --------------------------------------------------------------------------------------

def _fields(data: bytes):
    """(number, value) of a serialised message: ints, 4- or 8-byte strings, or bytes."""
    i, n = 0, len(data)

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError("not a model file")
            size = varint()
        yield key >> 3, data[i:i + size]
        i += size


class Model:
    """Pieces and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.dummy_prefix, self.trim, self.escape, charsmap = True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                charsmap = f.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        if charsmap:
            raise ValueError("the model has compiled rewrite rules: pass them as rules")
        if any(t == UNUSED for _, _, t in self.pieces):
            raise ValueError("models with unused pieces are not supported")
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


# -- machines ----------------------------------------------------------------------------------------

class Normaliser:
    """Leftmost-longest rewriting, then white space: trimmed if the model says so, prefixed, escaped."""

    def __init__(self, model: Model, rules: dict[str, str] | None = None):
        self.m, self.rules = model, rules or {}
        self.find = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True)))) if self.rules else None

    def __call__(self, text: str) -> str:
        if self.find:
            text = self.find.sub(lambda m: self.rules[m[0]], text)
        if self.m.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.m.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.m.escape else text


class Lexicon:
    """Pieces by text, with the longest piece that begins with given two characters."""

    def __init__(self, model: Model):
        self.id = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
        self.score = {p: s for p, s, t in model.pieces if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.unk, self.fallback = model.unk, model.byte_fallback
        self.reach: dict[str, int] = {}
        for p in self.id:
            k = p[:2]
            self.reach[k] = max(self.reach.get(k, 1), len(p))
        self.longest = max(map(len, self.id), default=1)
        #: no piece goes on behind a space: paths of words do not depend on each other
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.id)

    def emit(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        if self.fallback:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unk]


class Bigrams:
    """Which pieces may follow each other in a merge model."""

    def __init__(self, lexicon: Lexicon):
        self.score = lexicon.score
        self.steps: dict[str, list] = {}
        self.allowed: dict[str, dict[str, bool]] = {}
        self.n = 0

    def replay(self, piece: str) -> list:
        """``(score of the next merge, first symbol, last symbol)`` before every merge of the piece's
        own characters, and after the last (score None).  Empty if merging does not end in the piece."""
        steps = self.steps.get(piece)
        if steps is None:
            s, steps, get = list(piece), [], self.score.get
            while True:
                best, at = None, -1
                for i in range(len(s) - 1):
                    x = get(s[i] + s[i + 1])
                    if x is not None and (best is None or x > best):
                        best, at = x, i
                steps.append((best, s[0], s[-1]))
                if best is None:
                    break
                s[at:at + 2] = [s[at] + s[at + 1]]
            if len(s) > 1:
                steps = []
            self.steps[piece] = steps
        return steps

    def ok(self, a: str, b: str) -> bool:
        after = self.allowed.get(a)
        if after is None:
            after = self.allowed[a] = {}
        known = after.get(b)
        if known is None:
            known = after[b] = self._ok(a, b)
            self.n += 1
        return known

    def _ok(self, a: str, b: str) -> bool:
        left, right, i, j = self.replay(a), self.replay(b), 0, 0
        if not left or not right:
            return False
        get = self.score.get
        while True:
            x, _, last = left[i]
            y, first, _ = right[j]
            across = get(last + first)
            # higher scores first; of equal scores the leftmost: left piece, border, right piece
            if across is not None and (x is None or across > x) and (y is None or across >= y):
                return False
            if x is None and y is None:
                return True
            if y is None or (x is not None and x >= y):
                i += 1
            else:
                j += 1


class Transducer:
    """Composition of normaliser, lexicon and (merge models) bigrams."""

    def __init__(self, data: bytes, rules: dict[str, str] | None = None):
        self.model = Model(data)
        self.normalise = Normaliser(self.model, rules)
        self.lexicon = Lexicon(self.model)
        self.bigrams = Bigrams(self.lexicon)
        self.floor = min(self.lexicon.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, bytes] = {}
        pieces = [p for p in self.lexicon.id if len(p) > 1]
        # a line break that no longer piece holds is a piece of its own on every path
        self.lone_break = not any("\n" in p for p in pieces)
        self.words = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if self.lone_break else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.raw = [self._surface(i) for i in range(len(self.model.pieces))]

    # encoding
    def path(self, s: str) -> list[str]:
        """Pieces on the shortest path of a normalised string."""
        return self._merged(s) if self.model.kind == BPE else self._lightest(s)

    def _merged(self, s: str) -> list[str]:
        n, ids, reach, ok = len(s), self.lexicon.id, self.lexicon.reach, self.bigrams.ok
        replay = self.bigrams.replay
        # depth first: a frame holds where its piece begins and the length tried
        out: list[str] = []
        starts: list[int] = []
        dead: set = set()
        at, size = 0, min(n, reach.get(s[:2], 1)) if s else 0
        while at < n:
            last = out[-1] if out else None
            while size:
                piece = s[at:at + size]
                if (size == 1 or piece in ids) and (at + size, piece) not in dead and (
                        ok(last, piece) if last is not None else replay(piece)):
                    break
                size -= 1
            if size:
                out.append(piece)
                starts.append(at)
                at += size
                size = min(n - at, reach.get(s[at:at + 2], 1))
            else:
                if not out:
                    raise ValueError("no path")       # cannot happen: merging always ends
                piece = out.pop()
                dead.add((at, piece))
                at = starts.pop()
                size = len(piece) - 1
        return out

    def _lightest(self, s: str) -> list[str]:
        n, score, reach = len(s), self.lexicon.score, self.lexicon.reach
        best = [0.0] + [float("-inf")] * n
        back = [0] * (n + 1)
        for at in range(n):
            here = best[at]
            for size in range(1, min(n - at, max(1, reach.get(s[at:at + 2], 1), reach.get(s[at], 1))) + 1):
                x = score.get(s[at:at + size])
                if x is None:
                    if size > 1:
                        continue
                    x = self.floor
                if here + x > best[at + size]:
                    best[at + size], back[at + size] = here + x, at
        out = []
        while n:
            out.append(s[back[n]:n])
            n = back[n]
        return out[::-1]

    def _ids(self, s: str) -> bytes:
        ids: list[int] = []
        fuse = self.model.kind == UNIGRAM or not self.lexicon.fallback
        unknown = False
        for piece in self.path(s):
            new = self.lexicon.emit(piece)
            if fuse and new == [self.lexicon.unk] and unknown:
                continue                              # neighbouring unknown characters are one
            unknown = new == [self.lexicon.unk]
            ids += new
        return array("I", ids).tobytes()

    def _word(self, s: str) -> bytes:
        ids = self.memo.get(s)
        if ids is None:
            ids = self._ids(s)
            if len(s) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[s] = ids
            if self.bigrams.n > MEMO_PAIRS:
                self.bigrams.allowed.clear()
                self.bigrams.n = 0
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as native unsigned 32-bit integers."""
        s = self.normalise(text or "")
        if not self.lexicon.by_word or not (self.lexicon.fallback or self.model.kind == BPE):
            return self._ids(s)
        get, word = self.memo.get, self._word
        return b"".join([get(w) or word(w) for w in self.words.findall(s)])

    # decoding
    def _surface(self, i: int) -> bytes:
        piece, _, kind = self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


# -- Spark -------------------------------------------------------------------------------------------

_MACHINES: dict = {}


def machine(shipped) -> Transducer:
    """The worker's transducer for a broadcast model (one per Python worker)."""
    key = zlib.crc32(shipped.value)
    if key not in _MACHINES:
        _MACHINES[key] = Transducer(shipped.value)
    return _MACHINES[key]


def ship_model(spark: SparkSession, path: str | None = None):
    with open(path or default_model(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(batch):
    return (t.as_py() for t in batch.column(1))


def _encode(shipped):
    def run(batches):
        t = machine(shipped)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.encode(x) for x in _texts(b)], pa.binary())], names=["doc_id", "ids"])
    return run


def _decode(shipped):
    def run(batches):
        t = machine(shipped)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if x is None else t.decode(array("I", x)) for x in _texts(b)], pa.string())], names=["doc_id", "text"])
    return run


def _both(shipped):
    def run(batches):
        t = machine(shipped)
        for b in batches:
            rows = []
            for doc_id, x in zip(b.column(0).to_pylist(), _texts(b)):
                ids = t.encode(x)
                text = t.decode(array("I", ids))
                rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), len(text), text == (x or "")))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)],
                                             names=["doc_id", "n_pieces", "ids_crc32", "n_chars", "same_text"])
    return run


def _source(docs: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    need(docs, id_col, col)
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{col}`").cast(kind).alias("x"))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: little-endian unsigned 32-bit ids of every whole text."""
    src = _source(docs, id_col, text_col, "string")
    return src.mapInArrow(_encode(ship_model(docs.sparkSession, model)), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ids; null ids give null text."""
    src = _source(encoded, id_col, ids_col, "binary")
    return src.mapInArrow(_decode(ship_model(encoded.sparkSession, model)), "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, n_pieces, ids_crc32, n_chars, same_text)``: every text encoded, its ids decoded
    (``n_chars`` code points) and compared with it."""
    src = _source(docs, id_col, text_col, "string")
    return src.mapInArrow(_both(ship_model(docs.sparkSession, model)),
                          "doc_id long, n_pieces long, ids_crc32 long, n_chars long, same_text boolean")
