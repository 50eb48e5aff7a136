"""Token ids of whole texts by the tokenizers library, with a bounded word memo per worker.

A batch of texts is split into words and dictionary-encoded by Arrow, so a word is looked up once
a batch, and the ids of all words are gathered by numpy.  The memo maps a word to its place in one
buffer of ids; when it is full, the words looked up most often stay.

The byte-level pre-tokeniser never joins a space that stands before a non-space with what is
before it, so a text may be cut there and equal words need one library call.  Texts with a
space before other white space, or at their end, go to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

MEMO_WORDS = 600_000          # words of a worker's memo; beyond it at most half, those in most use, stay
STRETCH = 1 << 22             # characters split into words at a time
_ENCODERS: dict = {}


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary file named by the query contracts."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def ship_tokenizer(spark: SparkSession, path: str | None = None):
    """Broadcast a tokenizer file (a vocabulary: its size does not grow with the data)."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


#: Plain words: Latin letters, then a full stop or comma at most.
SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,]?")
GROUP = 8                     # plain words given to the model at once


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SYMBOLS = _byte_symbols()
SPACE = BYTE_SYMBOLS[32]
SYMBOLS = np.array([ord(BYTE_SYMBOLS.get(b, chr(b))) for b in range(256)], "<u2")


def _symbols(text: str) -> str:
    """``text`` in the byte-level alphabet."""
    return SYMBOLS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


LETTER = "A-Za-z" + "".join(chr(SYMBOLS[b]) for b in [*range(0x80, 0xc0), *range(0xc3, 0xca)])
#: A token that could reach from one plain word into the next, or from its letters into its mark.
ACROSS = re.compile(f"(?=[{LETTER}{SPACE}.,]+$).*(?:[{LETTER}.,]{SPACE}|[{LETTER}][.,])")


def _places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every place of the stretches ``start, start + 1, ...`` of ``count`` places each, one after another."""
    ends = np.cumsum(count, dtype=np.int64)
    at = np.repeat(start - (ends - count), count)
    at += np.arange(len(at))
    return at


class Memo:
    """Words and their ids; ``make`` encodes new words: all their ids, and how many each has (-1: none can be given)."""

    def __init__(self, make):
        self.make = make
        self.place: dict[str, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int32)        # look-ups of a word, halved when the memo is thinned

    def _thin(self, room: int):
        """Keep words looked up more than once, ``room`` at most, those in most use first."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > room:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:max(room, 0)]])
        words = list(self.place)
        self.place = {words[k]: i for i, k in enumerate(keep.tolist())}
        start, self.count, self.uses = self.start[keep], self.count[keep], self.uses[keep] // 2
        n = np.maximum(self.count, 0)
        self.ids, self.start = self.ids[_places(start, n)], np.cumsum(n, dtype=np.int64) - n

    def _find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        return at, np.flatnonzero(at < 0)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``ids`` and number of ids of every one of the (different) words."""
        at, new = self._find(words)
        if len(self.place) + len(new) > MEMO_WORDS:
            self._thin(min(MEMO_WORDS // 2, MEMO_WORDS - len(words)))
            at, new = self._find(words)
        if len(new):
            first = len(self.place)
            at[new] = first + np.arange(len(new))
            fresh = [words[i] for i in new.tolist()]
            ids, count = self.make(fresh)
            self.place.update(zip(fresh, range(first, first + len(new))))
            n = np.maximum(count, 0)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n, dtype=np.int64) - n])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.uses[at] += 1
        return self.start[at], self.count[at]


def _own_line_ends(text: str) -> str | None:
    """``text`` with a space on both sides of every line end, if each is a pre-token of its own: no
    white space, or nothing, beside it.  None if a space stands before a line end."""
    if "\n" not in text:
        return text
    lines = text.split("\n")
    if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
        return " \n ".join(lines)
    return None if " \n" in text else text


def _pack(ids) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder:
    """``encode(texts)``: little-endian unsigned 32-bit ids of each text, no special tokens added.

    A new word goes through the library's pre-tokeniser and model (a plain word is its
    own pre-token); only texts that hold an added token or the white space above need the
    library's whole pipeline, which costs ten times as much for a word.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        pre = self.tok.pre_tokenizer
        self.by_word = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tok.normalizer is None
        self.memo, self.firsts = Memo(self._spaced), Memo(self._bare)
        if self.by_word:
            self.split, self.model = pre.pre_tokenize_str, self.tok.model
            special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
            self.special = special
            vocabulary = self.tok.get_vocab()
            # words may go to the model together if no token reaches over their ends
            m = self.model
            merges_only = type(m).__name__ == "BPE" and not (m.dropout or m.ignore_merges or m.continuing_subword_prefix or m.end_of_word_suffix)
            self.together = merges_only and vocabulary.keys() >= set(_symbols(" .,")) and not any(map(ACROSS.match, vocabulary))
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)     # tokens that start with a space
            self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space before each; -1 for one that the space may be joined to otherwise."""
        plain = np.array([self.together and SIMPLE.fullmatch(w) is not None for w in words], bool)
        tokenize, ids = self.model.tokenize, []
        mapped = _symbols(" ".join([w for w, p in zip(words, plain.tolist()) if p])).split(SPACE)
        if plain.any():
            for lo in range(0, len(mapped), GROUP):
                ids += [t.id for t in tokenize(SPACE + SPACE.join(mapped[lo:lo + GROUP]))]
        made = np.array(ids, np.uint32)
        begin = np.flatnonzero(self.opens[made])
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        start[plain], count[plain] = begin, np.diff(begin, append=len(made))
        ids = []
        for i in np.flatnonzero(~plain).tolist():
            w, n = words[i], len(ids)
            if not w or w[0].isspace():
                count[i] = -1
                continue
            for part, _ in self.split(" " + w):
                ids += [t.id for t in tokenize(part)]
            start[i], count[i] = len(made) + n, len(ids) - n
        made = np.concatenate([made, np.array(ids, np.uint32)])
        return made[_places(start, np.maximum(count, 0))], count

    def _bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with nothing before them."""
        made = self._whole(words)
        return np.frombuffer(b"".join(made), "<u4").astype(np.uint32), np.array([len(m) // 4 for m in made], np.int32)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, n = lo, 0
            while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= STRETCH):
                n += len(texts[hi])
                hi += 1
            out += self._stretch(texts[lo:hi])
            lo = hi
        return out

    def _stretch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        out: list[bytes] = [b""] * len(texts)
        plain, whole, lines = [], [], []
        for i, t in enumerate(texts):
            line = _own_line_ends(t)
            if line is None or any(x in t for x in self.special):
                whole.append(i)
            else:
                plain.append(i)
                lines.append(line)
        if plain:
            whole += self._by_words(plain, lines, out)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out

    def _by_words(self, places: list[int], lines: list[str], out: list[bytes]) -> list[int]:
        """Puts the ids of texts into ``out``; returns the places of those that must not be cut at their spaces."""
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        words = split.flatten()
        # the first word of a text and of a line has no space before it, nor has a line end
        first = pc.equal(words, "\n").to_numpy(zero_copy_only=False).copy()
        first[ends[:-1]] = False             # a line end that starts a text is followed by a space of the text's own
        first[1:] |= first[:-1].copy()
        first[ends[:-1]] = True
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        base = 0
        ids = []
        for memo, here in ((self.memo, ~first), (self.firsts, first)):
            coded = words.filter(pa.array(here)).dictionary_encode()
            s, n = memo.look(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            code = coded.indices.to_numpy()
            start[here], count[here] = base + s[code], n[code]
            ids.append(memo.ids)
            base += len(memo.ids)
        bad = np.unique(np.searchsorted(ends, np.flatnonzero(count < 0), side="right") - 1).tolist()
        np.maximum(count, 0, out=count)
        raw = memoryview(np.concatenate(ids)[_places(start, count)].astype("<u4", copy=False).tobytes())
        cut = 4 * np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[ends]
        for i, lo, hi in zip(places, cut[:-1].tolist(), cut[1:].tolist()):
            out[i] = bytes(raw[lo:hi])
        return [places[k] for k in bad]


def encoder(shipped) -> Encoder:
    """The worker's encoder for a broadcast tokenizer (one per Python worker)."""
    spec = shipped.value
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]
