import random
import zlib

import numpy as np
import pytest

from openbound.llm import packing as P
from openbound.llm import tokens as T
from openbound.llm import wavelet as W

DOCS = "doc_id long, text string, length int, ids string, sequence_id int, row int, part string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(T.default_tokenizer())


def _ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def _rows(seed=4, n=120):
    rnd = random.Random(seed)
    alphabet = "aZé1.,'! \n日<|>_-  st"
    rows = [(i, "".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 9, 60, 900])))) for i in range(n)]
    words = ["word%d" % i for i in range(50)] + ["été,", "don't", "x.\ny", "<|endoftext|>"]
    rows += [(n + i, " ".join(rnd.choices(words, k=rnd.choice([3, 400, 3000])))) for i in range(20)]
    return rows + [(None, "null id"), (n + 50, None), (n + 51, "twice"), (n + 51, "twice"), (n + 52, " a  b "), (n + 53, "　x ")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "p") for i, t in rows], DOCS)


def test_memo_equals_library(library):
    enc = T.Encoder(open(T.default_tokenizer(), encoding="utf-8").read())
    texts = [t or "" for _, t in _rows(8, 600)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert enc.by_word and enc.encode(texts) == want and enc.encode(texts) == want


def test_any_white_space_equals_library(library):
    enc = T.Encoder(open(T.default_tokenizer(), encoding="utf-8").read())
    rng = np.random.default_rng(0)
    marks = [" ", " ", " ", "\n", "\n", "\t", "\r", "a", "B", "\u00e9", ".", ",", "1", "$$", "\u2028", "\u00a0", "it's", "\u4e2d", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 26))) for _ in range(20_000)]
    assert enc.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_full_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(T, "MEMO_WORDS", 50)
    enc = T.Encoder(open(T.default_tokenizer(), encoding="utf-8").read())
    texts = [f"line {i} of\nwords w{i} x{i % 7}." for i in range(40)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x for lo in range(0, 40, 8) for x in enc.encode(texts[lo:lo + 8])] == want and len(enc.memo.place) <= 50


def test_full_memo_keeps_words_in_use(library, monkeypatch):
    monkeypatch.setattr(T, "MEMO_WORDS", 60)
    enc = T.Encoder(open(T.default_tokenizer(), encoding="utf-8").read())
    made, make = [], enc.memo.make

    def counted(words):
        made.extend([words] if isinstance(words, str) else words)
        return make(words)
    monkeypatch.setattr(enc.memo, "make", counted)
    for k in range(30):
        text = " ".join(["x", *(f"often{i}" for i in range(20)), *(f"rare{k}-{i}" for i in range(10))])
        assert enc.encode([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sum(w.startswith("often") for w in made) == 20 and sum(w.startswith("rare") for w in made) == 300
    assert len(enc.memo.place) <= 60


def test_new_plain_words_share_model_calls(library, monkeypatch):
    enc = T.Encoder(open(T.default_tokenizer(), encoding="utf-8").read())
    asked = []

    class Model:
        tokenize = staticmethod(lambda part, real=enc.model.tokenize: asked.append(part) or real(part))
    monkeypatch.setattr(enc, "model", Model)
    text = "\u00e0 " + " ".join(f"{a}thron{b}{c}" for a in ("", "\u00e9", "X") for b in ("esh", "\u00ff\u00e0", "\u00c0") for c in ("", ",", ".", "it"))
    assert enc.encode([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(text.split()) == 37 and len(asked) <= 9
    monkeypatch.setattr(enc, "together", False)      # a vocabulary with tokens across words
    text = text.replace("thron", "thren")
    assert enc.encode([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    for token, over in (("a" + T.SPACE + "b", True), ("a,", True), ("." + T.SPACE, True), (T.SPACE * 2, False), (T.SPACE + "a", False), (T.SPACE + ",", False), ("1,", False)):
        assert bool(T.ACROSS.match(token)) == over


def test_cut():
    for n in (0, 1, 7, 8, 9, 16, 17, 80):
        c = P.cut(n, 8)
        assert sum(m for _, m in c) == n and all(m == 8 for _, m in c[1:])
        assert [s for s, _ in c] == list(np.cumsum([0] + [m for _, m in c])[:-1]) if c else n == 0


def _optimum(sizes, cap):
    """Fewest bins by brute force (dynamic programming over subsets)."""
    n = len(sizes)
    best = {0: (1, 0)}
    full = (1 << n) - 1
    state = [(n + 1, 0)] * (1 << n)
    state[0] = (1, 0)
    for m in range(1, full + 1):
        for i in range(n):
            if m >> i & 1:
                b, used = state[m ^ 1 << i]
                cand = (b, used + sizes[i]) if used + sizes[i] <= cap else (b + 1, sizes[i])
                state[m] = min(state[m], cand)
    return state[full][0]


def test_bin_completion_against_optimum():
    rnd = random.Random(6)
    better = 0
    for _ in range(120):
        cap = rnd.choice([10, 30, 100])
        sizes = [rnd.randint(1, cap) if rnd.random() < .5 else rnd.randint(cap // 5, cap // 2) for _ in range(rnd.randint(1, 11))]
        counts = {s: sizes.count(s) for s in sizes}
        got = P.bin_completion(counts, cap)
        used = {}
        for p, n in got:
            assert sum(p) <= cap and n > 0
            for s in p:
                used[s] = used.get(s, 0) + n
        assert used == counts
        n, opt = sum(x for _, x in got), _optimum(sizes, cap)
        fit = sum(x for _, x in P.best_fit(counts, cap))
        assert P.waste_bound(counts, cap) <= opt <= n <= fit
        better += n < fit
        assert n == opt
    assert better
    assert P.bin_completion({}, 8) == []
    with pytest.raises(ValueError):
        P.bin_completion({9: 1}, 8)


def _check_packing(rows, library, got, cap):
    want = sorted((str(i), zlib.crc32(_ids(library, t)[s:s + n].tobytes()), s, n, k)
                  for i, t in rows for k, (s, n) in enumerate(P.cut(len(_ids(library, t)), cap)))
    assert sorted((str(r["doc_id"]), r["ids_crc32"], r["start"], r["length"], r["piece"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return len(seqs)


def test_pack_documents(spark, library, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 7)
    rows = _rows() + [(1000 + i, "same text") for i in range(60)]
    got = P.pack_documents(_docs(spark, rows), with_ids=True, capacity=64).cache()
    n = _check_packing(rows, library, got.collect(), 64)
    counts = {r[0]: r[1] for r in got.groupBy("length").count().collect()}
    assert n == sum(x for _, x in P.bin_completion(counts, 64))
    seq = {r["sequence_id"]: bytes(r["ids"]) for r in P.sequences(got).collect()}
    for r in got.collect():
        assert seq[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert P.pack_documents(_docs(spark, [])).count() == 0
    _check_packing(rows, library, P.pack_documents(_docs(spark, rows)).collect(), 1024)


@pytest.mark.parametrize("n,levels", [(0, 3), (1, 1), (511, 4), (512, 9), (5000, 17)])
def test_wavelet_matrix(n, levels):
    rng = np.random.default_rng(n + levels)
    ids = (rng.zipf(1.3, n) % (1 << levels)).astype(np.uint32)
    s = W.Shard(W.dump(ids, levels, [1, None], [n, 0]))
    m = s.matrix
    assert (m.decode() == ids).all() and s.documents() == [(1, 0, n), (None, n, 0)]
    for i in rng.integers(0, max(n, 1), 20) if n else []:
        v = int(ids[i])
        assert m.access(int(i)) == v and m.rank(v, int(i)) == int((ids[:i] == v).sum())
        assert m.count(v) == int((ids == v).sum()) and m.count(v, 3, int(i) + 1) == int((ids[3:i + 1] == v).sum())
    for v in {int(x) for x in ids[:3]}:
        assert m.occurrences(v) == np.flatnonzero(ids == v).tolist()
    assert m.count(1 << levels) == 0
    with pytest.raises(IndexError):
        m.access(n)


def test_token_output_round_trip(spark, library):
    rows = _rows()
    got = W.token_output(_docs(spark, rows), shard_tokens=500).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, t in order:
        ids = _ids(library, t)
        want.append((str(i), at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert W.token_output(_docs(spark, [])).count() == 0
