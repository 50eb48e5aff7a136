"""Source divergence audit against brute force in whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from openbound.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string"


def brute(rows, min_docs=10, top=10, unit=10 ** 9):
    docs, groups = defaultdict(list), set()
    for text, lang, source in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        docs[lang].append((source, re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
        groups.add((lang, source))
    out = []
    for lang, made in docs.items():
        df = Counter(t for _, ts in made for t in set(ts))
        kept = sorted(t for t in df if df[t] >= min_docs)
        count, whole = defaultdict(Counter), Counter()
        for source, ts in made:
            for t in ts:
                if df[t] >= min_docs:
                    count[source][t] += 1
                    whole[t] += 1

        def weights(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + unit * (c[t] + 2) // total for t in kept}
        sources = sorted((s for x, s in groups if x == lang), key=lambda s: s.encode())
        w, q = {s: weights(count[s]) for s in sources}, weights(whole)
        for s in sources:
            pairs = [(o, sum((w[s][t] - w[o][t]) ** 2 // (w[s][t] + w[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, (w[s][t] - q[t]) ** 2 // (w[s][t] + q[t])) for t in kept if count[s][t] and w[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def some_rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "GAMMA", "d\u00e9j\u00e0", "\u00c9t\u00e9", "x1y", "end-of", "\u4e2d\u6587", "q", "zz_top"] + [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        source = None if i % 29 == 0 else "hot" if i % 3 == 0 else f"s{rng.integers(6)}"
        lang = None if i % 31 == 0 else ["en", "de"][int(rng.integers(2))]
        text = None if i % 37 == 0 else "" if i % 41 == 0 else " ".join(rng.choice(words, rng.integers(1, 30), p=p / p.sum()))
        rows.append((text, lang, source))
    return rows + rows[:40] + [("only here", "rare", "one"), ("", "rare", "two"), ("TIE tie", "rare", "three")]


@pytest.mark.parametrize("peers", [20_000, 3])
def test_equals_brute_force(spark, monkeypatch, peers):
    monkeypatch.setattr(D, "PEERS", peers)
    rows = some_rows()
    df = spark.createDataFrame([(None, *r, "x", "y") for r in rows], SCHEMA)
    assert got(D.divergence(df)) == brute(rows)


def test_long_text_empty_table_and_other_limits(spark):
    rows = [("word " * 300_000 + "last", "en", "a"), ("word other", "en", "b"), (None, None, None)]
    df = spark.createDataFrame([(1, *r, None, None) for r in rows], SCHEMA)
    assert got(D.divergence(df, min_docs=1, top_terms=2)) == brute(rows, 1, 2)
    assert got(D.divergence(df)) == brute(rows)            # nothing kept: pairs of value 0
    assert D.divergence(df.limit(0)).count() == 0


def test_blocks_of_whole_terms(monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    rng = np.random.default_rng(0)
    post = sorted((lang, f"t{t:02}", int(g)) for lang in "ab" for t in range(30) for g in rng.choice(5, rng.integers(1, 6), replace=False))
    weight = {k: int(rng.integers(1, 10 ** 9)) for k in post}
    base = {(lang, g): int(rng.integers(1, 10 ** 8)) for lang in "ab" for g in range(5)}
    t = pa.table({"lang": [x[0] for x in post], "term": [x[1] for x in post], "g": pa.array([x[2] for x in post], pa.int32()),
                  "p": [weight[x] for x in post], "p0": [base[x[0], x[2]] for x in post]})
    tile = {lang: (1, np.array([base[lang, g] for g in (1, 2, 3)])) for lang in "ab"}
    acc: Counter = Counter()
    for b in D._gustavson(tile)(t.to_batches(max_chunksize=4)):
        for r in b.to_pylist():
            acc[r["lang"], r["a"], r["b"]] += r["v"]
    f = lambda p, q: (p - q) ** 2 // (p + q)     # noqa: E731
    want: Counter = Counter()
    for lang, term, a in post:
        for b in (1, 2, 3):
            if (lang, term, b) in weight:
                p, q, p0, q0 = weight[lang, term, a], weight[lang, term, b], base[lang, a], base[lang, b]
                want[lang, a, b] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    assert {k: v for k, v in acc.items() if v} == {k: v for k, v in want.items() if v}


def test_weights_beyond_long_products(spark):
    n = 12_345_678_901_234
    r = spark.createDataFrame([(n, 5 * n, 7)], "n long, total long, terms long").select(D._weight("n", "total", "terms").alias("p")).first()
    assert r["p"] == 1 + 10 ** 9 * (n + 2) // (5 * n + 14)
