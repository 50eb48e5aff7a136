import random

import pytest

import corpus_pipeline as C
from openbound.llm import packing, quality
from openbound.llm import simhash as S
from openbound.llm import tokens as T

from .test_exact_simhash import _brute_fp
from .test_line_dedup import _brute

SF01 = "/root/testdata/sf0.01"


def _groups(rows, bits=3):
    fp = [_brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if (fp[x] ^ fp[y]).bit_count() <= bits and comp[x] != comp[y]:
                a, b = comp[x], comp[y]
                comp = [b if c == a else c for c in comp]
    return comp


def test_near_dedup_keeps_one_of_each_group(spark):
    rnd = random.Random(2)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(80)) for _ in range(12)]
    rows = [(i, base[i % 12]) for i in range(40)] + [(40 + i, base[i] + " end") for i in range(12)]
    rows += [(None, "only null id here now"), (90, None), (91, ""), (92, "twice is two"), (92, "twice is two"), (92, base[0])]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, key string, fp int, `row` int")
    out = S.near_dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    comp = _groups(rows)
    assert len(got) == len(set(comp))
    least = {}
    for (i, t), c in zip(rows, comp):
        least[c] = min(least.get(c, (True, 0)), (i is None, i or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(least.values())
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)
    assert S.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [160])
def test_stages_against_brute_force(spark, limit):
    """The whole chain on a small table: the first stage by the classifier's own score per text,
    the others by brute force."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").filter(f"doc_id < {limit}")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    model = quality.fit_quality(docs)
    kept = [(i, t) for i, t in rows if model.scorer.probability(t) >= quality.THRESHOLD]
    one = C.keep_quality(spark, docs, SF01)
    assert one.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in one.collect()) == kept
    two = C.drop_copied_lines(spark, one, SF01)
    lines = sorted((int(i), t) for i, t, _ in _brute(kept, 50))
    assert two.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in two.collect()) == lines
    three = C.drop_near_copies(spark, two, SF01)
    first = {}
    for (i, t), c in zip(lines, _groups(lines)):
        first.setdefault(c, (i, t))
    last = sorted(first.values())
    assert three.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in three.collect()) == last
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(T.default_tokenizer())
    ids = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in last}
    got = C.pack_sequences(spark, three, SF01).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == sorted(
        (i, k, s, n) for i, m in ids.items() for k, (s, n) in enumerate(packing.cut(m, packing.CAPACITY)))
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    total = sum(ids.values())
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= -(-total // packing.CAPACITY) + 3


def test_empty_documents(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        df = stage(spark, df, SF01)
    assert df.count() == 0
