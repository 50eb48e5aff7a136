import random

import pytest

from openbound.llm import line_dedup as L

DOCS = "doc_id long, text string, doc string, pos int, spans string, `a.b` string, lines int"


def _brute(rows, min_words):
    """Delete every line of a stretch of min_words words or more that stands earlier too."""
    import hashlib
    order = sorted({(d, t) for d, t in rows}, key=lambda r: (
        r[0] is not None, r[0] or 0,
        hashlib.md5((hashlib.md5((r[1] or "").encode()).hexdigest() + ("" if r[0] is None else f":{r[0]}")).encode()).digest()))
    flat = [(i, ln, s) for i, (_, t) in enumerate(order) for ln, s in enumerate((t or "").split("\n"))]
    n = len(flat)
    gone = set()
    for a in range(n):
        for b in range(a):
            if flat[a][2] != flat[b][2] or (b and a and flat[a - 1][2] == flat[b - 1][2]
                                            and flat[a - 1][0] == flat[a][0] and flat[b - 1][0] == flat[b][0]):
                continue
            k = 0
            while (a + k < n and flat[a + k][0] == flat[a][0] and flat[b + k][0] == flat[b][0]
                   and flat[a + k][2] == flat[b + k][2]):
                k += 1
            if sum(len(flat[a + j][2].split()) for j in range(k)) >= min_words:
                gone |= {a + j for j in range(k)}
    out = {}
    for i, (d, t) in enumerate(order):
        lines = [(p, s) for p, (j, _, s) in enumerate(flat) if j == i]
        kept = [s for p, s in lines if p not in gone]
        out[(d, t)] = (None if t is None else "\n".join(kept), len(lines) - len(kept))
    return [(str(d), *out[(d, t)]) for d, t in rows]


@pytest.mark.parametrize("seed,min_words", [(1, 1), (2, 4), (3, 6), (4, 50)])
def test_against_brute_force(spark, seed, min_words):
    rnd = random.Random(seed)
    voc = ["a", "b c", "", "d e f", " ", "g h i j", "k" * 40, "w " * 60]
    rows = []
    for i in range(24):
        lines = [rnd.choice(voc) if rnd.random() < .6 else f"own {i} {rnd.random()}" for _ in range(rnd.randint(1, 30))]
        rows.append((i, "\n".join(lines)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (91, rows[3][1]), (91, "a\nb c"), (None, rows[5][1]), (92, None), (93, ""),
             (94, "\n".join(["a"] * 70)), (95, "x\n" + rows[7][1])]
    df = spark.createDataFrame([(d, t, "z", 1, "s", "q", 2) for d, t in rows], DOCS)
    out = L.line_dedup(df, min_words=min_words, removed_col="removed")
    assert out.columns == df.columns + ["removed"]
    got = [(str(r["doc_id"]), r["text"], r["removed"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(_brute(rows, min_words), key=str)


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = L.line_dedup(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
