import random

import numpy as np

from openbound.llm import exact_dedup as X
from openbound.llm import simhash as S
from openbound.llm.components import connected_components

DOCS = "doc_id long, text string, component_id string, fp int, row int, ids string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS)


def test_boundaries_follow_content():
    rnd = random.Random(1)
    a = bytes(rnd.choices(range(256), k=40_000))
    cuts = X.boundaries(a)
    assert cuts[-1] == len(a) and all(y - x <= X.MAX_CHUNK for x, y in zip([0, *cuts], cuts))
    moved = X.boundaries(b"front" * 700 + a)
    shared = {c + 3500 for c in cuts} & set(moved)
    assert len(shared) >= len(cuts) - 2
    assert X.boundaries(b"") == [] and X.boundaries(b"x" * 200_000)[-1] == 200_000


def test_exact_dedup(spark):
    long = "w%d " * 1
    text = " ".join(long % i for i in range(20_000))
    rows = [(5, text), (3, text.replace("  ", "\n")), (9, text + "x"), (1, None), (2, ""), (4, " "), (None, ""),
            (7, "a\t\n b"), (7, "a b"), (8, "a b"), (6, "a b")]
    got = X.exact_dedup(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[3] == [(3, 2, True)] and by[5] == [(3, 2, False)] and by[9] == [(9, 1, True)]
    assert by[1] == [(1, 3, True)] and by[2] == [(1, 3, False)] and by[None] == [(1, 3, False)]
    assert by[4] == [(4, 1, True)] and by[8] == [(8, 1, True)]
    assert sorted(by[7]) == [(6, 3, False), (6, 3, False)] and by[6] == [(6, 3, True)]
    assert X.exact_dedup(_docs(spark, [])).count() == 0


def test_exact_dedup_repeated_rows_keep_one(spark):
    got = X.exact_dedup(_docs(spark, [(1, "a"), (1, "a"), (1, "b")])).collect()
    assert sorted((r["kept"], r["group_size"]) for r in got) == [(False, 2), (True, 1), (True, 2)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [
        (rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges + [(5, 5), (None, 3)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in got} and set(got) >= {x for e in edges for x in e if e[0] != e[1]}


def _brute_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    import xxhash
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    rnd = random.Random(5)
    voc = ["W%d" % i for i in range(400)] + ["É\u0085a", "x y"]
    rows, i = [(None, "a b"), (900, None), (901, ""), (902, " \n"), (903, "A B"), (904, "a b"), (904, "a b")], 0
    for g in range(25):
        base = [rnd.choice(voc) for _ in range(rnd.choice([2, 3, 60, 300]))]
        for c in range(8):
            w = list(base)
            for _ in range(c // 3):
                w[rnd.randrange(len(w))] = rnd.choice(voc)
            rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
            i += 1
    got = S.simhash_groups(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = [_brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if (fp[x] ^ fp[y]).bit_count() <= 3:
                a, b = comp[x], comp[y]
                comp = [a if c == b else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = sorted((str(d), f, least[c]) for (d, _), f, c in zip(rows, fp, comp))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert S.simhash_groups(_docs(spark, [])).count() == 0


def test_large_cells_are_cut_into_blocks(spark):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(3))) for _ in range(150)})
    pts = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    edges = S.near_links(pts, 3, cell_rows=16).collect()
    assert len(edges) >= len(fps) - 1
    near = {(S._signed(a), S._signed(b)) for a in fps for b in fps if (a ^ b).bit_count() <= 3}
    assert all((r["a"], r["b"]) in near for r in edges)
    reach, todo = set(), [edges[0]["a"]]
    nb = {}
    for r in edges:
        nb.setdefault(r["a"], []).append(r["b"])
        nb.setdefault(r["b"], []).append(r["a"])
    while todo:
        x = todo.pop()
        if x not in reach:
            reach.add(x)
            todo += nb[x]
    assert len(reach) == len(fps)


def test_bound_never_exceeds_hamming():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64))
    for other in (b, rng.permutation(a)):
        bound = np.bitwise_count(S.embed(a) ^ S.embed(other))
        exact = np.bitwise_count(a ^ other)
        assert (bound <= exact).all()
    x, y = 0b10_01_11, 0b01_10_00
    assert np.bitwise_count(S.embed(np.array([x], np.uint64)) ^ S.embed(np.array([y], np.uint64)))[0] == 2
