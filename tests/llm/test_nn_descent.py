import numpy as np
import pytest

from openbound.llm import nn_descent as N

VECS = "vec_id long, embedding array<float>, label int, p long, c string, links int, row string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", 3, "r") for i, v in rows], VECS)


def _brute(rows, threshold=0.9):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    u = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if k else None for (_, v), k in zip(rows, ok)]
    link = [[x != y and ok[x] and ok[y] and len(u[x]) == len(u[y]) and u[x] @ u[y] >= threshold for y in range(n)] for x in range(n)]
    comp = list(range(n))
    for x in range(n):
        for y in range(x):
            if link[x][y]:
                a, b = comp[x], comp[y]
                comp = [b if c == a else c for c in comp]
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(n) if comp[y] == comp[x] and rows[y][0] is not None]
        least = min(ids, default=None)
        out.append((str(i), sum(link[x]), str(least), i == least))
    return sorted(out)


@pytest.mark.parametrize("block", [8, 512])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N.count_links, "__defaults__", (N.THRESHOLD, block))
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for size, noise in [(1, 0)] * 60 + [(2, .05), (3, .04), (5, .03), (40, .03), (25, .055)] * 3:
        base = rng.normal(size=16)
        for _ in range(size):
            rows.append((i, (base + noise * np.linalg.norm(base) * rng.normal(size=16)).tolist()))
            i += 1
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None] * 8), (505, [float("inf")] + [1.0] * 15),
             (506, rows[3][1]), (506, rows[3][1]), (507, rows[3][1]), (None, rows[3][1]), (508, [1.0, 2.0]), (509, [2.0, 4.0]), (510, [1.0]),
             (None, [5.0, -1.0]), (511, [0.0] * 15 + [-0.0])]
    report = {}
    got = N.near_vectors(_frame(spark, rows), report=report).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == _brute(rows)
    assert report["recall"][-1] >= N.AUDIT_TARGET


def test_window_pairs_cross_batches():
    import pyarrow as pa
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = np.repeat([1, 2], 15)
    rows = pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.arange(30.0)), pa.array(np.arange(30)), pa.array([v.tobytes() for v in x], pa.binary())],
                                      names=["g", "o", "p", "u"])
    run = N._window_pairs(0.3, 5)
    want = {(a, b) for a in range(30) for b in range(a + 1, min(a + 6, 30)) if g[a] == g[b] and x[a] @ x[b] >= 0.3}
    for size in (30, 7, 2):
        got = [r for b in run(rows.slice(i, size) for i in range(0, 30, size)) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in got if r["sim"] >= 0.3} == want


def test_empty(spark):
    assert N.near_vectors(_frame(spark, [])).count() == 0
    got = N.near_vectors(_frame(spark, [(1, None), (None, None)])).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in got) == [("1", 0, True), ("None", 0, True)]


def test_audit_counts_points_and_components_alike(spark):
    """One large group whose links are all found must not hide pairs that are all missed."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=32)
    group = [base + .02 * np.linalg.norm(base) * rng.normal(size=32) / 32 ** .5 for _ in range(300)]
    ends = [x + .02 * rng.normal(size=32) for x in rng.normal(size=(60, 32)) for _ in range(2)]
    u = [(x / np.linalg.norm(x)).tobytes() for x in group + ends]
    frame = lambda comp: spark.createDataFrame([(i, comp(i), 1, x) for i, x in enumerate(u)], "p long, c long, copies long, u binary")
    recall, missed = N.audit(frame(lambda i: 0 if i < 300 else i), len(u))
    assert recall < .1 and missed.count() == 120
    recall, missed = N.audit(frame(lambda i: 0 if i < 300 else i - i % 2), len(u))
    assert recall == 1.0 and missed.count() == 0


def test_tables_grow_with_the_code_and_a_miss_is_an_error(spark, monkeypatch):
    assert N.tables_needed(12, .9) > N.TABLES and N.tables_needed(24, .9) > 4 * N.tables_needed(12, .9)
    rng = np.random.default_rng(3)
    ends = [x + .3 * rng.normal(size=64) for x in rng.normal(size=(200, 64)) for _ in range(2)]
    df = _frame(spark, [(i, v.tolist()) for i, v in enumerate(ends)])
    monkeypatch.setattr(N, "tables_needed", lambda bits, threshold: 1)
    monkeypatch.setattr(N, "AUDIT_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="below"):
        N.near_vectors(df, tables=1)
    monkeypatch.undo()
    report = {}
    N.near_vectors(df, tables=1, report=report)
    assert report["recall"][-1] >= N.AUDIT_TARGET and report["tables"][0] == N.tables_needed(N.code_bits(400), .9)
