"""Steps that cost in proportion to the input: training by runs, windows of tokens, records cut in pieces."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from openbound.operators import embed as EM
from openbound.operators import encode as EN
from openbound.operators import fit as FT
from openbound.operators import fit_epoch as FE
from openbound.operators.prototypes import Prototypes
from openbound.sources import csv_records as CR


def by_hand(rows, p, opt, batch, epoch, spark):
    from openbound.operators.sampling import shuffled_batches
    got = shuffled_batches(rows, batch, seed=epoch).orderBy("batch", "row_id").collect()
    losses = []
    for b in sorted({r["batch"] for r in got}):
        mine = [r for r in got if r["batch"] == b]
        sums = FT.partial_sums(np.array([r["xh"] for r in mine]), np.array([r["y"] for r in mine]), p, "new", 4.0)
        loss, d_p, d_m = FT.loss_and_grad(sums, p, "new", 4.0)
        p = opt.apply(p, d_p, d_m)
        losses.append(float(loss))
    return p, losses


@pytest.mark.parametrize("run_rows, jobs", [(20, 6), (32_768, 1), (3, 12)])
def test_runs_take_every_step_in_order(spark, tmp_path, monkeypatch, run_rows, jobs):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((57, 4))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    unit = spark.createDataFrame([(i, int(rng.integers(3)), v.tolist()) for i, v in enumerate(x)], "row_id long, y int, xh array<double>")
    proxy = rng.standard_normal((3, 4))
    protos = Prototypes(proxy, None, proxy + 0.1 * rng.standard_normal((3, 4)))
    monkeypatch.setattr(FE, "RUN_ROWS", run_rows)
    if run_rows < 5:
        called = []
        real = FE.aggregate_sums
        monkeypatch.setattr(FE, "aggregate_sums", lambda *a: called.append(1) or real(*a))
    p, opt, losses = FE.fit_runs(unit, protos, FT.Optimiser("new", 12, lr=1e-3), "new", 4.0, 5, str(tmp_path / "e"))
    want, want_losses = by_hand(unit, protos.copy(), FT.Optimiser("new", 12, lr=1e-3), 5, 0, spark)
    assert np.allclose(losses, want_losses, rtol=1e-12)
    assert np.allclose(p.proxy, want.proxy, rtol=1e-10) and np.allclose(p.margin_vec, want.margin_vec, rtol=1e-10)
    assert opt.step_no == 12 and (protos.proxy == proxy).all()
    if run_rows < 5:
        assert len(called) == jobs


def test_a_window_row_does_not_carry_the_whole_text(spark):
    words = [f"w{i % 7}" for i in range(23)]
    tokens = spark.createDataFrame([(1, words), (2, []), (3, None), (4, words[:5])], "row_id long, tokens array<string>")
    vocab = EN.build_vocab(tokens, 3)
    enc = EN.encode_windows(tokens, vocab, 3, max_len=5)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    got = {(r["row_id"], r["win"]): r["input_ids"] for r in enc.collect()}
    want = {(1, w): [ids.get(t, 1) for t in words[5 * w:5 * w + 5]] for w in range(5)} | {(2, 0): [], (3, 0): [], (4, 0): [ids.get(t, 1) for t in words[:5]]}
    assert got == {k: v + [0] * (5 - len(v)) for k, v in want.items()}
    plan = enc._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" not in plan


def test_mean_pool_counts_signs(spark):
    df = spark.createDataFrame([(1, [3, 4, 0]), (1, [5]), (2, [7, None]), (3, [None])], "k long, input_ids array<int>")
    got = {r["k"]: r["x"] for r in EM.mean_pool_tokens(df, ["k"], dim=3).collect()}
    sign = EM.sign_component(F.col("t"), F.col("j"), 3, 0)
    s = {(r["t"], r["j"]): r["s"] for r in spark.createDataFrame([(t, j) for t in (0, 3, 4, 5, 7) for j in range(3)], "t int, j int").select("t", "j", sign.alias("s")).collect()}
    assert got == {1: [sum(s[t, j] for t in (3, 4, 0, 5)) / 4 for j in range(3)], 2: [s[7, j] for j in range(3)], 3: [None] * 3}


def test_lines_of_a_batch_go_on_in_pieces(monkeypatch):
    monkeypatch.setattr(CR, "TEXT_BYTES", 1000)
    text = [f'"a, {i}",b' if i % 3 else None for i in range(100)] + ['"' + "x," * 2000 + '"', "p,q", '"open', 'close",z']
    batch = pa.RecordBatch.from_arrays([pa.array([t or "plain" for t in text]), pa.array(["f"] * 104), pa.array([0] * 104), pa.array(range(104)), pa.array(text, pa.string())],
                                       names=["value", "_lf", "_lb", "_lm", "_hard"])
    out = list(CR._cut_lines([batch]))
    assert len(out) > 5 and max(b.num_rows for b in out) < 20
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["_lm"] for r in rows] == list(range(104))
    assert rows[0]["_u"] is None and rows[0]["_r"] is None and rows[1]["_r"] == [["a, 1", "b"]] and rows[101]["_r"] == [["p", "q"]]
    assert [r["_u"] for r in rows[102:]] == [1, 2]
