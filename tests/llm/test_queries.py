"""The registered queries on the sf0.01 tables."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from openbound.llm import queries as Q
from openbound.llm import tokens as T
from tools.oracle_check import compare, duck

SF01 = "/root/testdata/sf0.01"
TABLE = {"op1": ("embeddings", "vec_id"), "op4": ("pages", "page_id"), "op5": ("pages", "page_id")}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    ok, msg = compare(E.queries()[name](spark, SF01).toPandas(), duck(SF01).execute(E.oracle_sql()[name]).df())
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES) - {"op2_best_fit_packing", "op12_stable_search", "op13_whitening"}))
def test_one_row_per_input_row(spark, name):
    table, key = TABLE.get(name.split("_")[0], ("documents", "doc_id"))
    want = sorted(pq.read_table(f"{SF01}/{table}.parquet", columns=[key])[key].to_pylist())
    assert sorted(r[0] for r in E.queries()[name](spark, SF01).select(key).collect()) == want


def test_token_queries_agree_with_the_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(T.default_tokenizer())
    docs = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    ids = {d["doc_id"]: np.array(e.ids + [2], "<u4") for d, e in zip(docs, tok.encode_batch([d["text"] for d in docs], add_special_tokens=False))}
    at, want = 0, []
    for i in sorted(ids):
        want.append((i, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    got = E.queries()["op3_token_wavelet"](spark, SF01).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    packed = E.queries()["op2_best_fit_packing"](spark, SF01).collect()
    for r in packed:
        assert zlib.crc32(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in packed) == at
    assert len({r["sequence_id"] for r in packed}) <= -(-at // 1024) + 1


def _vectors():
    t = pq.read_table(f"{SF01}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    return np.array([r["vec_id"] for r in t]), np.array([r["embedding"] for r in t], np.float64)


def test_search_finds_the_nearest(spark):
    ids, v = _vectors()
    got: dict = {}
    for r in sorted(E.queries()["op12_stable_search"](spark, SF01).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(ids[ids % 100 == 0])
    hits = 0
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 11))
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        for _, i, score in rows:
            assert abs(d[ids == i][0] - score) < 1e-12 and i != q
        near = np.sort(d[ids != q])[9]
        hits += sum(s <= near + 1e-12 for _, _, s in rows)
    assert hits >= 0.9 * 10 * len(got)


def test_whitening_equals_a_symmetric_solver(spark):
    ids, v = _vectors()
    x = np.floor(1024 * v) + 100000
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = (x - s / n) @ u / np.sqrt(e)
    rows = E.queries()["op13_whitening"](spark, SF01).collect()
    assert len(rows) == 8 * n
    place = {i: k for k, i in enumerate(ids)}
    got = np.zeros((n, 8))
    for r in rows:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (e[r["component"] - 1] / ((x - s / n) ** 2).sum() * n) - 1) < 1e-9
        assert r["deviation"] == sum(int(t) ** 2 for t in n * x[place[r["vec_id"]]] - s)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
