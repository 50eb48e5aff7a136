import base64
import gzip
import hashlib

import pytest

from openbound.llm import warc as W

PAGES = "page_id long, url string, html string, id int, h1 string, n int, payload string, top int"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2, "y", 3) for i, u, h in rows], PAGES)


ROWS = [(1, "http://a/1", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://b", None),
        (5, "http://c", ""), (6, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 5), (8, "http://e", "x" * 300_000), (9, "http://e", "x" * 300_000),
        (None, "http://n", "<p>same</p>"), (11, "http://t", "t"), (11, "http://t", "t")]


def _want(rows):
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        top = max((j for j, _, g in rows if j is not None and (g or "") == (h or "")), default=None)
        revisit = i != top
        out.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    top if revisit else None, u))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    folder = f"file:{tmp_path}/w"
    got = W.page_records(_pages(spark, ROWS), folder).collect()
    assert sorted(((str(r["page_id"]), *r[1:]) for r in got), key=str) == _want(ROWS)
    # the archives are gzip members of plain WARC records
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) and not (tmp_path / "w" / "_pending").exists()


def test_pushdown_and_splits(spark, tmp_path):
    folder = str(tmp_path / "w")
    W.write_archive(W.dedup_payloads(_pages(spark, ROWS)), folder, file_bytes=600)
    r = W.WarcReader({"path": folder, "splitbytes": "40"}, None)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    rest = list(r.pushFilters([EqualTo(("warc_type",), "revisit"), In(("target_uri",), ("http://a/1", "http://e")),
                               GreaterThan(("payload_length",), 3)]))
    assert len(rest) == 1
    parts = r.partitions()
    assert len(parts) > len(ROWS)
    rows = [x for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert {x["target_uri"] for x in rows} == {"http://a/1", "http://e"}
    df = W.read_archive(spark, folder).filter("warc_type = 'response' AND target_uri = 'http://d'")
    assert [bytes(x["payload"]).decode() for x in df.collect()] == [ROWS[5][2]]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "target_uri" in plan
    brief = W.read_archive(spark, folder, payload=False).collect()
    assert len(brief) == len(ROWS) and all(x["payload"] is None for x in brief)
    assert {x["payload_length"] for x in brief} == {len((h or "").encode()) for _, _, h in ROWS}


def test_headers_decide_before_payloads():
    rec = W.record_bytes({"WARC-Type": "response", "WARC-Target-URI": "u", "Content-Type": W.HTTP_TYPE}, W.http_block(b"z" * 10**6, 10**6))
    r = W._Inflater(memoryview(W.member(rec)), 0, True)
    r.header()
    assert len(r.out) < 10**5
    plain = rec + W.record_bytes({"WARC-Type": "request"}, b"q")
    for data in (plain, W.member(rec) + W.member(W.record_bytes({"WARC-Type": "request"}, b"q"))):
        rows = list(W.scan(memoryview(data), {}, True))
        assert [(x[0], len(x[-1])) for x in rows] == [("response", 10**6), ("request", 1)]
        assert [x[0] for x in W.scan(memoryview(data), {"warc_type": {"request"}}, False)] == ["request"]
    with pytest.raises(ValueError):
        list(W.scan(memoryview(b"nonsense\r\n\r\n"), {}, True))


def test_empty(spark, tmp_path):
    assert W.page_records(_pages(spark, []), str(tmp_path / "e")).count() == 0


ODD = ["http://a/\r\n\r\nzz", "http://a/\r\nWARC-Type: revisit", "http://a/\nContent-Length: 1", "http://a/\r", " http://a/ ", "\thttp://a", "http://a/\u00a0",
       "http://a/\x00b", "http://a/\x85\u2028x", "", " ", "\r\n", "http://a/%0D%0A", "WARC/1.1\r\n\r\n", "http://\u00e9.example/:a: b"]


def test_any_url_comes_back(spark, tmp_path):
    rows = [(i, u, f"<p>{i // 2}</p>") for i, u in enumerate(ODD)]
    got = W.page_records(_pages(spark, rows), str(tmp_path / "w")).collect()
    assert sorted(((str(r["page_id"]), *r[1:]) for r in got), key=str) == _want(rows)
    r = W.WarcReader({"path": str(tmp_path / "w")}, None)
    from pyspark.sql.datasource import EqualTo
    assert list(r.pushFilters([EqualTo(("target_uri",), ODD[1])])) == []
    assert [x["target_uri"] for p in r.partitions() for b in r.read(p) for x in b.to_pylist()] == [ODD[1]]


def test_header_values_are_one_line():
    for u in ODD:
        v = W.header_value(u)
        assert v == v.strip() and not any(c in v for c in "\r\n\0") and (v == u or "%" in v)


def test_a_record_without_length_names_its_place(tmp_path):
    (tmp_path / "x.warc").write_bytes(W.record_bytes({"WARC-Type": "request"}, b"q") + b"WARC/1.1\r\nWARC-Type: request\r\n\r\nq\r\n\r\n")
    r = W.WarcReader({"path": str(tmp_path)}, None)
    with pytest.raises(ValueError, match="x.warc, from byte 0: the record at byte .* has no length"):
        [list(r.read(p)) for p in r.partitions()]
