"""Line-file sources: quoting, blank lines, unquoted commas, positional pairing."""

import os
import tempfile

import pytest

from openbound.sources import lines as SL


def _write(d, rel, text):
    p = os.path.join(d, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


@pytest.fixture()
def data_dir():
    d = tempfile.mkdtemp(prefix="ob-src-")
    _write(d, "train/label", "a\nb\noos\nc\n")
    _write(d, "train/seq.in", 'hello there\n"what, now"\nfoo &amp; bar\n안녕 x \n')
    _write(d, "valid/label", "a\nzz\n")
    _write(d, "valid/seq.in", "x\ny\n")
    _write(d, "bad/label", "a\nb\n")
    _write(d, "bad/seq.in", "one\ntwo, three\n")
    _write(d, "blank/label", "a\nb\nc\n")
    _write(d, "blank/seq.in", "one\n\nthree\n")
    _write(d, "intent_label.txt", "c\na\nb\n")
    return d


def test_csv_mode_quotes_and_pairing(spark, data_dir):
    df = SL.load_split(spark, data_dir, "train").orderBy("row_id").collect()
    assert [r["label"] for r in df] == ["a", "b", "oos", "c"]
    assert [r["text"] for r in df] == ["hello there", "what, now", "foo &amp; bar", "안녕 x "]
    assert [r["row_id"] for r in df] == [0, 1, 2, 3]


def test_unquoted_comma_raises(spark, data_dir):
    with pytest.raises(ValueError):
        SL.load_split(spark, data_dir, "bad")


def test_lines_mode_is_lossless(spark, data_dir):
    df = SL.load_split(spark, data_dir, "bad", fmt="lines").orderBy("row_id").collect()
    assert [r["text"] for r in df] == ["one", "two, three"]


def test_blank_lines_count_mismatch(spark, data_dir):
    # csv mode skips the blank line -> 2 texts for 3 labels -> refuse to misalign
    with pytest.raises(ValueError):
        SL.load_split(spark, data_dir, "blank")
    ok = SL.load_split(spark, data_dir, "blank", fmt="lines").orderBy("row_id").collect()
    assert [r["text"] for r in ok] == ["one", "", "three"]


def test_vocabulary_order(spark, data_dir):
    v = SL.read_vocabulary(spark, os.path.join(data_dir, "intent_label.txt")).orderBy("pos").collect()
    assert [(r["pos"], r["label"]) for r in v] == [(0, "c"), (1, "a"), (2, "b")]


def test_load_splits_union(spark, data_dir):
    df = SL.load_splits(spark, data_dir, ("train", "valid"))
    assert df.count() == 6
    assert sorted(r["split"] for r in df.select("split").distinct().collect()) == ["train", "valid"]


def test_line_index_many_splits(spark):
    d = tempfile.mkdtemp(prefix="ob-big-")
    n = 20000
    p = _write(d, "big.txt", "".join(f"line{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df, cnt = SL.read_lines(spark, p)
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert cnt == n
    assert all(r["value"] == f"line{r['row_id']}" for r in rows)
    assert sorted(r["row_id"] for r in rows) == list(range(n))


def test_split_tsv(spark):
    d = tempfile.mkdtemp(prefix="ob-tsv-")
    p = _write(d, "x_test.tsv", "hi there\tgreet\nbye\tleave\n")
    rows = SL.read_split_tsv(spark, p, "test").orderBy("row_id").collect()
    assert [(r["label"], r["text"]) for r in rows] == [("greet", "hi there"), ("leave", "bye")]


def test_strip_lines_and_split_labels(spark, data_dir):
    df, n = SL.read_lines(spark, os.path.join(data_dir, "train", "seq.in"), strip=True)
    assert n == 4 and [r["value"] for r in df.orderBy("row_id").collect()][3] == "안녕 x"
    labs = SL.read_split_labels(spark, data_dir, ("train", "valid"))
    got = sorted((r["split"], r["row_id"], r["label"]) for r in labs.collect())
    assert got == [("train", 0, "a"), ("train", 1, "b"), ("train", 2, "oos"), ("train", 3, "c"),
                   ("valid", 0, "a"), ("valid", 1, "zz")]
