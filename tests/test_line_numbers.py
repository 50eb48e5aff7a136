"""Line numbers that do not depend on the split size, the first-field reader, bundle runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from openbound.operators.indexing import dense_index
from openbound.operators.labels import head_slice
from openbound.operators.prototypes import Prototypes
from openbound.sources import exports as EX
from openbound.sources import csv_records as CR
from openbound.sources import lines as SL


def test_split_size_change_loses_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(60_000).select(F.col("id").cast("string")).repartitionByRange(12, F.col("id").cast("long")).write.text(path)
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "2")
        df, n = SL.read_lines(spark, path)
        spark.conf.set(keys[0], "64")
        spark.conf.set(keys[1], "4000")
        r = df.agg(F.count("*"), F.countDistinct("row_id"), F.max("row_id"), F.sum((F.col("row_id") != F.col("value").cast("long")).cast("int"))).first()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == 60_000 and tuple(r) == (60_000, 60_000, 59_999, 0)


def _file(tmp_path, text):
    p = tmp_path / "f"
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_first_field(spark, tmp_path):
    df, n = SL.read_first_field(spark, _file(tmp_path, 'plain\n"a, b"\n\n  \n"say ""hi"", x"\nmid"quote\n"x"y\nNA\n""\n'))
    assert [r["value"] for r in df.orderBy("row_id").collect()] == ["plain", "a, b", 'say "hi", x', 'mid"quote', "xy", "NA", ""] and n == 7


@pytest.mark.parametrize("line", ["hello,", "x,,tail", "a,b", '"q",', '"a" ,b', '"open'])
def test_more_fields_raise(spark, tmp_path, line):
    with pytest.raises(ValueError, match="line 1 "):
        SL.read_first_field(spark, _file(tmp_path, f"first\n{line}\nlast\n"))


def test_field_round_trip(spark):
    rows = ["", "a", "a,b", 'q"q', '"', '",', "x\u0085y", "\u2028,", "two\nlines", "cr\r", "\r\n\""]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(SL.csv_field("t").alias("value"), "t")
    assert all(CR.cut_records(r["value"] + ",x") == [[r["t"], "x"]] for r in df.collect())


def test_bundle_runs_are_text(spark, tmp_path):
    known = spark.createDataFrame([(0, "a")], "cls int, label string")
    for run, v in (("1", 1.0), ("01", 2.0)):
        EX.save_bundle(Prototypes(np.full((2, 2), v)), known, {"run": run}, str(tmp_path / "b"), "d", 0.5, run)
    for run, v in (("1", 1.0), ("01", 2.0)):
        protos, _, cfg = EX.load_bundle(spark, str(tmp_path / "b"), "d", 0.5, run)
        assert protos.proxy.tolist() == [[v, v], [v, v]] and cfg == {"run": run}


def test_dense_index_on_text_keys_and_hot_first_column(spark):
    rows = [("b" if i % 3 else "a", f"k{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k string").repartition(7)
    got = [(r["g"], r["k"], r["pos"]) for r in dense_index(df, ["g", "k"]).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(*r, i) for i, r in enumerate(sorted(rows))]
    head = head_slice(df, 5, ["g", "k"]).collect()
    assert [(r["g"], r["k"], r["pos"]) for r in head] == [(*r, i) for i, r in enumerate(sorted(rows)[:5])]
