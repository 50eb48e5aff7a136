"""Records with quoted line ends, against pandas, under several split sizes."""

import io
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from openbound.sources import csv_records as CR
from openbound.sources import lines as SL


def want(text):
    """The reference's own call, columns as text."""
    try:
        df = pd.read_csv(io.StringIO(text, newline=""), header=None, dtype=str, keep_default_na=False, na_values=[])
    except pd.errors.EmptyDataError:
        return []
    return [[None if isinstance(x, float) else x for x in row] for row in df.values.tolist()]


def got(spark, path, size=None):
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out, n = CR.read_records(spark, path)
        rows = sorted(map(tuple, out.select("row_id", "fields").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r for r, _ in rows] == list(range(n))
    return [list(f) for _, f in rows]


def padded(rows):
    w = max((len(r) for r in rows), default=0)
    return [r + [None] * (w - len(r)) for r in rows]


CASES = [
    "a\nb\nc\n", "", "\n\n", "a", '"a\nb",c\nd,e\n', '"a ""q""\n\n\n x",1\n\n2,"y\nz"\n', 'x,"1\r\n2"\r\ny,3\r\n', 'a 5" pipe,b\n"c"d,e\n',
    '"",x\n,"y\n"\n', '"l1\nl2"\n"l3\nl4"\n', 'a\rb\r\nc\n', '"one\rtwo",z\rq,"w"\r', ' \t\n a\n', '"a,b",c\n"d\n,e",f\ng\n', '"""\n""",x\n', '"x"\n"\n"\n',
]


def plain(rows):
    """Missing fields as pandas shows them when empty text is no missing value."""
    return [["" if x is None else x for x in r] for r in padded(rows)]


def test_records_equal_the_reference_reader():
    for text in CASES:
        assert plain(CR.cut_records(text)) == want(text), text


def test_files_equal_the_reference_reader(spark, tmp_path):
    p = tmp_path / "f.csv"
    for i, size in ((1, None), (4, None), (5, 5), (13, 9)):
        p.write_bytes(CASES[i].encode())
        assert plain(got(spark, str(p), size)) == want(CASES[i]), i


def test_line_function_by_walking():
    """The two-state function of a line against a walk over its characters."""
    def walk(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "quote" if c == '"' else state
            elif state == "quote":
                state = "quoted" if c == '"' else "start" if c in ",\r" else "plain"
            elif c in ",\r":
                state = "start"
            else:
                state = "quoted" if state == "start" and c == '"' else "plain"
        return state == "quoted"
    for n in range(7):
        for chars in itertools.product('",a\r', repeat=n):
            line = "".join(chars)
            for inside in (False, True):
                assert CR.ends_inside(line, inside) == walk(line, inside), (line, inside)


def test_random_files_under_split_sizes(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(list('ab ,"\n\ré'), rng.integers(0, 40)))
        rows.append('"' + text.replace('"', '""') + '",' + ("plain" if rng.random() < 0.5 else '"x\n\n"') + ("\n\n" if rng.random() < 0.1 else "\n"))
    text = "".join(rows)
    p = tmp_path / "f.csv"
    p.write_bytes(text.encode())
    for size in (None, 50, 777):
        assert got(spark, str(p), size) == want(text)


def test_quotes_over_many_splits_and_part_files(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    a = 'h,1\n"' + "line, with \"\"quotes\"\"\n" * 500 + 'end",2\nz,3\n'
    b = '"second\nfile",4\n' + "".join(f"r{i},{i}\n" for i in range(50))
    (d / "part-00000.csv").write_bytes(a.encode())
    (d / "part-00001.csv").write_bytes(b.encode())
    for size in (None, 300):
        assert got(spark, str(d), size) == want(a) + want(b)


def test_errors(spark, tmp_path):
    p = tmp_path / "f.csv"
    for text, what in (('a,"b\nc\n', "line 0 opens a quoted field that does not end"), ("a\nb,c\n", "line 1 has more fields"), ('"a\nb"\n\nq\n"x\ny",z\n', "line 2 has more fields")):
        p.write_bytes(text.encode())
        with pytest.raises(ValueError, match=what):
            CR.read_records(spark, str(p))


def test_columns_and_split_loading(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "label").write_text('a,0\n"b\nb",1\nc\n')
    (tmp_path / "train" / "seq.in").write_text('"first\nsecond",x\n"say ""hi"", you",y\nlast,z\n')
    rows = SL.load_split(spark, str(tmp_path), "train").orderBy("row_id").collect()
    assert [(r["label"], r["text"]) for r in rows] == [("a", "first\nsecond"), ("b\nb", 'say "hi", you'), ("c", "last")]
    second, n = CR.read_column(spark, str(tmp_path / "train" / "label"), 1)
    assert n == 3 and [r["value"] for r in second.orderBy("row_id").collect()] == ["0", "1", None]


def _scratch_bytes(spark):
    import os

    from openbound.session import ensure_checkpoint_dir
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_a_text_is_kept_once_on_the_way_through(spark, tmp_path):
    from openbound.sources import exports as EX
    from openbound.sources import lines as SL
    text = F.concat_ws(",", *[F.sha2(F.concat(F.col("id"), F.lit(str(i))), 512) for i in range(16)])
    docs = spark.range(1000).select(F.col("id").alias("row_id"), F.lit("test").alias("split"), (F.col("id") % 7).cast("string").alias("label"), text.alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    before = _scratch_bytes(spark)
    EX.write_line_files(docs, str(tmp_path), splits=("test",))
    back = SL.load_split(spark, str(tmp_path), "test")
    kept = _scratch_bytes(spark) - before
    assert back.join(docs, ["row_id", "label", "text"]).count() == back.count() == 1000
    assert kept < 1.2 * size


def test_rows_with_equal_ids_keep_their_labels(spark, tmp_path):
    from openbound.sources import exports as EX
    from openbound.sources import lines as SL
    docs = spark.range(400).select((F.col("id") % 5).alias("row_id"), F.lit("test").alias("split"), (F.col("id") % 3).cast("string").alias("label"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    EX.write_line_files(docs.repartition(7), str(tmp_path), splits=("test",))
    back = SL.load_split(spark, str(tmp_path), "test")
    assert {(r["label"], r["text"]) for r in back.collect()} == {(r["label"], r["text"]) for r in docs.collect()}
