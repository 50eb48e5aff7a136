"""Streaming scoring equals batch scoring; per-batch confusion sink sums to the batch matrix."""

import os
import tempfile

from pyspark.sql import functions as F

from openbound.operators import metrics as M
from openbound.operators import score as S
from openbound.plans import catalog
from openbound.streaming import scoring as ST
from tests.conftest import SF001


def test_stream_matches_batch(spark):
    os_, protos = catalog.emb_setup(spark, SF001)
    rows = os_.data.filter(F.col("split").isin("valid", "test")).select("row_id", "y", "x")
    src = tempfile.mkdtemp(prefix="ob-stream-src-")
    rows.repartition(4).write.mode("overwrite").parquet(os.path.join(src, "in"))
    sink = tempfile.mkdtemp(prefix="ob-stream-sink-")
    ckpt = tempfile.mkdtemp(prefix="ob-stream-ckpt-")
    stream = ST.read_embedding_stream(spark, os.path.join(src, "in"), rows.schema, max_files_per_trigger=1)
    scored = ST.score_stream(stream, protos, "scalar")
    q = (scored.writeStream.foreachBatch(ST.confusion_sink(os.path.join(sink, "cm")))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r["y"], r["pred"]): r["n"] for r in ST.running_confusion(spark, os.path.join(sink, "cm")).collect()}
    want = {(r["y"], r["pred"]): r["n"]
            for r in M.confusion_counts(S.reject_scalar(rows, protos)).collect()}
    assert got == want
