"""Registered queries: memory-based predictors (T5, T6), prototype init."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed as EM
from ..operators import encode as EN
from ..operators import knn_pruned as KP
from ..operators import layout as LY
from ..operators import neighbors as NB
from ..operators import project as PR
from . import views
from .catalog import _eval_rows, _r, emb_setup

K = 5
VOCAB = 1000
MAX_LEN = 50
DIM = 16


def _doc_tokens(spark, sf):
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return EN.tokenize(d, "text")


def _encoded(spark, sf):
    tk = _doc_tokens(spark, sf)
    vocab = EN.build_vocab(tk, VOCAB)
    return EN.encode(tk, vocab, VOCAB, max_len=MAX_LEN)


def q_r1_vocab(spark, sf):
    return EN.build_vocab(_doc_tokens(spark, sf), VOCAB)


def q_r1_encode(spark, sf):
    enc = _encoded(spark, sf)
    z = F.arrays_zip(F.col("input_ids").alias("t"), F.col("attention_mask").alias("m"))
    return enc.select("row_id", F.posexplode(z).alias("pos", "z")).select(
        "row_id", F.col("pos").cast("int").alias("pos"), F.col("z.t").alias("token_id"),
        F.col("z.m").alias("mask"))


def q_r1_token_stats(spark, sf):
    tk = _doc_tokens(spark, sf)
    return EN.token_stats(tk, EN.build_vocab(tk, VOCAB), VOCAB)


def _long(df, col):
    return df.select("row_id", F.posexplode(col).alias("dim", "v")).select(
        "row_id", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def q_r2_embed(spark, sf):
    return _long(EM.embed_text(_doc_tokens(spark, sf), "row_id", dim=DIM), "x")


def q_v9_mean_pool(spark, sf):
    """V9 over whole texts: every 50-token window encoded to fixed length and pooled over all its
    positions, padding included."""
    from ..session import written_table
    # read by the vocabulary and by the windows: tokenised once
    tk = written_table(_doc_tokens(spark, sf))
    enc = EN.encode_windows(tk, EN.build_vocab(tk, VOCAB), VOCAB, max_len=MAX_LEN)
    pooled = EM.mean_pool_tokens(enc, ["row_id", "win"], "input_ids", DIM)
    return pooled.select("row_id", "win", F.posexplode("x").alias("dim", "v")).select(
        "row_id", "win", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def q_r4_pca(spark, sf):
    os_, _ = emb_setup(spark, sf)
    out = PR.pca_project(os_.data.select("row_id", "y", "x"), "x", 2, ["row_id", "y"])
    return out.select("row_id", F.col("y").alias("target"), "pc0", "pc1")


def q_r4_neighbours(spark, sf):
    """The neighbour graph of the layout: the ten other rows nearest to every row."""
    os_, _ = emb_setup(spark, sf)
    near = LY.euclidean_neighbours(os_.data.select("row_id", "x"), 10)
    return near.select("row_id", "rank", F.col("nbr").alias("neighbour"), _r(F.col("dist2"), "dist2"))


def q_r4_layout(spark, sf):
    """Neighbour-preserving 2-D layout of the rows of all splits."""
    os_, _ = emb_setup(spark, sf)
    at = LY.neighbour_layout(os_.data.select("row_id", "x"))
    return os_.data.select("row_id", F.col("y").alias("target")).join(at, "row_id")


def _memory_based(spark, sf, predict, **how):
    """T5 and T6 over the rows of all splits, the training rows as index."""
    os_, protos = emb_setup(spark, sf)
    train = os_.split("train").select("row_id", "y", "x")
    return predict(os_.data.select("row_id", "x"), train, protos, **how).select("row_id", "pred")


def q_t5_knn_vote(spark, sf):
    return _memory_based(spark, sf, NB.knn_vote, k=K)


def q_t5_knn_vote_blocked(spark, sf):
    """T5 by block pairs, the way beyond the broadcast bound."""
    return _memory_based(spark, sf, NB.knn_vote, k=K, broadcast_limit=0, block_rows=200)


def q_t5_knn_vote_pruned(spark, sf):
    """T5 by cells and angle bounds."""
    return _memory_based(spark, sf, lambda *a, **kw: KP.knn_vote_pruned(*a, **kw)[0], k=K)


def q_j6_topk_pruned(spark, sf):
    """J6 itself: the five nearest index rows of every row, by inner product."""
    os_, protos = emb_setup(spark, sf)
    index = NB.index_frame(os_.split("train").select("row_id", "y", "x"), protos)
    top, _ = KP.similarity_topk(os_.data.select(F.col("row_id").alias("qid"), "x"), index, K)
    return top.select(F.col("qid").alias("row_id"), "rank", "kind", "iid", "label", _r(F.col("score"), "score"))


def q_t6_class_average(spark, sf):
    return _memory_based(spark, sf, NB.class_average_predict)


def q_t6_class_average_blocked(spark, sf):
    """T6 by block pairs, the way beyond the broadcast bound."""
    return _memory_based(spark, sf, NB.class_average_predict, broadcast_limit=0, block_rows=200)


def q_r5_centroid(spark, sf):
    _, protos = emb_setup(spark, sf)
    pf = protos.to_frame(spark)
    return pf.select("cls", F.posexplode("proxy").alias("dim", "v")).select(
        "cls", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def q_r5_random(spark, sf):
    """Seeded normal numbers for every class of the label space, as long as the vectors."""
    from ..operators import prototypes as PT
    _, protos = emb_setup(spark, sf)
    v = PT.random_vectors(protos.to_frame(spark).select("cls"), protos.proxy.shape[1], seed=7)
    return v.select("cls", "dim", _r(F.col("value"), "value"))


def q_r3_fit(spark, sf):
    """Fit proxies and margin vectors (variant ``new``, alpha 4, 6 steps) on
    the training split, then score valid and test with the fitted set."""
    from ..operators import fit as FT
    from ..operators import score as S
    os_, protos = emb_setup(spark, sf, margin_vectors=True)
    res = FT.fit_prototypes(os_.split("train").select("y", "x"), protos, "new", alpha=4.0, steps=6, lr=1e-3)
    return S.reject_vector(_eval_rows(os_).select("row_id", "x"), res.protos).select("row_id", "pred")


def q_r3_partials(spark, sf):
    """What one gradient step gathers over the training split (variant ``new``, alpha 4): the sums
    of weights, weighted similarities and weighted unit vectors per class and kind."""
    from ..operators import fit as FT
    os_, protos = emb_setup(spark, sf, margin_vectors=True)
    unit = FT.unit_training_table(os_.split("train").select("y", "x"))
    sums = FT.class_partials(unit, protos, "new", 4.0)
    return sums.select("cls", "kind", _r(F.col("w"), "w"), _r(F.col("ws"), "ws"), "npos", F.posexplode("xs").alias("dim", "v")).select(
        "cls", "kind", "w", "ws", "npos", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "xs"))


def q_r3_epoch(spark, sf):
    """One epoch in a barrier stage with all training rows as its batch (variant ``new``, alpha 4):
    the prototypes and margin vectors after the step, and its loss."""
    from ..operators import fit as FT
    from ..operators import fit_epoch as FE
    os_, protos = emb_setup(spark, sf, margin_vectors=True)
    unit = FT.unit_training_table(os_.split("train").select("row_id", "y", "x"), id_col="row_id")
    p, _, losses = FE.fit_epoch(unit, protos, FT.Optimiser("new", 1, lr=1e-3), "new", 4.0, max(1, unit.count()))
    pf = p.to_frame(spark).select("cls", F.posexplode(F.arrays_zip("proxy", "margin_vec")).alias("dim", "z"))
    return pf.select("cls", F.col("dim").cast("int").alias("dim"), _r(F.col("z.proxy"), "proxy"), _r(F.col("z.margin_vec"), "margin"),
                     _r(F.lit(losses[0]), "loss"))


def q_s7_s8_tsv_round_trip(spark, sf):
    """Export every split as the reference's TSV pair (S7) into fresh folders
    under the shared checkpoint directory, read them back (S8: line
    numbers, positional zip) and return them in long form."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import exports as EX
    os_, _ = emb_setup(spark, sf)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tsv-{uuid.uuid4().hex}"
    out = None
    for sp in ("train", "valid", "test"):
        EX.write_tsv_pair(os_.split(sp).select("row_id", "x", "y"), f"{base}/{sp}/x", f"{base}/{sp}/y")
        back = EX.read_tsv_pair(spark, f"{base}/{sp}/x", f"{base}/{sp}/y").select(F.lit(sp).alias("split"), "*")
        out = back if out is None else out.unionByName(back)
    return out.select("split", "row_id", "target", F.posexplode("x").alias("dim", "v")).select(
        "split", "row_id", "target", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def q_s7_parquet_round_trip(spark, sf):
    """S7 as parquet, partitioned by run, epoch and split; the test split is read back by its
    partition, the others through the whole export."""
    from ..sources import exports as EX
    os_, _ = emb_setup(spark, sf)
    path = _scratch(spark, "export")
    for sp in ("train", "valid", "test"):
        EX.export_embeddings(os_.split(sp), path, "01", 1, sp)
    test = EX.read_embeddings(spark, path, "01", 1, "test")
    rest = EX.read_embeddings(spark, path).filter(F.col("split") != "test")
    return test.unionByName(rest).select("run_id", "epoch", "split", "row_id", "y", F.posexplode("embedding").alias("dim", "v")).select(
        "run_id", "epoch", "split", "row_id", "y", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def q_s1_s3_line_files_round_trip(spark, sf):
    """Write documents (label = source, raw text with its commas and quotes, line breaks as
    spaces) in the reference layout, then load all three splits back through the CSV line
    reader (S1), positional pairing (S2) and the split union (S3); the
    vocabulary file is read back with S4."""
    import uuid

    from ..operators import labels as L
    from ..session import ensure_checkpoint_dir
    from ..sources import exports as EX
    from ..sources import lines as SL
    docs = views.document_splits(spark, sf).withColumn("text", F.regexp_replace("text", "[\r\n]+", " "))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    EX.write_line_files(docs, base, vocab=L.vocab_first_seen(docs))
    back = SL.load_splits(spark, base)
    vocab = SL.read_vocabulary(spark, f"{base}/intent_label.txt")
    return back.join(vocab, "label").select("split", "row_id", "label", "pos", "text")


def q_s1_quoted_line_ends_round_trip(spark, sf):
    """Documents with their own line ends, commas and quotes written as two-column CSV (text,
    source) in document order, then both columns read back by record."""
    from ..session import cut_lineage
    from ..sources import csv_records as CR
    from ..sources import lines as SL
    docs = views.document_splits(spark, sf).select("row_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    path = _scratch(spark, "records")
    cut_lineage(docs.orderBy("row_id")).select(F.concat_ws(",", SL.csv_field("text"), SL.csv_field("label")).alias("value")).write.text(path)
    back, _ = CR.read_records(spark, path)
    return back.select("row_id", F.col("fields")[0].alias("text"), F.col("fields")[1].alias("label"), F.size("fields").alias("n_fields"))


def q_r5_label_text(spark, sf):
    """Label-text prototype init on the document setting: class c's text is every ``benchmark``
    passage with item_id mod n_known = c (stand-in label descriptions), the out-of-domain class's
    text is its name."""
    from ..operators import labels as L
    from .catalog import RATIO
    from .openset import prepare
    os_ = prepare(views.document_splits(spark, sf), RATIO)
    bench = views.table(spark, sf, "benchmark").select((F.col("item_id") % os_.n_known).cast("int").alias("cls"), "text")
    texts = bench.unionByName(spark.createDataFrame([(os_.n_known, L.OOS_LABEL)], "cls int, text string"))
    pf = EM.label_text_prototypes(texts, os_.n_classes, DIM).to_frame(spark)
    return pf.select("cls", F.posexplode("proxy").alias("dim", "v")).select(
        "cls", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def q_r3_train_run(spark, sf):
    """The reference's training run in small: 2 epochs of mini-batch steps
    (batch 64, alpha 4) on the training split, valid/test evaluation per
    epoch; returns the metrics log (run_id, epoch, split, name, value)."""
    from .training import train_and_evaluate
    os_, protos = emb_setup(spark, sf, margin_vectors=True)
    res = train_and_evaluate(os_, protos, "new", alpha=4.0, epochs=2, batch_size=64, lr=1e-3, run_id="r3")
    return res.metrics


def q_e2e_text_openset(spark, sf):
    """The text path end to end on ``documents`` (label = source): whole texts embedded (R2),
    label space + centroid prototypes (one aggregation), T3 rejection on all splits,
    confusion cells per split."""
    from ..operators import metrics as M
    from ..operators import score as S
    from .catalog import RATIO
    from ..session import written_table
    from .openset import prepare_with_prototypes
    emb = EM.embed_text(_doc_tokens(spark, sf), "row_id", dim=DIM)
    # read by the prototypes and by the scores: embedded once
    docs = written_table(views.document_splits(spark, sf).select("row_id", "split", "label").join(emb, "row_id"))
    os_, protos = prepare_with_prototypes(docs, RATIO)
    return M.confusion_counts(S.reject_scalar(os_.data, protos), by="split")


def _scratch(spark, what):
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def q_s10_s11_bundle_round_trip(spark, sf):
    """Save the centroid prototype set with its known labels and config (S10),
    load it back by partition (S11), return proxies and margins long."""
    from ..sources import exports as EX
    os_, protos = emb_setup(spark, sf)
    path = _scratch(spark, "bundle")
    EX.save_bundle(protos, os_.known, {"variant": "org", "ratio": 0.5}, path, "embeddings", 0.5, "r1")
    back, _, _ = EX.load_bundle(spark, path, "embeddings", 0.5, "r1")
    return back.to_frame(spark).select("cls", "margin", F.posexplode("proxy").alias("dim", "v")).select(
        "cls", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"), _r(F.col("margin"), "margin"))


def q_s12_metrics_log_round_trip(spark, sf):
    """Append per-split accuracy and macro F1 of the scalar-margin predictor to
    a metrics log (S12) in two appends, read the log back."""
    from ..operators import metrics as M
    from ..operators import score as S
    from ..sources import exports as EX
    os_, protos = emb_setup(spark, sf)
    pred = S.reject_scalar(_eval_rows(os_), protos)
    path = _scratch(spark, "metrics")
    acc = M.accuracy(pred, by="split").select("split", F.lit("accuracy").alias("name"),
                                              F.col("accuracy").alias("value"))
    f1 = M.macro_f1(pred, by="split").select("split", F.lit("macro_f1").alias("name"),
                                             F.col("macro_f1").alias("value"))
    for i, part in enumerate((acc, f1)):
        EX.append_metrics(part.select(F.lit("r1").alias("run_id"), F.lit(i).alias("epoch"), "*"), path)
    log = spark.read.parquet(path)
    return log.select("run_id", "epoch", "split", "name", _r(F.col("value"), "value"))


def q_s13_split_tsv_round_trip(spark, sf):
    """Write each document split as a ``text<TAB>label`` file (text normalised
    to one line) and load it back with the per-split TSV reader (S13)."""
    from ..functions.text import normalize_rows
    from ..session import written_table
    from ..sources import exports as EX
    from ..sources import lines as SL
    # each split is sampled and sorted: normalised once for all
    docs = written_table(normalize_rows(views.document_splits(spark, sf), "text"))
    base = _scratch(spark, "tsv13")
    out = None
    for sp in ("train", "valid", "test"):
        EX.write_split_tsv(docs.filter(F.col("split") == sp), f"{base}/{sp}.tsv")
        part = SL.read_split_tsv(spark, f"{base}/{sp}.tsv", sp)
        out = part if out is None else out.unionByName(part)
    return out.select("split", "row_id", "label", "text")


def q_s6_split_label_profile(spark, sf):
    """Write the document splits in the reference layout, read the three label
    files back (S6) and profile them: value counts per split (M10)."""
    from ..functions.text import normalize_rows
    from ..sources import exports as EX
    from ..sources import lines as SL
    docs = normalize_rows(views.document_splits(spark, sf), "text")
    base = _scratch(spark, "labels6")
    EX.write_line_files(docs, base)
    labs = SL.read_split_labels(spark, base)
    return labs.groupBy("split", "label").agg(F.count(F.lit(1)).alias("count"))


def q_s9_balanced_sample_tsv(spark, sf):
    """B1 balanced sample (30 per class) written as the reference's TSV pair
    (S9) and read back by line (S8): positions follow row order."""
    from ..operators import sampling as SM
    from ..sources import exports as EX
    e = views.embedding_splits(spark, sf).select("row_id", F.col("label").cast("int").alias("y"), "x")
    sample = SM.balanced_sample(e, "y", 30, seed=42)
    base = _scratch(spark, "sample9")
    EX.write_tsv_pair(sample, f"{base}/x", f"{base}/y")
    back = EX.read_tsv_pair(spark, f"{base}/x", f"{base}/y")
    return back.select("row_id", "target", F.posexplode("x").alias("dim", "v")).select(
        "row_id", "target", F.col("dim").cast("int").alias("dim"), _r(F.col("v"), "value"))


def q_s1b_strip_lines(spark, sf):
    """Normalised document texts written one per line, read back with the
    plain line reader and its ``strip`` (S1b)."""
    from ..functions.text import normalize_rows
    from ..sources import lines as SL
    from ..session import cut_lineage
    docs = normalize_rows(views.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text"),
                          "text")
    path = _scratch(spark, "lines1b")
    cut_lineage(docs.orderBy("row_id")).select(F.col("text").alias("value")).write.text(path)
    back, _ = SL.read_lines(spark, path, strip=True)
    return back


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
