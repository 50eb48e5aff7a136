"""The reference's training run as a composition of operators.

Per epoch: mini-batch prototype steps (R3; by default B2 batches are written
once per epoch, partitioned by runs of batches, and a Spark job takes the steps
of a run; with
``barrier=True`` all steps run in one barrier stage; the batch size is the
caller's whatever the table's size), the epoch's training loss (mean of
the step losses, L9), evaluation of train, valid and test with the variant's
predictor (T2 or T3; M1, M4, M5 from one pass of per-class counts, the mean of
batch losses L9 for valid and test), and the best-epoch rule (M7/M8: valid
macro F1 >= best so far, ties -> later epoch).  The metrics log (S12) holds
every epoch's scores and learning rate and the best epoch's scores; an export
path receives the splits' embeddings (S7) in the epochs that the gate (M9)
opens: the first, and each one after an improvement.  Only prototypes and
scalar metrics reach the driver.  Training scores are those of the epoch's
last prototypes, not of each batch's own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fit as FT
from ..operators import fit_epoch as FE
from ..operators import loss as LS
from ..operators import metrics as M
from ..operators import score as S
from ..operators.indexing import dense_index
from ..operators.prototypes import Prototypes
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import exports as EX
from .openset import OpenSet


@dataclass
class RunResult:
    best_protos: Prototypes
    last_protos: Prototypes
    metrics: DataFrame                      # (run_id, epoch, split, name, value)
    best_epoch: int | None
    best_valid_f1: float
    step_losses: list = field(default_factory=list)   # (epoch, batch, loss)


def evaluate(rows: DataFrame, protos: Prototypes, variant: str, alpha: float) -> list[tuple]:
    """``(split, name, value)`` for accuracy, macro F1, in-/out-of-domain F1 and, of rows with a
    batch, the mean of the batch losses.

    Two passes over the rows: the per-class counts (everything but the loss
    derives from them; splits x classes rows, pinned as a local table) and
    the loss sums.
    """
    if "batch" not in rows.columns:
        rows = rows.withColumn("batch", F.lit(0))        # all rows of a split are one batch
    kind, _ = LS.VARIANTS[variant]
    pred = (S.reject_vector if kind == "vector" else S.reject_scalar)(rows, protos)
    counts = M.class_counts(pred, by="split")
    cc = rows.sparkSession.createDataFrame(counts.collect(), counts.schema)      # splits x classes rows
    named = lambda df, name: df.select("split", F.lit(name).alias("name"), F.col(name).alias("value"))
    io = M.ind_ood_from_counts(cc, protos.n_known, "split")
    batch_losses = LS.proxy_loss(rows.filter("batch IS NOT NULL"), protos, variant, alpha, by=["split", "batch"])
    loss = LS.epoch_loss(batch_losses, by="split").withColumnRenamed("epoch_loss", "loss")
    out = (named(M.accuracy_from_counts(cc, "split"), "accuracy").unionByName(named(M.macro_f1_from_counts(cc, "split"), "macro_f1"))
           .unionByName(named(io, "ind_f1")).unionByName(named(io, "ood_f1")).unionByName(named(loss, "loss")))
    return [(r["split"], r["name"], r["value"]) for r in out.collect()]          # five rows a split


def evaluation_rows(data: OpenSet, batch_size: int) -> DataFrame:
    """Rows of all splits, checkpointed; valid and test rows carry their batch (in row order)."""
    cols = ["row_id", "split", "y", "x"]
    out = data.split("train").select(*cols, F.lit(None).cast("long").alias("batch"))
    for name in ("valid", "test"):
        rows = dense_index(data.split(name).select(*cols), ["row_id"], "_pos")
        out = out.unionByName(rows.withColumn("batch", F.floor(F.col("_pos") / batch_size).cast("long")).drop("_pos"))
    return cut_lineage(out)


def train_and_evaluate(data: OpenSet, protos: Prototypes, variant: str = "new", alpha: float = 64.0,
                       epochs: int = 50, batch_size: int = 150, lr: float = FT.LR, clip: float = FT.CLIP,
                       run_id: str = "run", metrics_path: str | None = None,
                       bundle_path: str | None = None, export_path: str | None = None,
                       dataset: str = "dataset", ratio: float = 0.0, barrier: bool = False) -> RunResult:
    spark = data.data.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    unit = FT.unit_training_table(data.split("train").select("row_id", "y", "x"), id_col="row_id")
    n_batches = -(-unit.count() // batch_size)
    opt = FT.Optimiser(variant, max(1, epochs * n_batches), lr, clip)
    eval_rows = evaluation_rows(data, batch_size)
    p = protos.copy()
    best, best_epoch, best_score, best_scores = p.copy(), None, 0.0, []
    log, steps, gate = [], [], True
    for epoch in range(epochs):
        if barrier:
            p, opt, losses = FE.fit_epoch(unit, p, opt, variant, alpha, batch_size, epoch)
        else:
            p, opt, losses = FE.fit_runs(unit, p, opt, variant, alpha, batch_size, f"{base}/epoch={epoch}", epoch)
        steps += [(epoch, b, loss) for b, loss in enumerate(losses)]
        if losses:
            log.append((run_id, epoch, "train", "loss", float(np.mean(losses))))
        log.append((run_id, epoch, "train", "learning_rate", float(opt.proxy_lr * FT.schedule(opt.step_no, opt.total))))
        ev = evaluate(eval_rows, p, variant, alpha)
        log += [(run_id, epoch, sp, name, None if v is None else float(v)) for sp, name, v in ev]
        if export_path and gate:
            for split in ("train", "valid", "test"):
                EX.export_embeddings(eval_rows.filter(F.col("split") == split), export_path, run_id, epoch, split)
        valid_f1 = next((v for sp, name, v in ev if sp == "valid" and name == "macro_f1"), None)
        gate = valid_f1 is not None and valid_f1 >= best_score
        if gate:
            best, best_epoch, best_score = p.copy(), epoch, valid_f1
            best_scores = [(sp, f"best_{name}", v) for sp, name, v in ev if sp != "train" and name != "loss"]
    if best_epoch is not None:
        log += [(run_id, best_epoch, sp, name, None if v is None else float(v)) for sp, name, v in best_scores]
    metrics = spark.createDataFrame(log, EX.METRICS_SCHEMA)
    if metrics_path:
        EX.append_metrics(metrics, metrics_path)
    if bundle_path:
        cfg = {"variant": variant, "alpha": alpha, "epochs": epochs, "batch_size": batch_size, "lr": lr,
               "clip": clip, "best_epoch": best_epoch}
        EX.save_bundle(best, data.known, cfg, bundle_path, dataset, ratio, run_id)
    return RunResult(best, p, metrics, best_epoch, best_score, steps)
