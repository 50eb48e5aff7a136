"""One epoch of mini-batch steps as one Spark job, or as a job per run of small batches.

The training rows are dealt to tasks by a hash of their id and sorted by batch inside a task.  The
tasks run together as a barrier stage.  For every batch each task computes the class sums of its
own rows, all tasks exchange these sums (``BarrierTaskContext.allGather``), add them in the order
of the tasks and take the same optimisation step; so every task holds the same prototypes and
optimiser state all the time, and no job, folder or driver round trip is needed per step.  A task
reads its rows as a stream and holds one batch at a time.  The batch size is the caller's whatever
the table's size.

If a task is lost Spark runs the whole stage again; every attempt starts from the prototypes and
the optimiser state of the epoch's start, which are sent with the job, so it makes the same steps.

Costs: Spark looks once a second whether a barrier call is answered, so a step takes about a
second however small it is (measured: 450 steps of one row in some 500 s); a job per step
(``fit.aggregate_sums``) takes less where the scheduler is quick and the table small, and more
where a job of many tasks is slow to start.  A step exchanges four vectors per class and task
(``classes * dim * 32`` bytes) through the driver's coordinator.

``fit_runs``, for batches far smaller than a task's work: every step needs the prototypes of the step
before, so a job per step waits for Spark far longer than it counts.  The epoch's rows are dealt in
runs of whole batches, ``RUN_ROWS`` rows at most; a job reads the next run from the shared folder,
takes its steps in one task and returns the prototypes and the optimiser state.  A batch beyond
``RUN_ROWS`` rows is a run of its own, whose step is a job over all tasks (``fit.aggregate_sums``).
"""

from __future__ import annotations

import base64
import copy
import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import _KINDS, Optimiser, aggregate_sums, loss_and_grad, partial_sums
from .prototypes import Prototypes
from .sampling import shuffled_batches

RUN_ROWS = 32_768      # rows whose steps one task takes
OUT = "task int, state binary"


def pack_sums(sums: dict | None, n_classes: int, dim: int) -> bytes:
    """The class sums of a block as one run of doubles; no block: zeros."""
    if sums is None:
        return np.zeros(n_classes * (4 * (dim + 2) + 1)).tobytes()
    parts = [sums["npos"].astype(float)]
    for k in _KINDS:
        w, ws, xs = sums[k]
        parts += [w, ws, xs.ravel()]
    return np.concatenate(parts).tobytes()


def unpack_sums(total: np.ndarray, n_classes: int, dim: int) -> dict:
    out, at = {"npos": total[:n_classes]}, n_classes
    for k in _KINDS:
        w, ws = total[at:at + n_classes], total[at + n_classes:at + 2 * n_classes]
        at += 2 * n_classes
        out[k] = (w, ws, total[at:at + n_classes * dim].reshape(n_classes, dim))
        at += n_classes * dim
    return out


class _Rows:
    """The rows of one batch after another from a stream sorted by batch."""

    def __init__(self, batches):
        self.batches, self.held = batches, []

    def take(self, number: int) -> tuple[np.ndarray, np.ndarray] | None:
        xs, ys = [], []
        while True:
            while self.held:
                b, y, x = self.held[0]
                n = int(np.searchsorted(b, number, side="right"))
                if n:
                    xs.append(x[:n])
                    ys.append(y[:n])
                if n < len(b):
                    self.held[0] = (b[n:], y[n:], x[n:])
                    return (np.concatenate(xs), np.concatenate(ys)) if xs else None
                self.held.pop(0)
            got = next(self.batches, None)
            if got is None:
                return (np.concatenate(xs), np.concatenate(ys)) if xs else None
            if got.num_rows:
                x = got.column(2).flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
                self.held.append((got.column(0).to_numpy(), got.column(1).to_numpy(), x))


def _steps(shipped, n_batches: int, variant: str, alpha: float):
    def run(batches):
        from pyspark import BarrierTaskContext
        ctx = BarrierTaskContext.get()
        protos, opt = pickle.loads(shipped.value)
        rows, losses = _Rows(iter(batches)), []
        c, dim = protos.n_classes, protos.dim
        for number in range(n_batches):
            mine = rows.take(number)
            sums = None if mine is None else partial_sums(mine[0], mine[1], protos, variant, alpha)
            told = ctx.allGather(base64.b64encode(pack_sums(sums, c, dim)).decode())
            total = np.zeros(c * (4 * (dim + 2) + 1))
            for raw in told:                     # in the order of the tasks
                total += np.frombuffer(base64.b64decode(raw))
            loss, d_p, d_m = loss_and_grad(unpack_sums(total, c, dim), protos, variant, alpha)
            protos = opt.apply(protos, d_p, d_m)
            losses.append(float(loss))
        if ctx.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([cloudpickle.dumps((protos, opt, losses))], pa.binary())], names=["task", "state"])
    return run


def fit_epoch(unit: DataFrame, protos: Prototypes, opt: Optimiser, variant: str, alpha: float, batch_size: int,
              epoch: int = 0, tasks: int | None = None) -> tuple[Prototypes, Optimiser, list[float]]:
    """The mini-batch steps of one epoch over ``unit`` ``(row_id, y, xh)``: the prototypes and the
    optimiser after it, and the loss of every step.  ``protos`` and ``opt`` stay as they are.

    ``tasks`` (default: the cluster's cores) tasks must fit the cluster at once."""
    spark = unit.sparkSession
    n = unit.count()
    if not n:
        return protos.copy(), copy.deepcopy(opt), []
    parts = tasks or spark.sparkContext.defaultParallelism
    batched = shuffled_batches(unit, batch_size, seed=epoch)
    dealt = batched.select("batch", "y", "xh", "row_id").repartition(parts, "row_id").sortWithinPartitions("batch").select("batch", "y", "xh")
    state = spark.sparkContext.broadcast(cloudpickle.dumps((protos, opt)))
    made = dealt.mapInArrow(_steps(state, -(-n // int(batch_size)), variant, alpha), OUT, barrier=True)
    # the shuffle of this one row, the model, makes the barrier stage one that Spark may run again: a
    # stage that ends in the result itself is not
    got = made.repartition(1).select("state").collect()
    return pickle.loads(bytes(got[0][0]))


def _run_steps(shipped, first: int, end: int, variant: str, alpha: float):
    def run(batches):
        protos, opt = pickle.loads(shipped.value)
        rows, losses = _Rows(iter(batches)), []
        for number in range(first, end):
            x, y = rows.take(number)
            loss, d_p, d_m = loss_and_grad(partial_sums(x, y, protos, variant, alpha), protos, variant, alpha)
            protos = opt.apply(protos, d_p, d_m)
            losses.append(float(loss))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([cloudpickle.dumps((protos, opt, losses))], pa.binary())], names=["task", "state"])
    return run


def fit_runs(unit: DataFrame, protos: Prototypes, opt: Optimiser, variant: str, alpha: float, batch_size: int, path: str,
             epoch: int = 0) -> tuple[Prototypes, Optimiser, list[float]]:
    """As ``fit_epoch``, by a job per run of batches; ``path`` is a fresh shared folder."""
    spark, losses = unit.sparkSession, []
    protos, opt, n = protos.copy(), copy.deepcopy(opt), unit.count()
    n_batches, per = -(-n // int(batch_size)), max(1, RUN_ROWS // int(batch_size))
    dealt = shuffled_batches(unit, batch_size, seed=epoch).select("batch", "row_id", "y", "xh")
    # positions follow the tasks, so a task writes few runs
    dealt.withColumn("run", F.floor(F.col("batch") / per).cast("long")).write.mode("overwrite").partitionBy("run").parquet(path)
    schema = dealt.schema.add("run", "long")
    runs = spark.read.schema(schema).parquet(path)
    for first in range(0, n_batches, per):
        rows = runs.filter(F.col("run") == first // per)
        if batch_size > RUN_ROWS:
            loss, d_p, d_m = loss_and_grad(aggregate_sums(rows, protos, variant, alpha), protos, variant, alpha)
            protos = opt.apply(protos, d_p, d_m)
            losses.append(float(loss))
            continue
        state = spark.sparkContext.broadcast(cloudpickle.dumps((protos, opt)))
        one = rows.coalesce(1).sortWithinPartitions("batch", "row_id").select("batch", "y", "xh")
        got = one.mapInArrow(_run_steps(state, first, min(first + per, n_batches), variant, alpha), OUT).select("state").collect()
        protos, opt, done = pickle.loads(bytes(got[0][0]))
        losses += done
        state.unpersist()
    return protos, opt, losses
