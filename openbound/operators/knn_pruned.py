"""Exact similarity join with top-k by cells and angle bounds (J6, T5 beyond block pairs).

The index rows are dealt to the pivot (a bounded sample of index rows) nearest by angle.  A cell
keeps its size, the largest angle ``a_r`` between its pivot and a member, and the least and the
greatest norm of its members.  For a query x at angle ``t`` from the pivot, the triangle inequality
of angles gives for every member v

    x . v  <=  |x| |v| cos(max(0, t - a_r)),

with the greatest norm where the cosine is positive and the least where it is not.  Every query
first visits its home, the cell of the greatest bound, and then all cells whose bound its k-th best
product does not exceed; that product rises while the visits go on, and cells are skipped as it does.

Nothing is copied per visit.  Index rows are packed by cell and queries by home (``pairs``): cells
next to each other share a pack, cells over ``SHARD_ROWS`` rows and homes of over ``QUERY_ROWS``
queries are cut by hash, so no hot cell, index vector or query is one group.  A pack of queries is
paired with the packs that hold a cell which one of its queries may need, reads them from the
checkpoint and keeps k rows per query.  Disk and memory grow with the rows, not with the visits.

Results are those of brute force, ties included (products that are equal: training rows before
proxies, then the smaller id): products are summed in one fixed order for every pair, whatever
block it is met in, and bounds are widened by what rounding may take from them.

A zero query has product 0 with every row: its k rows are the first k in tie order, looked up
once.  Queries and index rows without a usable vector (NULL, or a NULL, NaN or infinite component)
match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_usable, safe_norm, sq_norm
from ..session import cut_lineage, written_table
from . import pairs as PA
from .neighbors import index_frame
from .prototypes import Prototypes

MAX_PIVOTS = 512       # cells, at most: their pivots and bounds are sent to every task
SPARE = 8              # sampled rows per pivot, of which those far from each other become pivots
SHARD_ROWS = 8192      # index rows of a shard, on average
QUERY_ROWS = 2048      # queries of a pack, on average
TILE_ROWS = 256        # queries multiplied with a cell at a time
ANGLE_SLACK = 1e-7     # arccos near 1 is this inexact
SLACK = 1e-12          # relative error of a product and of a bound


@dataclass
class Cells:
    """Pivot directions and bounds; a few numbers per cell."""
    pivots: np.ndarray
    reach: np.ndarray          # largest angle to a member
    low: np.ndarray            # least norm of a member
    high: np.ndarray           # greatest norm of a member
    rows: np.ndarray
    shards: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of every query (row) with every cell."""
        norm = np.sqrt((x * x).sum(axis=1))
        angle = np.arccos(np.clip((x @ self.pivots.T) / np.maximum(norm, 1e-300)[:, None], -1.0, 1.0))
        c = np.cos(np.maximum(0.0, angle - self.reach[None, :] - ANGLE_SLACK))
        b = norm[:, None] * np.where(c > 0, self.high[None, :], self.low[None, :]) * c
        b = b + 1e-9 * norm[:, None] * self.high[None, :]
        return np.where(self.rows[None, :] > 0, b, -np.inf)


@dataclass
class PruneReport:
    """What was compared: pairs of rows, and visits of (query, cell)."""
    queries: int = 0
    index_rows: int = 0
    cells: int = 0
    pairs: int = 0
    visits: int = 0
    rounds: list = field(default_factory=list)          # visits of homes, and of other cells

    @property
    def skipped(self) -> float:
        """Share of the (query, index row) pairs that were never compared."""
        return 1.0 - self.pairs / max(1, self.queries * self.index_rows)


def pair_products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of one query with the rows of ``v``, each summed in the same order."""
    return (v * x).sum(axis=1)


def _nearest_pivot(bc):
    @F.pandas_udf("struct<cell:int,angle:double,norm:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        p = bc.value
        out = []
        for lo in range(0, len(v), 4096):
            m = np.stack(v.iloc[lo:lo + 4096].to_numpy())
            norm = np.sqrt((m * m).sum(axis=1))
            cos = (m @ p.T) / np.maximum(norm, 1e-300)[:, None]
            at = cos.argmax(axis=1)
            # a zero vector has no direction: the pivot's own
            angle = np.where(norm > 0, np.arccos(np.clip(cos[np.arange(len(at)), at], -1.0, 1.0)), 0.0)
            out.append(pd.DataFrame({"cell": at.astype("int32"), "angle": angle, "norm": norm}))
        return pd.concat(out) if out else pd.DataFrame({"cell": [], "angle": [], "norm": []})
    return assign


def _spread(p: np.ndarray, want: int) -> np.ndarray:
    """Up to ``want`` rows of the sample, each the one farthest by angle from those before."""
    chosen = [0]
    cos = p @ p[0]
    while len(chosen) < min(want, len(p)):
        far = int(cos.argmin())
        if cos[far] > 1 - 1e-9:
            break                            # only copies are left
        chosen.append(far)
        cos = np.maximum(cos, p @ p[far])
    return p[chosen]


def build_cells(index: DataFrame, pivots: int | None = None, seed: int = 0) -> tuple[DataFrame, Cells]:
    """Index rows ``(kind, iid, label, v, cell)``, checkpointed, and their cells."""
    spark = index.sparkSession
    n = index.count()
    want = min(MAX_PIVOTS, max(1, pivots or int(np.ceil(np.sqrt(n)))))
    sample = (index.filter(sq_norm("v") > 0).orderBy(F.xxhash64("kind", "iid", F.lit(seed)), "kind", "iid").limit(SPARE * want).select("v").collect())
    p = np.array([r["v"] for r in sample], float)
    if not len(p):
        dim = index.select(F.max(F.size("v"))).first()[0] or 1
        p = np.eye(1, dim)
    p = _spread(p / np.sqrt((p * p).sum(axis=1))[:, None], want)
    bc = spark.sparkContext.broadcast(p)
    placed = cut_lineage(index.withColumn("_c", _nearest_pivot(bc)("v")).select("kind", "iid", "label", "v", "_c.cell", "_c.angle", "_c.norm"))
    size = len(p)
    reach, low, high, rows = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("a"), F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.count("*").alias("n")).collect():
        reach[r["cell"]], low[r["cell"]], high[r["cell"]], rows[r["cell"]] = r["a"], r["lo"], r["hi"], r["n"]
    cells = Cells(p, reach, low, high, rows, np.maximum(1, -(-rows // SHARD_ROWS)))
    return placed.drop("angle", "norm"), cells


def _visits(bc, seen: int, take: int):
    """Cells at the next ``take`` places of a query's order that may hold one of its best, as packed
    numbers: a batch of queries may visit all cells."""
    @F.pandas_udf("array<int>")
    def visits(x: pd.Series, kth: pd.Series) -> pd.Series:
        cells, out = bc.value, []
        for lo in range(0, len(x), 1024):
            b = cells.bounds(np.stack(x.iloc[lo:lo + 1024].to_numpy()))
            order = np.argsort(-b, axis=1, kind="stable")[:, seen:seen + take]
            wanted = (np.take_along_axis(b, order, axis=1) >= kth.iloc[lo:lo + 1024].to_numpy()[:, None]) & (cells.rows[order] > 0)
            out += [o[w].astype("int32") for o, w in zip(order, wanted)]
        return pd.Series(out, dtype=object)
    return visits


COUNTED = "qid long, score double, kind int, iid long, label int, visits long, pairs long"


_ASKING = {"qid": "int64", "home": "int32", "kth": "float64"}
_PLACED = {"cell": "int32", "kind": "int32", "iid": "int64", "label": "int32"}


def _tour(pivots: np.ndarray) -> list[int]:
    """The cells, each after the one nearest by angle of those left."""
    out, left = [0], np.arange(len(pivots)) > 0
    while left.any():
        cos = np.where(left, pivots @ pivots[out[-1]], -np.inf)
        out.append(int(cos.argmax()))
        left[out[-1]] = False
    return out


def _into_packs(rows: DataFrame, keys: list, counts: np.ndarray, parts: np.ndarray, tour: list, fill: int, cell: str) -> tuple[DataFrame, int]:
    """Rows with their pack and part of the cell, and the number of packs: a cell of several parts
    has a pack for each, others share packs of ``fill`` rows."""
    first, packs, room = np.zeros(len(counts), int), 0, 0
    for c in tour:
        if parts[c] > 1 or counts[c] > room:
            first[c], room = packs, 0 if parts[c] > 1 else fill - int(counts[c])
            packs += int(parts[c])
        else:
            first[c], room = packs - 1, room - int(counts[c])
    at = F.col(cell) + 1
    part = F.pmod(F.xxhash64(*keys), F.element_at(F.array(*[F.lit(int(n)) for n in parts]), at)).cast("int")
    return rows.withColumn("part", part).withColumn("pack", (F.element_at(F.array(*[F.lit(int(n)) for n in first]), at) + F.col("part")).cast("int")), packs


def _wanting(cells: Cells, x: np.ndarray, home: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Whether a query (row) may find one of its best in a cell other than its home."""
    wanted = cells.bounds(x) >= kth[:, None]
    wanted &= cells.rows[None, :] > 0
    wanted[np.arange(len(x)), home] = False
    return wanted


def _search(bc, k: int, dim: int, homes: bool):
    """Packs of queries through packs of cells: the homes of the queries, or the other cells that
    the bounds leave.  A last row without a query counts visits and pairs."""
    def fold():
        cells = bc.value

        def start(row):
            q = {c: v.copy() for c, v in PA.unpacked(row, _ASKING, dim).items()}
            q["norm"] = np.sqrt((q["x"] * q["x"]).sum(axis=1))
            q["bounds"] = None if homes else np.where(_wanting(cells, q["x"], q["home"], q["kth"]), cells.bounds(q["x"]), -np.inf)
            return q | {"best": PA.Best(len(q["x"]), k, q["kth"]), "visits": 0, "pairs": 0}

        def step(q, row):
            ix = PA.unpacked(row, _PLACED, dim, "i_")
            cuts = [0, *(np.flatnonzero(np.diff(ix["cell"])) + 1).tolist(), len(ix["cell"])]
            for lo, hi in zip(cuts, cuts[1:]):
                cell, v = ix["cell"][lo], ix["x"][lo:hi]
                rows = [ix[c][lo:hi] for c in ("kind", "iid", "label")]
                if homes:
                    wanting = np.flatnonzero(q["home"] == cell)
                else:
                    bound = q["bounds"][:, cell]
                    wanting = np.flatnonzero((bound >= q["best"].floor) & (bound > -np.inf))
                far = float(np.sqrt((v * v).sum(axis=1)).max())
                for a in range(0, len(wanting), TILE_ROWS):
                    at = wanting[a:a + TILE_ROWS]
                    x = q["x"][at]
                    q["best"].offer(at, x @ v.T, *rows, SLACK * dim * far * q["norm"][at], lambda r, c: pair_products(x[r], v[c]))
                q["pairs"] += len(wanting) * (hi - lo)
                q["visits"] += len(wanting) if int(np.frombuffer(row["i_part"].as_buffer(), "int32")[0]) == 0 else 0

        def end(q):
            names = [c.split()[0] for c in COUNTED.split(", ")]
            for columns in q["best"].batches(q["qid"]):
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(columns[0]), pa.int64())] * 2], names=names)
            types = (pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], pa.array([q["visits"]], pa.int64()), pa.array([q["pairs"]], pa.int64())], names=names)
        return start, step, end
    return fold


def _visited(asking: DataFrame, index: DataFrame, cells: Cells, bc, k: int, homes: bool, report: PruneReport) -> DataFrame:
    """k rows at most per query and task, and what was compared."""
    dim, tour = cells.pivots.shape[1], _tour(cells.pivots)
    counts = np.zeros(len(cells.rows), np.int64)
    for r in asking.groupBy("home").agg(F.count("*").alias("n")).collect():
        counts[r["home"]] = r["n"]                    # a row per cell
    q, packs = _into_packs(asking, ["qid"], counts, np.maximum(1, -(-counts // QUERY_ROWS)), tour, QUERY_ROWS, "home")

    def needed(pdf, x):
        home = pdf["home"].to_numpy()
        wanted = np.unique(home) if homes else np.flatnonzero(_wanting(bc.value, x, home, pdf["kth"].to_numpy()).any(axis=0))
        return {"cells": [wanted.astype("int32").tolist()]}
    q = PA.packed(q, _ASKING, "x", dim, packs, more=needed, schema=", cells array<int>")
    found = written_table(PA.meet(q, index, _search(bc, k, dim, homes), COUNTED, F.arrays_overlap("cells", "i_cells")))
    seen = found.filter("qid IS NULL").agg(F.sum("visits").alias("visits"), F.sum("pairs").alias("pairs")).first()
    report.rounds.append(seen["visits"] or 0)
    report.visits += seen["visits"] or 0
    report.pairs += seen["pairs"] or 0
    return found.filter("qid IS NOT NULL").drop("visits", "pairs")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "kind", "iid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similarity_topk(queries: DataFrame, index: DataFrame, k: int = 5, pivots: int | None = None, seed: int = 0) -> tuple[DataFrame, PruneReport]:
    """The ``k`` index rows ``(kind, iid, label, v)`` with the largest inner products of every
    usable query ``(qid, x)``: ``(qid, rank, score, kind, iid, label)`` and what was compared.
    ``qid`` is unique; ``(kind, iid)`` is unique."""
    spark = queries.sparkSession
    index = cut_lineage(index.filter(is_usable(safe_norm("v"))))
    q = cut_lineage(queries.select(F.col("qid").cast("long").alias("qid"), F.col("x").cast("array<double>").alias("x")).filter(is_usable(safe_norm("x"))))
    zero = sq_norm("x") == 0
    report = PruneReport(queries=q.filter(~zero).count(), index_rows=index.count())
    # equal products for every row: the first k in tie order, once for all zero queries
    first = [(i + 1, *r) for i, r in enumerate(index.orderBy("kind", "iid").limit(k).select("kind", "iid", "label").collect())]
    ties = spark.createDataFrame(first, "rank int, kind int, iid long, label int")
    ranked = q.filter(zero).select("qid", F.lit(0.0).alias("score")).join(F.broadcast(ties)).select("qid", "rank", "score", "kind", "iid", "label")
    if not report.index_rows or not report.queries:
        return ranked, report
    placed, cells = build_cells(index, pivots, seed)
    bc = spark.sparkContext.broadcast(cells)
    report.cells = int((cells.rows > 0).sum())
    floor = F.lit(float("-inf"))
    asking = cut_lineage(q.filter(~zero).select("qid", "x", floor.alias("kth"), F.element_at(_visits(bc, 0, 1)("x", floor), 1).alias("home")))
    dealt, packs = _into_packs(placed, ["kind", "iid"], cells.rows, cells.shards, _tour(cells.pivots), PA.PACK_ROWS, "cell")
    held = PA.packed(dealt, _PLACED | {"part": "int32"}, "v", cells.pivots.shape[1], packs, PA.PARTITION_PACKS, order=["cell", "kind", "iid"],
                     more=lambda pdf, _: {"cells": [sorted(set(pdf["cell"].tolist()))]}, schema=", cells array<int>")
    near = _visited(asking, held, cells, bc, k, True, report)
    kth = near.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("qid", "least")
    asking = cut_lineage(asking.drop("kth").join(kth, "qid", "left").select("qid", "x", "home", F.coalesce("least", floor).alias("kth")))
    best = near.unionByName(_visited(asking, held, cells, bc, k, False, report))
    return _ranked(best, k).select("qid", "rank", "score", "kind", "iid", "label").unionByName(ranked), report


def _majority(top: DataFrame) -> DataFrame:
    """``(qid, pred)``: the most frequent label of the k rows, the smallest on ties."""
    votes = top.groupBy("qid", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("qid").agg(F.max(F.struct("n", (-F.col("label")).alias("nl"))).alias("b")).select("qid", (-F.col("b.nl")).cast("int").alias("pred"))


def knn_vote_pruned(queries: DataFrame, train: DataFrame, protos: Prototypes, k: int = 5, x_col: str = "x", y_col: str = "y",
                    id_col: str = "row_id", out_col: str = "pred", pivots: int | None = None, seed: int = 0) -> tuple[DataFrame, PruneReport]:
    """T5 prediction per query row ``(id_col, out_col)``, as ``neighbors.knn_vote``, and the report."""
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(x_col).alias("x"))
    top, report = similarity_topk(q, index_frame(train, protos, x_col, y_col, id_col), k, pivots, seed)
    ok: Column = is_usable(safe_norm("x"))
    out = F.when(F.col("_ok"), F.coalesce("pred", F.lit(0))).otherwise(F.lit(protos.n_classes - 1))
    pred = q.select("qid", ok.alias("_ok")).join(_majority(top), "qid", "left")
    return pred.select(F.col("qid").alias(id_col), out.cast("int").alias(out_col)), report
