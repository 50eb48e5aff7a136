"""Every pair of two tables without a copy of a row for every pair.

Rows are packed: a row per pack holds the ids and vectors of up to ``PACK_ROWS`` rows as packed
numbers.  Packs of both sides are checkpointed once, and the cross product of the packs reads them
from there: nothing is shuffled or written per pair, so the disk grows with the rows and not with
their product.  A task goes through all packs of the other side for its own packs and carries what
it keeps of them (the best, or sums) from pack to pack; it answers once for every query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PACK_ROWS = 4096           # rows of a pack, about
PARTITION_PACKS = 4        # packs of the other side that a task holds at a time
TIE_ROWS = 16_384          # pairs whose products are summed anew at a time


def matrix(rows, dim: int) -> np.ndarray:
    """Row vectors as a matrix; NULL vectors and components become NaN."""
    out = np.full((len(rows), dim), np.nan)
    for i, v in enumerate(rows):
        if v is not None:
            out[i] = np.asarray(v, dtype=float)
    return out


def packed(rows: DataFrame, columns: dict[str, str], x_col: str, dim: int, n_packs: int, per_partition: int = 1, order=None, more=None,
           schema: str = "") -> DataFrame:
    """``(pack, columns..., x)``: a row per value of ``pack`` (0 to ``n_packs`` - 1), columns as
    packed numbers of the given types, vectors as doubles, rows by ``order``; ``more(rows, matrix)``
    gives further columns of a pack, named in ``schema``."""
    def pack(pdf):
        pdf = pdf if order is None else pdf.sort_values(order)
        out = {"pack": [int(pdf["pack"].iat[0])]} | {c: [pdf[c].to_numpy().astype(t).tobytes()] for c, t in columns.items()}
        x = matrix(pdf[x_col].to_numpy(), dim)
        out["x"] = [x.tobytes()]
        return pd.DataFrame(out | ({} if more is None else more(pdf, x)))
    spread = rows.select("pack", *columns, x_col).repartitionByRange(max(1, -(-n_packs // per_partition)), "pack")
    return cut_lineage(spread.groupBy("pack").applyInPandas(pack, ", ".join(["pack int", *[f"{c} binary" for c in columns], "x binary"]) + schema))


def unpacked(row: dict, columns: dict[str, str], dim: int, prefix: str = "") -> dict:
    """The columns and the matrix of a pack (views of the batch that holds it)."""
    out = {c: np.frombuffer(row[f"{prefix}{c}"].as_buffer(), t) for c, t in columns.items()}
    return out | {"x": np.frombuffer(row[f"{prefix}x"].as_buffer()).reshape(-1, dim)}


def meet(q: DataFrame, other: DataFrame, fold, schema: str, wanted: Column | None = None) -> DataFrame:
    """Pairs of packs, those of ``other`` with names from ``i_``, folded: ``fold()`` gives
    ``(start(row), step(state, row), end(state) -> batches)``; a state is one pack of ``q``."""
    other = other.select(*[F.col(c).alias(f"i_{c}") for c in other.columns]).hint("shuffle_replicate_nl")
    both = q.crossJoin(other) if wanted is None else q.join(other, wanted)

    def run(batches):
        start, step, end = fold()
        held = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                pack = row["pack"].as_py()
                if pack not in held:
                    held[pack] = start(row)
                step(held[pack], row)
        for pack in list(held):
            yield from end(held.pop(pack))
    # the pairs of one partition of q stand together
    return both.coalesce(max(1, q.rdd.getNumPartitions())).mapInArrow(run, schema)


class Best:
    """The ``k`` best of every query so far, in falling order; equal ones by kind and id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score, self.kind = np.full((n, k), -np.inf), np.full((n, k), -1, np.int32)
        self.iid, self.label = np.zeros((n, k), np.int64), np.zeros((n, k), np.int32)
        self.held = np.zeros(n, np.int64)
        self.floor = np.full(n, -np.inf) if floor is None else np.array(floor, float)     # what counts, at least

    def offer(self, at: np.ndarray, rough: np.ndarray, kind, iid, label, slack=0.0, exact=None) -> None:
        """Products of the queries ``at`` (rows) with index rows (columns); ``exact`` sums those
        that may count (up to ``slack``) anew: ``exact(rows, columns)``."""
        if np.isnan(rough).any():
            rough = np.where(np.isnan(rough), -np.inf, rough)
        least = self.floor[at] - slack
        hit = rough >= least[:, None]
        if np.count_nonzero(hit) > 4 * self.k * len(at) and rough.shape[1] > self.k:
            kth = np.partition(rough, -self.k, axis=1)[:, -self.k]
            hit = rough >= np.maximum(least, kth - slack)[:, None]
        r, c = np.nonzero(hit)
        if not len(r):
            return
        score = rough[r, c] if exact is None else np.concatenate([exact(r[lo:lo + TIE_ROWS], c[lo:lo + TIE_ROWS]) for lo in range(0, len(r), TIE_ROWS)])
        rows = np.unique(r)
        old_r, old_c = np.nonzero(np.arange(self.k)[None, :] < self.held[at[rows]][:, None])
        old = (at[rows][old_r], old_c)
        row = np.concatenate([rows[old_r], r])
        score, kind, iid, label = (np.concatenate([have[old], new]) for have, new in
                                   ((self.score, score), (self.kind, kind[c]), (self.iid, iid[c]), (self.label, label[c])))
        order = np.lexsort((iid, kind, -score, row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        keep = rank < self.k
        order, row, rank = order[keep], at[row[keep]], rank[keep]
        for have, new in ((self.score, score), (self.kind, kind), (self.iid, iid), (self.label, label)):
            have[row, rank] = new[order]
        self.held[at[rows]] = np.bincount(row, minlength=len(self.held))[at[rows]]
        full = at[rows][self.held[at[rows]] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])

    def batches(self, qid: np.ndarray):
        """``(qid, score, kind, iid, label)`` of all that is held."""
        r, c = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        for lo in range(0, len(r), TIE_ROWS):
            at = (r[lo:lo + TIE_ROWS], c[lo:lo + TIE_ROWS])
            yield [pa.array(qid[at[0]], pa.int64()), pa.array(self.score[at]), pa.array(self.kind[at], pa.int32()), pa.array(self.iid[at], pa.int64()), pa.array(self.label[at], pa.int32())]
