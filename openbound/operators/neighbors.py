"""Memory-based predictors: k-NN vote (T5) and class-average similarity.

Both score a query x against an *index* = unit-normalised training rows
(label = their class) plus the raw proxies (label = their class id), by raw
inner product ``x . v`` (J6 similarity join, U2 union).

T6 -- class-average similarity
    per class, the mean of the non-zero dots between x and the class's index
    vectors; argmax, lowest id on ties, a class without a non-zero dot never
    wins (none at all: class 0).  Sums and non-zero counts per (query, class)
    come exactly, block by block, from the same products as T5.

T5 -- k-NN vote
    the labels of the K largest dots (ties: training rows before proxies,
    lower id first), majority vote, ties -> smallest class.  Exact search
    needs every query-index dot product; it is computed pack by pack and
    never materialised as rows: queries and index rows are hashed into packs
    (``pairs``), every pair of packs meets in one task, numpy multiplies the
    two and keeps K candidates per query, carried from index pack to index
    pack.  A pack holds as many blocks of ``block_rows`` rows as fit into
    ``PACK_ROWS`` rows, one at least.  Packs are written once; no row is
    copied per pair.

    Products are made in tiles of ``QUERY_ROWS`` x ``TILE_ROWS``, whatever the
    size of the index or of a block: candidates (T5) and sums (T6) are carried
    from tile to tile.

    When the index fits under ``broadcast_limit`` bytes (checked from its row
    count and width before anything is collected), it is broadcast once and
    the queries stream through ``mapInPandas`` -- no replication, no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_usable, l2_normalize, safe_norm
from . import pairs as PA
from .pairs import matrix as _matrix
from .prototypes import Prototypes

BLOCK_ROWS = 20_000
QUERY_ROWS = 256          # queries multiplied with index rows at a time
TILE_ROWS = 8_192         # index rows multiplied at a time
INDEX_BROADCAST_LIMIT = 256 * 1024 * 1024


# ------------------------------------------------------------------ T5 -----

def index_frame(train: DataFrame, protos: Prototypes, x_col: str = "x", y_col: str = "y",
                id_col: str = "row_id") -> DataFrame:
    """Index rows ``(kind, iid, label, v)``: unit training rows (kind 0) then proxies (kind 1)."""
    rows = train.select(F.lit(0).alias("kind"), F.col(id_col).cast("long").alias("iid"),
                        F.col(y_col).cast("int").alias("label"), l2_normalize(x_col).alias("v"))
    spark = train.sparkSession
    prox = spark.createDataFrame(
        [(1, i, i, protos.proxy[i].tolist()) for i in range(protos.n_classes)],
        "kind int, iid long, label int, v array<double>")
    return rows.unionByName(prox)


def _topk(dots: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest dots of every row; index rows are in tie order, so of equal
    dots the earlier position comes first."""
    n = dots.shape[1]
    if k >= n:
        return np.argsort(-dots, axis=1, kind="stable")
    part = np.argpartition(-dots, k - 1, axis=1)[:, :k]
    cut = np.take_along_axis(dots, part, axis=1).min(axis=1)
    for r in np.flatnonzero((dots >= cut[:, None]).sum(axis=1) > k):       # ties across the cut
        above = np.flatnonzero(dots[r] > cut[r])
        part[r] = np.concatenate([above, np.flatnonzero(dots[r] == cut[r])[:k - len(above)]])
    part.sort(axis=1)
    order = np.argsort(-np.take_along_axis(dots, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def _tiles(x: np.ndarray, im: np.ndarray):
    """``(first index row, products)`` of the queries with a tile of index rows after another."""
    for lo in range(0, len(im), TILE_ROWS):
        yield lo, x @ im[lo:lo + TILE_ROWS].T


def _tiled_topk(x: np.ndarray, im: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and products of the ``k`` largest products of every row, as ``_topk`` of all."""
    at, score = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0))
    for lo, dots in _tiles(x, im):
        near = _topk(dots, k)
        # rows of earlier tiles stand first, so they come first among equal products
        at, score = np.hstack([at, near + lo]), np.hstack([score, np.take_along_axis(dots, near, axis=1)])
        best = _topk(score, k)
        at, score = np.take_along_axis(at, best, axis=1), np.take_along_axis(score, best, axis=1)
    return at, score


def _vote(labels: np.ndarray, n_classes: int) -> np.ndarray:
    """Most frequent label of every row; smallest class on ties."""
    rows = np.repeat(np.arange(len(labels)), labels.shape[1])
    counts = np.bincount(rows * n_classes + labels.ravel(), minlength=len(labels) * n_classes)
    return counts.reshape(len(labels), n_classes).argmax(axis=1).astype("int32")


def _class_sums(x: np.ndarray, im: np.ndarray, labels: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the dots and number of non-zero dots per (row, class)."""
    total, count = np.zeros((len(x), n_classes)), np.zeros((len(x), n_classes))
    for lo, dots in _tiles(x, im):
        mine = labels[lo:lo + dots.shape[1]]
        hot = np.zeros((len(mine), n_classes))
        hot[np.arange(len(mine)), mine] = 1.0
        total += dots @ hot
        count += (dots != 0) @ hot
    return total, count


def _average_argmax(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    avg = np.where(count > 0, total / np.maximum(count, 1), -np.inf)
    return avg.argmax(axis=1).astype("int32")


def _index_arrays(rows) -> tuple:
    """``(kind, iid, label, matrix)`` of index rows in tie order (kind, then id)."""
    rows = sorted(rows, key=lambda r: (r["kind"], r["iid"]))
    dim = len(rows[0]["v"]) if rows else 0
    return (np.array([r["kind"] for r in rows], np.int32), np.array([r["iid"] for r in rows], np.int64),
            np.array([r["label"] for r in rows], np.int64), _matrix([r["v"] for r in rows], dim))


def _broadcast_predict(bc, decide, last: int):
    """Whole index on every executor, map-only: ``decide(queries, index matrix, labels)``."""
    def fn(batches):
        _, _, labels, im = bc.value
        for pdf in batches:
            if len(pdf):
                for lo in range(0, len(pdf), QUERY_ROWS):
                    part = pdf.iloc[lo:lo + QUERY_ROWS]
                    x = _matrix(part["x"].to_numpy(), im.shape[1])
                    usable = np.isfinite(x).all(axis=1)
                    pred = decide(np.where(usable[:, None], x, 0.0), im, labels)
                    yield pd.DataFrame({"qid": part["qid"].to_numpy().astype("int64"),
                                        "pred": np.where(usable, pred, last).astype("int32")})
    return fn


_CAND = "qid long, score double, kind int, iid long, label int"
_SUMS = "qid long, label int, total double, n long"


def _pair(make, columns, dim: int):
    """One (query block, index block) group: ``make(qid, x, matrix, kind, iid, label)`` -> column
    arrays, for some of the queries at a time."""
    def fn(q: pd.DataFrame, ix: pd.DataFrame) -> pd.DataFrame:
        if q.empty or ix.empty:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in columns.items()})
        ix = ix.sort_values(["kind", "iid"])
        im, kind, iid, label = _matrix(ix["v"].to_numpy(), dim), ix["kind"].to_numpy(), ix["iid"].to_numpy(), ix["label"].to_numpy()
        qid, x = q["qid"].to_numpy(), _matrix(q["x"].to_numpy(), dim)
        got = [make(qid[lo:lo + QUERY_ROWS], x[lo:lo + QUERY_ROWS], im, kind, iid, label) for lo in range(0, len(x), QUERY_ROWS)]
        return pd.DataFrame({c: np.concatenate(part) for c, part in zip(columns, zip(*got))}).astype(columns)
    return fn


_Q = {"qid": "int64"}
_IX = {"kind": "int32", "iid": "int64", "label": "int32"}


def _dealt(rows: DataFrame, keys: list, n: int, block_rows: int) -> tuple[DataFrame, int]:
    """Rows with the pack they are hashed to, and the number of packs."""
    packs = max(1, math.ceil(n / (block_rows * max(1, PA.PACK_ROWS // block_rows))))
    return rows.withColumn("pack", F.pmod(F.xxhash64(*keys), F.lit(packs)).cast("int")), packs


def _met(q: DataFrame, index: DataFrame, n_index: int, block_rows: int, dim: int, start, make, end, schema: str) -> DataFrame:
    """All queries with all index rows: ``start(n queries)`` is carried through ``make(state, places
    of queries, x, matrix, kind, iid, label)`` for every pair of packs, ``end(state, qid)`` answers."""
    q, qp = _dealt(q, ["qid"], q.count(), block_rows)
    index, ip = _dealt(index, ["kind", "iid"], n_index, block_rows)

    def fold():
        def first(row):
            got = PA.unpacked(row, _Q, dim)
            return got["qid"].copy(), list(got["x"].copy()), start(len(got["x"]))

        def step(held, row):
            qid, x, state = held
            ix = PA.unpacked(row, _IX, dim, "i_")
            place = pd.DataFrame({"qid": np.arange(len(qid)), "x": x})

            def made(at, *arrays):
                make(state, at, *arrays)
                return (at[:0],)
            _pair(made, {"qid": "int64"}, dim)(place, pd.DataFrame({**{c: ix[c] for c in _IX}, "v": list(ix["x"])}))

        def last(held):
            for columns in end(held[2], held[0]):
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
        return first, step, last
    return PA.meet(PA.packed(q, _Q, "x", dim, qp), PA.packed(index, _IX, "v", dim, ip, PA.PARTITION_PACKS), fold, schema)


def _usable(q: DataFrame) -> DataFrame:
    return q.filter(is_usable(safe_norm("x")))


def _all_queries(q: DataFrame, pred: DataFrame, without, last: int, id_col: str, out_col: str) -> DataFrame:
    """A row per query: ``without`` for one that no index row answered, the out-of-domain id for
    one that cannot be scored."""
    ok = q.select("qid", is_usable(safe_norm("x")).alias("_ok"))
    out = F.when(F.col("_ok"), F.coalesce("pred", without)).otherwise(F.lit(last))
    return ok.join(pred, "qid", "left").select(F.col("qid").alias(id_col), out.cast("int").alias(out_col))


def _setup(queries, train, protos, x_col, y_col, id_col, broadcast_limit):
    """Queries, index, its size, and the broadcast index if it is below the limit."""
    index = index_frame(train, protos, x_col, y_col, id_col)
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(x_col).alias("x"))
    n = index.count()
    # boxed rows on the way through the driver take about four times the plain size
    if 4 * n * (protos.dim * 8 + 24) > broadcast_limit:
        return q, index, n, None
    return q, index, n, q.sparkSession.sparkContext.broadcast(_index_arrays(index.collect()))


def knn_vote(queries: DataFrame, train: DataFrame, protos: Prototypes, k: int = 5,
             x_col: str = "x", y_col: str = "y", id_col: str = "row_id", out_col: str = "pred",
             block_rows: int = BLOCK_ROWS, broadcast_limit: int = INDEX_BROADCAST_LIMIT) -> DataFrame:
    """T5 prediction per query row ``(id_col, out_col)``."""
    q, index, n, bc = _setup(queries, train, protos, x_col, y_col, id_col, broadcast_limit)
    n_classes = protos.n_classes
    if bc is not None:
        votes = q.mapInPandas(_broadcast_predict(bc, lambda x, im, labels: _vote(labels[_tiled_topk(x, im, k)[0]], n_classes), n_classes - 1), "qid long, pred int")
        return votes.select(F.col("qid").alias(id_col), F.col("pred").alias(out_col))

    def top(best, at, x, im, kind, iid, label):
        for lo, dots in _tiles(x, im):
            best.offer(at, dots, *(c[lo:lo + dots.shape[1]] for c in (kind, iid, label)))
    cand = _met(_usable(q), index, n, block_rows, protos.dim, lambda m: PA.Best(m, k), top, lambda best, qid: best.batches(qid), _CAND)
    # merge: K per query, more if its pairs were dealt to several tasks -> global top K -> majority, smallest class on ties
    best = cand.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("ns"), "kind", "iid", "label"))), 1, k).alias("top"))
    labels = F.transform("top", lambda s: s["label"])
    votes = F.transform(F.array_distinct(labels), lambda c: F.struct(
        F.size(F.filter(labels, lambda l: l == c)).alias("n"), (-c).alias("nc")))
    pred = (-F.array_max(votes)["nc"]).cast("int")
    return _all_queries(q, best.select("qid", pred.alias("pred")), F.lit(0), n_classes - 1, id_col, out_col)


def class_average_predict(queries: DataFrame, train: DataFrame, protos: Prototypes, x_col: str = "x", y_col: str = "y",
                          id_col: str = "row_id", out_col: str = "pred", block_rows: int = BLOCK_ROWS,
                          broadcast_limit: int = INDEX_BROADCAST_LIMIT) -> DataFrame:
    """T6 prediction per query row ``(id_col, out_col)``."""
    q, index, n, bc = _setup(queries, train, protos, x_col, y_col, id_col, broadcast_limit)
    n_classes = protos.n_classes
    if bc is not None:
        out = q.mapInPandas(_broadcast_predict(
            bc, lambda x, im, labels: _average_argmax(*_class_sums(x, im, labels, n_classes)), n_classes - 1), "qid long, pred int")
        return out.select(F.col("qid").alias(id_col), F.col("pred").alias(out_col))

    def sums(held, at, x, im, kind, iid, label):
        for have, more in zip(held, _class_sums(x, im, label, n_classes)):
            have[at] += more

    def answer(held, qid):
        for lo in range(0, len(qid), QUERY_ROWS):
            total, count = (h[lo:lo + QUERY_ROWS] for h in held)
            yield [pa.array(np.repeat(qid[lo:lo + QUERY_ROWS], n_classes)), pa.array(np.tile(np.arange(n_classes, dtype="int32"), len(total))),
                   pa.array(total.ravel()), pa.array(count.ravel().astype("int64"))]
    part = _met(_usable(q), index, n, block_rows, protos.dim, lambda m: (np.zeros((m, n_classes)), np.zeros((m, n_classes))), sums, answer, _SUMS)
    avg = part.groupBy("qid", "label").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).filter("n > 0")
    best = avg.groupBy("qid").agg(F.max(F.struct((F.col("t") / F.col("n")).alias("a"), (-F.col("label")).alias("nc"))).alias("b"))
    return _all_queries(q, best.select("qid", (-F.col("b.nc")).cast("int").alias("pred")), F.lit(0), n_classes - 1, id_col, out_col)
