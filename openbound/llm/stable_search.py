"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to ``PROJECTED`` dimensions by Gaussian (2-stable) directions: the squared
projected distance of two vectors is their squared distance times a chi-square variable of
``PROJECTED`` degrees.  Neighbours in the projected space are taken in rising order from a kd-tree
and verified on the original vectors.  Let ``d`` be the k-th best verified distance and ``r`` the
projected distance reached.  A row nearer than ``d`` that has not been seen would have to be
projected beyond ``r``, and the chance that it is not is the chi-square distribution at
``r*r / (d*d)``: the search stops once that is ``STOP`` or more.

The tree has two storeys.  Its upper one is cut at medians of a bounded sample of projections (at
most ``SAMPLE`` rows fit the cuts; every row is indexed) into at most ``MAX_CELLS`` cells; a cell
is dealt by row number into shards of about ``SHARD_ROWS`` rows, so a cell that a third of all
rows fall into is never one group.  The lower storey is a kd-tree inside each shard.  A query
first searches one shard of its own cell, which gives an upper bound on ``d``.  It then visits
just those shards whose cell box passes the stopping test with that bound.  The rows of a shard
and blocks of at most ``QUERY_ROWS`` queries meet in a cogroup; each answers with k rows at most
and a window with a row limit merges them.

Defined results: rows whose vector is null, empty or zero or holds a null, NaN or infinite entry
take no part.  Vectors of different lengths are an error that says so.  A row is its own query's
candidate never, another row with the same id or the same vector is.  Repeated query ids are
searched each.  Null ids are candidates (after all others on ties), not queries.  With ``k``
candidates or fewer all are found.  Equal distances are ordered by the smaller id.  Other columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, prepare, written

PROJECTED = 8          # even, see chi_square
STOP = 0.98            # chance with which a nearer row would have been seen
SAMPLE = 20_000        # rows that fit the cuts of the upper tree
MAX_CELLS = 1024       # leaves of the upper tree
SHARD_ROWS = 8192      # rows of a shard, on average
QUERY_ROWS = 1024      # queries that meet a shard at a time
LEAF_ROWS = 256        # rows of a leaf of the lower tree
SEED = 17


def chi_square(x: float, degrees: int = PROJECTED) -> float:
    """Distribution function for an even number of degrees (a finite sum)."""
    if x == math.inf:
        return 1.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def chi_square_bound(p: float, degrees: int = PROJECTED) -> float:
    """The x with ``chi_square(x) = p``, by halving."""
    lo, hi = 0.0, 1.0
    while chi_square(hi, degrees) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, degrees) < p else (lo, mid)
    return hi


def directions(dim: int, projected: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projected))


def usable(vec: str) -> Column:
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


# -- the upper tree -----------------------------------------------------------------------------

def upper_tree(sample: np.ndarray, leaves: int) -> list[tuple]:
    """kd-tree as ``(axis, cut, left, right)`` rows, leaves as ``(-1, cell, low, high)`` with the
    cell's box; equal values of a cut stay together on its left."""
    dims = sample.shape[1]
    nodes: list[tuple] = []
    cells = 0

    def build(rows, low, high, want):
        nonlocal cells
        at = len(nodes)
        nodes.append(())
        if want > 1 and len(rows) > 1:
            for axis in np.argsort(-(rows.max(axis=0) - rows.min(axis=0)), kind="stable"):
                cut = float(np.partition(rows[:, axis], (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
                left = rows[:, axis] <= cut
                if left.all():                  # many equal values: the next smaller cut, if any
                    less = rows[:, axis][rows[:, axis] < cut]
                    if not len(less):
                        continue
                    cut = float(less.max())
                    left = rows[:, axis] <= cut
                lh, rl = high.copy(), low.copy()
                lh[axis] = rl[axis] = cut
                a = build(rows[left], low, lh, want // 2)
                b = build(rows[~left], rl, high, want - want // 2)
                nodes[at] = (int(axis), cut, a, b)
                return at
        nodes[at] = (-1, cells, low, high)
        cells += 1
        return at
    build(sample, np.full(dims, -np.inf), np.full(dims, np.inf), leaves)
    return nodes


def cells_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        axis, cut, a, b = nodes[at]
        if axis < 0:
            out[rows] = cut
        elif len(rows):
            left = points[rows, axis] <= cut
            todo += [(a, rows[left]), (b, rows[~left])]
    return out


def _boxes(nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    leaves = sorted((n for n in nodes if n[0] < 0), key=lambda n: n[1])
    return np.stack([n[2] for n in leaves]), np.stack([n[3] for n in leaves])


# -- the lower tree and its search --------------------------------------------------------------

class Shard:
    """kd-tree over the projections of a shard's rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, points: np.ndarray):
        self.vectors, self.ids, self.rows, self.points = vectors, ids, rows, points
        self.nodes: list[tuple] = []
        self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray) -> int:
        here = len(self.nodes)
        low, high = self.points[at].min(axis=0), self.points[at].max(axis=0)
        self.nodes.append(())
        axis = int((high - low).argmax())
        if len(at) <= LEAF_ROWS or high[axis] == low[axis]:
            self.nodes[here] = (low, high, at, None)
        else:
            order = at[np.argpartition(self.points[at, axis], len(at) // 2)]
            left, right = self._build(order[:len(at) // 2]), self._build(order[len(at) // 2:])
            self.nodes[here] = (low, high, left, right)
        return here

    def _gap(self, node: int, p: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        d = np.maximum(low - p, 0) + np.maximum(p - high, 0)
        return float(d @ d)

    def search(self, vector: np.ndarray, point: np.ndarray, row: int, k: int, bound: float, stop: float) -> list[tuple]:
        """``(distance, id, row)`` of the best rows found; ``bound`` is an upper bound
        of the k-th best distance, ``stop`` the quotient of squares at which the search ends."""
        best: list[tuple] = []
        limit = bound
        queue = [(self._gap(0, point), 0)]
        far = np.empty(0)                       # projected squares of rows taken from leaves, not yet verified
        who = np.empty(0, np.int64)
        while queue or len(far):
            reached = min(queue[0][0] if queue else math.inf, float(far.min()) if len(far) else math.inf)
            if reached > stop * limit * limit:
                break
            if queue and queue[0][0] <= reached:
                _, node = heapq.heappop(queue)
                a, b = self.nodes[node][2:]
                if b is None:
                    d = self.points[a] - point
                    far, who = np.concatenate([far, (d * d).sum(axis=1)]), np.concatenate([who, a])
                else:
                    for child in (a, b):
                        heapq.heappush(queue, (self._gap(child, point), child))
                continue
            # every row nearer than the next box is next in order
            upto = queue[0][0] if queue else math.inf
            now = far <= min(upto, stop * limit * limit)
            at = who[now]
            far, who = far[~now], who[~now]
            at = at[self.rows[at] != row]
            dist = np.sqrt(((self.vectors[at] - vector) ** 2).sum(axis=1))
            for j in np.flatnonzero(dist <= limit):
                i = at[j]
                best.append((float(dist[j]), int(self.ids[i]), int(self.rows[i])))
            if len(best) >= k:
                best = sorted(best)[:k]
                limit = min(limit, best[-1][0])
        return sorted(best)[:k]


def _answer(directions_bc, k: int, stop: float):
    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        cols: list[list] = [[], [], [], [], []]
        if len(q) and len(x):
            vectors = np.stack(x["x_vec"].to_numpy())
            shard = Shard(vectors, x["x_tie"].to_numpy(), x["x_row"].to_numpy(), vectors @ directions_bc.value)
            qv = np.stack(q["vec"].to_numpy())
            for i, (qid, row, bound, p) in enumerate(zip(q["query_id"], q["qrow"], q["bound"], qv @ directions_bc.value)):
                for d, tie, r in shard.search(qv[i], p, int(row), k, float(bound), stop):
                    for c, v in zip(cols, (int(qid), int(row), tie, r, d)):
                        c.append(v)
        return pd.DataFrame({"query_id": pd.Series(cols[0], dtype="int64"), "qrow": pd.Series(cols[1], dtype="int64"),
                             "tie": pd.Series(cols[2], dtype="int64"), "row": pd.Series(cols[3], dtype="int64"),
                             "score": pd.Series(cols[4], dtype="float64")})
    return run


FOUND = "query_id long, qrow long, tie long, row long, score double"


def _searched(asked: DataFrame, index: DataFrame, directions_bc, k: int, stop: float) -> DataFrame:
    """``asked``: query rows with the shard they visit.  A shard that many queries visit meets
    them in blocks, each with a copy of the shard."""
    per = asked.groupBy("cell", "shard").agg(F.count("*").alias("n"))
    blocks = per.select("cell", "shard", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("blocks"))
    q = asked.join(blocks, ["cell", "shard"]).withColumn("block", F.pmod(F.xxhash64("qrow"), F.col("blocks")).cast("int"))
    x = (index.join(blocks, ["cell", "shard"])
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    keys = ["cell", "shard", "block"]
    # names of their own: both sides stem from one table
    x = x.select(*[F.col(c).alias(f"x_{c}") for c in [*keys, "tie", "row", "vec"]])
    return (q.select(*keys, "query_id", "qrow", "bound", "vec").groupBy(*keys)
            .cogroup(x.groupBy(*[f"x_{c}" for c in keys])).applyInPandas(_answer(directions_bc, k, stop), FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qrow").orderBy("score", "tie", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            stop: float = STOP, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``queries`` true (default: id divisible
    by 100) its ``k`` nearest rows found, by Euclidean distance in double precision."""
    need(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    prepare(spark)
    chosen = F.col("vec_id") % 100 == 0 if queries is None else queries
    rows = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"),
                           F.coalesce(chosen, F.lit(False)).alias("asks"))
            .filter(usable("vec")).withColumn("row", F.monotonically_increasing_id()))
    # order of equal distances: a null id stands after all others
    rows = rows.withColumn("tie", F.coalesce("vec_id", F.lit((1 << 63) - 1)))
    rows = written(rows, "search-rows")
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size["lo"] != size["hi"]:
        raise ValueError(f"vectors have from {size['lo']} to {size['hi']} entries")
    g = directions(size["hi"], seed=seed)
    directions_bc = spark.sparkContext.broadcast(g)
    # a bounded sample fits the cuts; hashed, so that the order of the table does not matter
    share = min(1.0, SAMPLE / size["n"])
    sample = (rows.filter(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) <= int(share * (1 << 30)))
              .limit(2 * SAMPLE).select("vec").toPandas()["vec"])
    points = np.stack(sample.to_numpy()) @ g if len(sample) else np.zeros((1, PROJECTED))
    nodes = upper_tree(points, min(MAX_CELLS, max(1, -(-size["n"] // SHARD_ROWS))))
    tree_bc = spark.sparkContext.broadcast(nodes)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cells_of(tree_bc.value, np.stack(v.to_numpy()) @ directions_bc.value))
    celled = written(rows.withColumn("cell", cell("vec")), "search-cells")
    shards = {r[0]: max(1, -(-r[1] // SHARD_ROWS)) for r in celled.groupBy("cell").count().collect()}     # MAX_CELLS rows
    shard_table = spark.createDataFrame(sorted(shards.items()), "cell int, shards int")
    index = (celled.join(F.broadcast(shard_table), "cell")
             .withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")).drop("shards"))
    asking = index.filter("asks").select("cell", "shard", F.col("vec_id").alias("query_id"), F.col("row").alias("qrow"), "vec")

    # first: one shard of the own cell bounds the k-th distance
    limit = chi_square_bound(stop)
    home = written(_searched(asking.withColumn("bound", F.lit(float("inf"))), index, directions_bc, k, limit), "search-home")
    bounds = home.groupBy("qrow").agg(F.count("*").alias("n"), F.max("score").alias("far")).select(
        "qrow", F.when(F.col("n") >= k, F.col("far")).alias("bound"))
    asked = (asking.drop("cell", "shard").join(bounds, "qrow", "left")
             .withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    low, high = _boxes(nodes)
    there = np.array([shards.get(c, 0) for c in range(len(low))])

    @F.pandas_udf("array<struct<cell:int,shard:int>>")
    def visits(v: pd.Series, bound: pd.Series) -> pd.Series:
        out = []
        for p, b in zip(np.stack(v.to_numpy()) @ directions_bc.value, bound):
            gap = np.maximum(low - p, 0) + np.maximum(p - high, 0)
            near = np.flatnonzero(((gap * gap).sum(axis=1) <= limit * b * b) & (there > 0))
            out.append([{"cell": int(c), "shard": s} for c in near for s in range(there[c])])
        return pd.Series(out)
    asked = written(asked.withColumn("to", F.explode(visits("vec", "bound"))).select(
        "to.cell", "to.shard", "query_id", "qrow", "vec", "bound"), "search-visits")
    # the rows that gave the bound stay found
    found = _best(_searched(asked, index, directions_bc, k, limit).unionByName(home).dropDuplicates(["qrow", "row"]), k)
    ids = rows.filter("vec_id IS NULL").select(F.col("row").alias("null_row"))
    return (found.join(ids, found["row"] == ids["null_row"], "left")
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("null_row").isNull(), F.col("tie")).alias("vec_id"), "score"))


def recall(found: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           one_in: int = 1, block: int = 2048) -> float:
    """Share of the true ``k`` nearest of the queries in ``found`` (one in ``one_in`` of them by
    hash) that was found: rows at the k-th true distance or nearer.  Tables with distinct ids.

    The audited queries, in one block, are sent to every task, which compares them with its rows
    and keeps k; choose ``one_in`` so that they fit an executor."""
    spark = found.sparkSession
    asked = found.select("query_id").distinct().filter(F.pmod(F.xxhash64("query_id"), F.lit(one_in)) == 0)
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(usable("vec")))
    q = rows.join(asked, rows["vec_id"] == asked["query_id"]).select("vec_id", "vec").toPandas()
    qv, qid = np.stack(q["vec"].to_numpy()), q["vec_id"].to_numpy()

    def run(batches):
        best = np.full((len(qid), 0), np.inf)
        for pdf in batches:
            for lo in range(0, len(pdf), block):
                x = pdf.iloc[lo:lo + block]
                xv = np.stack(x["vec"].to_numpy())
                d = np.sqrt(np.stack([((xv - v) ** 2).sum(axis=1) for v in qv]))
                d[qid[:, None] == x["vec_id"].to_numpy()[None, :]] = np.inf
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
        for i, row in zip(qid, best):
            yield pd.DataFrame({"query_id": int(i), "d": row[np.isfinite(row)]})
    w = Window.partitionBy("query_id").orderBy("d")
    true = (rows.mapInPandas(run, "query_id long, d double").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
            .groupBy("query_id").agg(F.max("d").alias("far"), F.count("*").alias("n")))
    hits = (found.join(true, "query_id").groupBy("query_id")
            .agg(F.sum((F.col("score") <= F.col("far") * (1 + 1e-12)).cast("long")).alias("hit"), F.first("n").alias("n")))
    got = hits.agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).first()
    return (got["hit"] or 0) / got["n"] if got["n"] else 1.0
