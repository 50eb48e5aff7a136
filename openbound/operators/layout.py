"""Neighbour-preserving 2-D layout of embeddings (R4, the form of t-SNE that Spark can run).

1. Exact nearest neighbours: with x' = (x, 1) and v' = (v, -|v|^2 / 2) the inner product orders rows
   as the Euclidean distance does, so the pruned similarity join (J6) finds them.
2. Weights: each row's kernel width is bisected until its neighbour weights have the wanted
   perplexity; the weights of both directions are added, one edge per pair.
3. Rounds: an edge pulls its ends together; all rows push each other apart.  The push is taken from
   a mesh: every row is dealt to the four nodes around it, the node sums are convolved with the
   kernel, and a row reads the field between its four nodes.  A round is one grouped sum over rows
   (node sums), and one join of edges and positions with a grouped sum (pull), written to the
   shared checkpoint folder.

What grows with the data stays in DataFrames.  The driver holds the node sums: at most
``(MESH + 2 * MAX_STEP / width + 3) ** 2`` numbers, whatever the table's size, because no row moves
by more than ``MAX_STEP`` in a round and the mesh width follows the extent of the round before.
A row that is neighbour to very many others is dealt to several salts in the position join.

Sums are whole numbers (pulls in units of 2^-30, node shares in 2^-20), so the layout does not
depend on partitions or on the order of rows.  A pull is below 1/2 and the weights at a row add up
to at most n / 2, so the sums stay in 63 bits up to 2^33 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.vectors import is_usable, safe_norm, sq_norm
from ..session import cut_lineage, let_go, written_table
from .knn_pruned import similarity_topk
from .project import pca_project

MESH = 512             # nodes along the longer side, about
NODE_WIDTH = 0.25      # distance of nodes while the layout is small enough; the push has width 1
MAX_STEP = 4.0         # largest move of a round along one axis
HUB_EDGES = 4096       # edges of a row that one salt holds
PULL_UNIT = 2 ** 30
SHARE_UNIT = 2 ** 20
BISECTIONS = 60


def euclidean_neighbours(df: DataFrame, k: int, id_col: str = "row_id", x_col: str = "x", seed: int = 0) -> DataFrame:
    """``(row_id, rank, nbr, dist2)``: the ``k`` other rows nearest to every row with a usable
    vector (all others, if fewer), nearest first; rows whose lifted products are equal come by the
    smaller id.  ``id_col`` holds unique whole numbers."""
    x = F.col(x_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("qid"), x.alias("x")).filter(is_usable(safe_norm("x")))
    # centred, so that |v|^2 does not swallow the products' digits
    dims = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()
    mean = F.array(*[F.lit(round(float(r["m"]), 6)) for r in dims])
    rows = cut_lineage(rows.withColumn("x", F.zip_with("x", mean, lambda a, b: a - b)))
    queries = rows.select("qid", F.concat("x", F.array(F.lit(1.0))).alias("x"))
    index = rows.select(F.lit(0).alias("kind"), F.col("qid").alias("iid"), F.lit(0).alias("label"),
                        F.concat("x", F.array(-sq_norm("x") / 2)).alias("v"))
    found, _ = similarity_topk(queries, index, k + 1, seed=seed)
    others = found.filter(F.col("iid") != F.col("qid"))
    w = Window.partitionBy("qid").orderBy("rank")
    ranked = others.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    norms = rows.select("qid", sq_norm("x").alias("n2"))
    return (ranked.join(norms, "qid")
            .select(F.col("qid").alias("row_id"), "rank", F.col("iid").alias("nbr"),
                    F.greatest(F.lit(0.0), F.col("n2") - 2 * F.col("score")).alias("dist2")))


@F.pandas_udf(ArrayType(DoubleType()))
def _fitted_weights(dist2: pd.Series, perplexity: pd.Series) -> pd.Series:
    """Weights of a row's neighbours: exp(-2^s d) over their sum, with s found by bisection."""
    out = []
    for d, want in zip(dist2, np.log(perplexity)):
        d = np.asarray(d, float)
        d = d - d.min()
        lo, hi = -60.0, 60.0
        for _ in range(BISECTIONS):
            mid = (lo + hi) / 2
            e = np.exp(-(2.0 ** mid) * d)
            entropy = np.log(e.sum()) + 2.0 ** mid * (d * e).sum() / e.sum()
            lo, hi = (mid, hi) if entropy > want else (lo, mid)
        e = np.exp(-(2.0 ** ((lo + hi) / 2)) * d)
        out.append(e / e.sum())
    return pd.Series(out)


def neighbour_weights(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """Edges ``(a, b, w)`` with ``a < b``: the two rows' weights for each other, halved and added.
    The weights of a row add up to 1 and have the given perplexity where a kernel width gives it
    (equal distances keep equal weights)."""
    per = neighbours.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr", "dist2"))).alias("nn"))
    fitted = per.withColumn("p", _fitted_weights(F.col("nn.dist2"), F.lit(float(perplexity))))
    one_way = fitted.select("row_id", F.explode(F.arrays_zip(F.col("nn.nbr").alias("nbr"), F.col("p").alias("p"))).alias("z"))
    # two addends at most: their sum does not depend on the order
    return (one_way.groupBy(F.least("row_id", "z.nbr").alias("a"), F.greatest("row_id", "z.nbr").alias("b"))
            .agg((F.sum("z.p") / 2).alias("w")))


def _salted(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with a salt for each end, and ids with their number of salts."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"))
    salts = ends.groupBy("id").agg(F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("salts"))
    hubs = salts.filter("salts > 1")
    out = edges
    for end, other in (("a", "b"), ("b", "a")):
        # a hub has over HUB_EDGES edges of its own, so hubs are few; the join keeps every edge
        mine = hubs.select(F.col("id").alias(end), F.col("salts").alias("_s"))
        out = (out.join(mine, end, "left")
               .withColumn(f"s{end}", F.pmod(F.xxhash64(other), F.coalesce("_s", F.lit(1))).cast("int")).drop("_s"))
    placed = ids.join(salts, "id", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return written_table(out.select("a", "b", "sa", "sb", "w")), placed


def _pull(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``(id, p0, p1)``: the pull on every row with an edge, in units."""
    at = state.select("id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), "y0", "y1")
    a = at.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    b = at.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    d0, d1 = F.col("b0") - F.col("a0"), F.col("b1") - F.col("a1")
    strength = F.col("w") / (1 + d0 * d0 + d1 * d1) * PULL_UNIT
    both = edges.join(a, ["a", "sa"]).join(b, ["b", "sb"]).select("a", "b", F.round(strength * d0).cast("long").alias("f0"), F.round(strength * d1).cast("long").alias("f1"))
    each = both.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "f0", "f1"),
                                         F.struct(F.col("b").alias("id"), (-F.col("f0")).alias("f0"), (-F.col("f1")).alias("f1")))).alias("z"))
    return each.groupBy("z.id").agg(F.sum("z.f0").alias("p0"), F.sum("z.f1").alias("p1"))


def _node_shares(state: DataFrame, width: float) -> list:
    """Nodes and the shares of rows they hold: ``(i, j, share)``."""
    i, j = F.floor(F.col("y0") / width), F.floor(F.col("y1") / width)
    u, v = F.col("y0") / width - i, F.col("y1") / width - j
    shares = [(i + di, j + dj, (u if di else 1 - u) * (v if dj else 1 - v)) for di in (0, 1) for dj in (0, 1)]
    dealt = state.select(F.explode(F.array(*[F.struct(p.cast("int").alias("i"), q.cast("int").alias("j"), F.round(s * SHARE_UNIT).cast("long").alias("c"))
                                             for p, q, s in shares])).alias("z"))
    return dealt.groupBy("z.i", "z.j").agg(F.sum("z.c").alias("c")).collect()


class Field:
    """Sums of the push and of its normaliser at the mesh nodes."""

    def __init__(self, nodes: list, width: float):
        ij = np.array([(r["i"], r["j"]) for r in nodes], np.int64)
        self.width, self.low = width, ij.min(axis=0)
        size = ij.max(axis=0) - self.low + 1
        held = np.zeros(size)
        held[tuple((ij - self.low).T)] = np.array([r["c"] for r in nodes], float) / SHARE_UNIT
        # offsets of nodes, wrapped round: a linear convolution in twice the room
        off = [np.fft.fftfreq(2 * s, 1 / (2 * s)) * width for s in size]
        d0, d1 = off[0][:, None], off[1][None, :]
        near = 1 / (1 + d0 * d0 + d1 * d1)
        spread = np.fft.rfft2(held, s=tuple(2 * size))

        def convolved(kernel):
            return np.fft.irfft2(np.fft.rfft2(kernel) * spread, s=tuple(2 * size))[:size[0], :size[1]]

        self.mass = convolved(near)
        self.push = [convolved(near * near * d) for d in (d0, d1)]
        # every row meets itself once, at distance zero
        self.total = float((held * self.mass).sum() - held.sum())
        self.extent = float((size.max() - 1) * width)

    def at(self, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The push on rows, read between the nodes."""
        i, j = np.floor(y0 / self.width), np.floor(y1 / self.width)
        u, v = y0 / self.width - i, y1 / self.width - j
        i, j = i.astype(np.int64) - self.low[0], j.astype(np.int64) - self.low[1]
        return tuple(g[i, j] * (1 - u) * (1 - v) + g[i + 1, j] * u * (1 - v) + g[i, j + 1] * (1 - u) * v + g[i + 1, j + 1] * u * v
                     for g in self.push)


def _pushed(bc):
    @F.pandas_udf("struct<r0:double,r1:double>")
    def pushed(y0: pd.Series, y1: pd.Series) -> pd.DataFrame:
        r0, r1 = bc.value.at(y0.to_numpy(), y1.to_numpy())
        return pd.DataFrame({"r0": r0, "r1": r1})
    return pushed


def _moved(axis: int, rate: float, momentum: float) -> dict[str, Column]:
    """Speed, gain and place along one axis after the round."""
    g, v, gain = F.col(f"f{axis}"), F.col(f"v{axis}"), F.col(f"g{axis}")
    gain = F.greatest(F.lit(0.01), F.when(g * v > 0, gain + 0.2).otherwise(gain * 0.8))
    speed = F.greatest(F.lit(-MAX_STEP), F.least(F.lit(MAX_STEP), momentum * v + rate * gain * g))
    return {f"y{axis}": F.col(f"y{axis}") + speed, f"v{axis}": speed, f"g{axis}": gain}


def neighbour_layout(df: DataFrame, k: int = 30, perplexity: float = 10.0, rounds: int = 30, exaggeration: float = 6.0,
                     id_col: str = "row_id", x_col: str = "x", seed: int = 0) -> DataFrame:
    """``(row_id, dim0, dim1)``, one row per row of ``df``, with neighbours in ``x`` kept near.

    Starts from the first two principal components.  The first half of the rounds multiplies the
    pull by ``exaggeration``.  ``seed`` picks the pivots of the neighbour search, which change no
    result.  Rows without a usable vector (NULL, or a NULL, NaN or infinite component) get NULL
    coordinates.  Equal vectors are rows of their own.  An only row lies at the origin; an empty
    table gives an empty result.  ``id_col`` holds unique whole numbers.
    """
    if not 1 <= perplexity <= k:
        raise ValueError(f"perplexity {perplexity} must lie between 1 and the number of neighbours {k}")
    all_ids = df.select(F.col(id_col).cast("long").alias("id"))
    rows = cut_lineage(df.select(F.col(id_col).cast("long").alias("id"), F.col(x_col).cast("array<double>").alias("x"))
                       .filter(is_usable(safe_norm("x"))))
    n = rows.count()
    if n < 2:
        at = rows.select("id", F.lit(0.0).alias("dim0"), F.lit(0.0).alias("dim1"))
        return all_ids.join(at, "id", "left").select(F.col("id").alias("row_id"), "dim0", "dim1")
    edges = neighbour_weights(euclidean_neighbours(rows, k, "id", "x", seed), perplexity)
    start = pca_project(rows, "x", 2, ["id"]) if rows.select(F.size("x")).first()[0] > 1 else rows.select("id", F.col("x")[0].alias("pc0"), F.lit(0.0).alias("pc1"))
    m0, m1, dev = start.agg(F.avg("pc0"), F.avg("pc1"), F.stddev_pop("pc0")).first()
    dev = dev or 1.0
    # rounded: the last bits of the components depend on the order of their sums
    placed = start.select("id", F.round((F.col("pc0") - m0) / dev, 6).alias("y0"), F.round((F.col("pc1") - m1) / dev, 6).alias("y1"),
                          *[F.lit(0.0).alias(c) for c in ("v0", "v1")], *[F.lit(1.0).alias(c) for c in ("g0", "g1")])
    edges, state = _salted(cut_lineage(edges), placed)
    state = written_table(state)
    lo0, hi0, lo1, hi1 = state.agg(F.min("y0"), F.max("y0"), F.min("y1"), F.max("y1")).first()
    extent = max(hi0 - lo0, hi1 - lo1)
    sc = df.sparkSession.sparkContext
    for r in range(rounds):
        width = max(NODE_WIDTH, extent / MESH)
        field = Field(_node_shares(state, width), width)
        extent = field.extent
        bc = sc.broadcast(field)
        pull = exaggeration if r < rounds // 2 else 1.0
        push = n / max(field.total, 1e-12)
        moved = state.join(_pull(edges, state), "id", "left").withColumn("_r", _pushed(bc)("y0", "y1"))
        for a in (0, 1):
            moved = moved.withColumn(f"f{a}", F.coalesce(f"p{a}", F.lit(0)) / PULL_UNIT * pull + F.col(f"_r.r{a}") * push)
        rate, momentum = 4.0 / pull, 0.5 if r < rounds // 4 else 0.8
        after = _moved(0, rate, momentum) | _moved(1, rate, momentum)
        state = written_table(moved.withColumns(after).select("id", "salts", "y0", "y1", "v0", "v1", "g0", "g1"))
        bc.unpersist()
        let_go(df.sparkSession)
    return all_ids.join(state, "id", "left").select(F.col("id").alias("row_id"), F.col("y0").alias("dim0"), F.col("y1").alias("dim1"))
