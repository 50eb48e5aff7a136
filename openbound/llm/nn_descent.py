"""Embedding near-dedup by NN-descent.

Equal vectors collapse to one point.  The neighbour graph starts from several random
hyperplane tables: points are sorted by (table, sign code, projection) and each is compared
with the next ones in that order, so a crowded code costs as much as any other.  Every round
of NN-descent joins neighbours of neighbours: around each point the vectors of its neighbours
and reverse neighbours meet, again compared inside a sliding window.  Points keep their best
``k`` neighbours and every neighbour at the threshold or above.

A list is saturated if it holds ``k`` links at the threshold: such a point has more partners
than its list can show.  Saturated lists are enlarged to all members of the point's component,
exactly: the component is cut into blocks that meet two at a time, and a block pair gives only
the number of links of each row (plus a spanning forest while components still grow).

There are so many tables that a pair at the threshold shares a code at least once with the
target's probability, so their number grows with the code length; beyond the first ``TABLES``
they give links only.

Recall is audited: a hash sample of points, a new one every round, is compared with all points
in blocks.  Every sampled point counts alike, and every component counts alike, however many
links it has; the smaller mean is the recall.  Links that the graph has missed are added, and
while the recall is below the target another round with twice as many fresh tables follows.
After the last round a recall below the target is an error.

Cosines are computed in double precision on normalised vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different length do not link.  Rows that repeat an id are separate
points with that id.  A null id counts as larger than all others.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, prepare, written
from .components import connected_components

THRESHOLD = 0.9
TABLES = 16           # hyperplane tables of one job, and of one round at least
K = 8                 # neighbours that a list holds before it is enlarged
WINDOW = 12           # following points that a point is compared with in sorted order
ROUNDS = 3            # rounds of neighbours-of-neighbours joins, at most
SETTLED = 0.001       # a round that adds a smaller share of links is the last
BLOCK_ROWS = 512
AUDIT_POINTS, AUDIT_TARGET, AUDIT_ROUNDS = 1024, 0.99, 4
BATCH = 2000          # rows multiplied with the audit sample at a time
EDGES = "a long, b long, sim double"


def _matrix(col) -> np.ndarray:
    """Rows of packed doubles; shorter ones are padded (only rows of one length are compared)."""
    raw = col.to_pylist()
    width = max(map(len, raw), default=0)
    if all(len(r) == width for r in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width // 8)
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.float64).reshape(len(raw), width // 8)


def _unit(batches):
    for b in batches:
        out = []
        for v in b.column(2).to_pylist():
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            out.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["p", "copies", "u"])


def points(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(row, vec_id, v)`` (``v`` null if it cannot link) and distinct points ``(p, copies, u)``."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double") + F.lit(0.0))
    fit = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(
        v, lambda x: x != 0)
    rows = written(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(fit, v).alias("v"))
                   .withColumn("row", F.monotonically_increasing_id()), "vectors")
    found = (rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("row").alias("p"), F.count("*").alias("copies"))
             .select("p", "copies", "v"))
    return rows, written(found.mapInArrow(_unit, "p long, copies long, u binary"), "points")


def _hash_tables(bits: int, seed: list[int], tables: int):
    def run(batches):
        planes: dict = {}
        for b in batches:
            lengths = np.array([len(u) for u in b.column(1).to_pylist()])
            for width in np.unique(lengths):
                rows = np.flatnonzero(lengths == width)
                part = b.take(pa.array(rows))
                x, d = _matrix(part.column(1)), int(width) // 8
                if d not in planes:
                    planes[d] = np.random.default_rng([*seed, d]).normal(size=(tables, d, bits + 1))
                for t in range(tables):
                    y = x @ planes[d][t]
                    code = (y[:, :bits] > 0) @ (1 << np.arange(bits))
                    # a group is one vector length, table and sign code
                    g = ((d * tables + t) << bits) + code
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(y[:, bits]), part.column(0), part.column(1)],
                                                     names=["g", "o", "p", "u"])
    return run


def _window_pairs(threshold: float, window: int, near: bool = True):
    """Rows sorted by (g, o, p): compares each with the next ``window`` rows of its group.  Gives
    the links, and with ``near`` for every row the best neighbour below the threshold."""
    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            g, p, x = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3))
            new = 0
            if held is not None:
                width = max(x.shape[1], held[2].shape[1])
                pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
                new = len(held[0])
                g, p, x = np.concatenate([held[0], g]), np.concatenate([held[1], p]), np.concatenate([pad(held[2]), pad(x)])
            n = len(g)
            best, who = np.full(n, -2.0), np.zeros(n, np.int64)
            out = []
            for off in range(1, min(window, n - 1) + 1):
                i = np.arange(max(0, new - off), n - off)      # pairs of two held rows are done
                i = i[(g[i] == g[i + off]) & (p[i] != p[i + off])]
                if not len(i):
                    continue
                sim = np.einsum("ij,ij->i", x[i], x[i + off])
                link = sim >= threshold
                out.append((p[i[link]], p[i[link] + off], sim[link]))
                rest, s = i[~link], sim[~link]
                up = s > best[rest]
                best[rest[up]], who[rest[up]] = s[up], p[rest[up] + off]
            some = np.flatnonzero(best > (-2 if near else 2))
            out.append((p[some], who[some], best[some]))
            a, c, s = (np.concatenate(z) for z in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c)), pa.array(s)], names=["a", "b", "sim"])
            held = (g[-window:], p[-window:], x[-window:])
    return run


def _sorted_pairs(grouped: DataFrame, threshold: float, window: int, near: bool = True) -> DataFrame:
    """Edges of rows ``(g, o, p, u)``: a range partition on the whole order splits any group."""
    parts = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (grouped.repartitionByRange(parts, "g", "o", "p").sortWithinPartitions("g", "o", "p")
             .mapInArrow(_window_pairs(threshold, window, near), EDGES))
    return pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """``(a, b, sim)`` both ways, the ``k`` best of every point (a point has ``TABLES * WINDOW``
    candidates a round at most)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def refine(pts: DataFrame, edges: DataFrame, threshold: float, k: int, window: int) -> DataFrame:
    """One round: around every point its neighbours and reverse neighbours are compared."""
    lists = _lists(edges, k)
    around = (lists.select(F.col("a").alias("g"), F.col("b").alias("p"))
              .unionByName(lists.select(F.col("b").alias("g"), F.col("a").alias("p"))).distinct())
    rows = around.join(pts.select("p", "u"), "p").select("g", F.xxhash64("p").alias("o"), "p", "u")
    return _sorted_pairs(rows, threshold, window)


def code_bits(n: int) -> int:
    return max(1, min(24, math.ceil(math.log2(max(n, 2) / 8))))


def tables_needed(bits: int, threshold: float, target: float = AUDIT_TARGET) -> int:
    """Tables after which a pair at the threshold has shared a sign code with probability ``target``."""
    same = (1 - math.acos(max(-1.0, min(threshold, 1 - 1e-9))) / math.pi) ** bits
    return 1 if same <= 0 else math.ceil(math.log(1 - target) / math.log1p(-same))


def neighbour_graph(pts: DataFrame, n: int, seed: int, threshold: float = THRESHOLD, tables: int = TABLES, k: int = K,
                    window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Edges ``(a, b, sim)`` (a < b): all links found and the best neighbours below the threshold."""
    bits, jobs, edges = code_bits(n), math.ceil(tables / TABLES), None
    for job in range(jobs):
        first = pts.select("p", "u").mapInArrow(_hash_tables(bits, [seed, job], math.ceil(tables / jobs)), "g long, o double, p long, u binary")
        some = written(_sorted_pairs(first, threshold, window, job == 0), "graph")
        edges = some if edges is None else edges.unionByName(some)
    if jobs > 1:
        edges = written(edges.groupBy("a", "b").agg(F.max("sim").alias("sim")), "graph")
    links = edges.filter(F.col("sim") >= threshold).count()
    for _ in range(rounds):
        more = refine(pts, edges, threshold, k, window)
        edges = written(edges.unionByName(more).groupBy("a", "b").agg(F.max("sim").alias("sim")), "graph")
        now = edges.filter(F.col("sim") >= threshold).count()
        if now - links <= SETTLED * links:
            break
        links = now
    return edges


def _audit(sample, threshold: float):
    """Compares rows ``(p, c, u)`` with the broadcast sample: for every sample point and its component
    the links seen and those between components, and (without counts) one missed link for every pair
    of components that the task meets."""
    def run(batches):
        ids, comps, raw = sample.value
        lengths = np.array([len(r) for r in raw])
        seen, missed = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        found: set = set()
        for b in batches:
            p, c, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            size = np.array([len(u) for u in own])
            for width in np.unique(size):
                s = np.flatnonzero(lengths == width)
                if not len(s):
                    continue
                y = np.frombuffer(b"".join(raw[i] for i in s), np.float64).reshape(len(s), -1)
                rows = np.flatnonzero(size == width)
                for lo in range(0, len(rows), BATCH):
                    r = rows[lo:lo + BATCH]
                    x = np.frombuffer(b"".join(own[i] for i in r), np.float64).reshape(len(r), -1)
                    i, j = np.nonzero(x @ y.T >= threshold)
                    i, j = r[i], s[j]
                    other = p[i] != ids[j]
                    apart = other & (c[i] != comps[j])
                    seen += np.bincount(j[other], minlength=len(ids))
                    missed += np.bincount(j[apart], minlength=len(ids))
                    found |= set(zip(comps[j[apart]].tolist(), c[i[apart]].tolist()))
        pairs, some = sorted(found), np.flatnonzero(seen)
        none = [None] * len(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in pairs] + ids[some].tolist(), pa.int64()), pa.array([b for _, b in pairs] + comps[some].tolist(), pa.int64()),
             pa.array(none + seen[some].tolist(), pa.int64()), pa.array(none + missed[some].tolist(), pa.int64())],
            names=["a", "b", "seen", "missed"])
    return run


def audit(labelled: DataFrame, n: int, threshold: float = THRESHOLD, sample_points: int = AUDIT_POINTS,
          seed: int = 0) -> tuple[float, DataFrame]:
    """Recall over a hash sample of points (``sample_points`` of them, about) against all points,
    and the pairs of components that a missed link joins.  The recall is the mean of the sampled
    points' own recalls or, if smaller, the mean of the components' means: a large component has
    many points with many links each, which would hide what the small ones miss."""
    spark = labelled.sparkSession
    share = min(1.0, sample_points / max(n, 1))
    picked = labelled.filter(F.pmod(F.xxhash64("p", F.lit(5 + seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample_points).collect()
    sample = spark.sparkContext.broadcast((np.array([r["p"] for r in picked], np.int64), np.array([r["c"] for r in picked], np.int64),
                                           [bytes(r["u"]) for r in picked]))
    got = written(labelled.select("p", "c", "u").mapInArrow(_audit(sample, threshold), "a long, b long, seen long, missed long"), "audit")
    own: dict[int, list[float]] = {}
    for r in got.filter("seen IS NOT NULL").groupBy("a", "b").agg(F.sum("seen"), F.sum("missed")).collect():
        own.setdefault(r[1], []).append(1 - r[3] / r[2])
    recall = min(np.mean(np.concatenate(list(own.values()))), np.mean([np.mean(v) for v in own.values()])) if own else 1.0
    return float(recall), got.filter("seen IS NULL").select("a", "b").distinct()


def _block_counts(threshold: float):
    """Rows sorted by group (g, own block x, other block y, p, copies, u): for every row the copies
    of the rows it links with in the pair of blocks."""
    def run(batches):
        held: list = []

        def done(rows):
            p, x, copies = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
            width = max(len(r[4]) for r in rows)
            m = np.frombuffer(b"".join(r[4].ljust(width, b"\0") for r in rows), np.float64).reshape(len(rows), -1)
            size = np.array([len(r[4]) for r in rows])
            link = (m @ m.T >= threshold) & (p[:, None] != p[None, :]) & (size[:, None] == size[None, :])
            if x.min() != x.max():
                link &= x[:, None] != x[None, :]       # pairs inside a block belong to the block's own group
            return p, link @ copies

        def batch(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for a, _ in parts])), pa.array(np.concatenate([b for _, b in parts]))],
                                              names=["p", "links"])
        for b in batches:
            ready = []
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and held[0][0] != r[0]:
                    ready.append(done(held))
                    held = []
                held.append(r)
            if ready:
                yield batch(ready)
        if held:
            yield batch([done(held)])
    return run


def count_links(labelled: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(p, links)``: every point's links inside its component, exactly, weighted by copies."""
    sizes = labelled.groupBy("c").count().filter("count > 1").select(
        "c", F.ceil(F.col("count") / block_rows).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("p", F.lit(3)), F.col("nb")).cast("int")
    dealt = (labelled.join(written(sizes, "sizes"), "c").withColumn("x", mine)
             .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select(F.struct("c", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).alias("g"), "p", "x", "copies", "u"))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = dealt.select(F.concat_ws(":", "g.c", "g.lo", "g.hi").alias("g"), "p", "x", "copies", "u")
    counts = keyed.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_block_counts(threshold), "p long, links long")
    return counts.groupBy("p").agg(F.sum("links").alias("links"))


def _label(pts: DataFrame, links: DataFrame) -> DataFrame:
    comp = written(connected_components(links), "components")
    return written(pts.join(comp, pts["p"] == comp["id"], "left").select("p", "copies", "u", F.coalesce("component", "p").alias("c")), "labelled")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                 seed: int = 7, tables: int = TABLES, report: dict | None = None) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.  ``report`` receives the
    audited recall and the number of tables of every round."""
    need(vectors, id_col, vec_col)
    prepare(vectors.sparkSession)
    rows, pts = points(vectors, id_col, vec_col)
    n = pts.count()
    links = None
    recalls: list[float] = []
    dealt: list[int] = []
    for attempt in range(AUDIT_ROUNDS):
        dealt.append(max(tables, tables_needed(code_bits(n), threshold)) << attempt)
        graph = neighbour_graph(pts, n, seed + attempt, threshold, dealt[-1])
        new = graph.filter(F.col("sim") >= threshold).select("a", "b")
        links = new if links is None else links.unionByName(new)
        labelled = _label(pts, links)
        recall, missed = audit(labelled, n, threshold, seed=attempt)
        recalls.append(recall)
        if recall < 1:
            # components are named by one of their points, so a missed pair of components is a link
            links = links.unionByName(missed)
            labelled = _label(pts, links)
        if recall >= AUDIT_TARGET:
            break
    if report is not None:
        report["recall"], report["tables"] = recalls, dealt
    if recalls[-1] < AUDIT_TARGET:
        raise RuntimeError(f"audited recall {recalls} of rounds with {dealt} tables is below {AUDIT_TARGET}")
    counts = written(count_links(labelled, threshold), "counts")
    named = labelled.select("p", "c", "copies").join(counts, "p", "left")
    # every row finds its point by its vector; points are written, so a vector that many rows share splits
    of_row = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("row").alias("p"))
    placed = written(rows.join(written(of_row, "of_row"), "v", "left").select("row", "vec_id", "p"), "placed")
    full = placed.join(named, "p", "left")
    least = written(full.filter("c IS NOT NULL").groupBy("c").agg(F.min("vec_id").alias("least")), "least")
    out = full.join(least, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
