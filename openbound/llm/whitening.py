"""Embedding whitening by a bidiagonal qd solver.

Entries become integers ``x = floor(scale * c) + shift`` (``c`` as double), so the number of rows
``n`` and the sums ``S`` of each dimension are exact.  The centred rows ``(n*x - S) / n`` are
reduced block by block: a task stacks each block under its triangle and takes the QR of both, the
tasks' triangles are reduced in groups of ``FAN`` until one is left.  The covariance is never
formed.  On that triangle R, whose size is the square of the dimension and no more:

* Householder reflections from both sides make it bidiagonal, ``R = U B V'``;
* dqds (the differential quotient-difference transform with shifts) finds the squares of B's
  singular values from products, quotients and sums of positive numbers, so small ones keep their
  relative accuracy.  B is split first wherever it has a negligible off-diagonal entry;
* for each of the leading values a stationary transform from the top and a progressive one from
  the bottom of ``B'B - value`` are joined at the row where the twisted pivot is least; the
  vector follows from that row by products alone.  Vectors of values closer than ``CLOSE``
  (relatively) are made orthogonal, with inverse iteration where that leaves too little;
* V takes the vectors back to the dimensions: the whitening directions.

A third pass measures the covariance of the whitened rows (blocks centred on their own means and
merged pairwise), a fourth returns the rows.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are dropped.
All other rows come out, null and repeated ids included, repeated rows each counted.  Directions
without variance (an eigenvalue below ``dim * 1e-15`` of the largest) have no whitened value and
are left out: one row, or equal rows only, give an empty result, as an empty table does and
vectors without entries do.  Vectors of different lengths, entries whose integer exceeds 2**53
and a deviation beyond a long are errors that say so.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, prepare, written

# fixed values of the query contract
SCALE, SHIFT, COMPONENTS = 1024, 100000, 8
FAN = 8                # triangles reduced in one task
BLOCK_ROWS = 4096      # rows stacked under a triangle at a time
CLOSE = 1e-3           # values nearer than this, relatively, are made orthogonal to each other
EPS = float(np.finfo(float).eps)
LONG_MAX = (1 << 63) - 1


# -- rows to integers -------------------------------------------------------------------------

def usable(vec: str):
    """No null vector, no null, NaN or infinite entry."""
    v = F.col(vec)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(col: pa.Array, dim: int, scale: int, shift: int) -> np.ndarray:
    """The vectors of a batch as a matrix of integers."""
    lengths = np.diff(col.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors have {dim} entries, one has {lengths[lengths != dim][0]}")
    y = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if y.size and np.abs(y).max() > 2.0 ** 53 - abs(shift):
        raise ValueError("an entry is too large for an exact integer")
    return y.astype(np.int64).reshape(-1, dim) + shift


def _exact(n: int, x: np.ndarray, sums: list[int]) -> np.ndarray:
    """``n*x - S``, in 64 bits if that holds it, in Python integers if not."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if most < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(n: int, x: np.ndarray, sums: list[int]) -> np.ndarray:
    return (_exact(n, x, sums) / n).astype(np.float64)


def _column_sums(dim: int, scale: int, shift: int):
    def run(batches):
        n, total = 0, [0] * dim
        for b in batches:
            x = integers(b.column(0), dim, scale, shift)
            for lo in range(0, len(x), 512):          # 512 numbers of 54 bits fit 64
                total = [t + int(s) for t, s in zip(total, x[lo:lo + 512].sum(axis=0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "sums"])
    return run


def fit_sums(rows: DataFrame, vec: str, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension: one row per task, added up by Spark."""
    first = rows.select(F.size(vec).alias("d")).first()
    if first is None or first["d"] < 1:
        return 0, []
    parts = rows.select(vec).mapInArrow(_column_sums(first["d"], scale, shift), "n long, sums array<string>")
    got = (parts.select("n", F.posexplode("sums").alias("dim", "s")).groupBy("dim")
           .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    got.sort(key=lambda r: r["dim"])                  # one row per dimension
    return got[0]["n"], [int(r["s"]) for r in got]


# -- blockwise reductions ---------------------------------------------------------------------

def _triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _reduce_triangles(dim: int):
    def run(key, table):
        r = np.zeros((0, dim))
        for raw in table.column("state").to_pylist():
            r = _triangle(np.vstack([r, np.frombuffer(raw).reshape(-1, dim)]))
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([r.tobytes()], pa.binary())})
    return run


def _merge_moments(k: int):
    """States are ``(n, mean, centred products)`` in one vector of doubles."""
    def run(key, table):
        total = np.zeros(1 + k + k * k)
        for raw in table.column("state").to_pylist():
            total = merged(total, np.frombuffer(raw), k)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([total.tobytes()], pa.binary())})
    return run


def merged(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[1:1 + k] - a[1:1 + k]
    mean = a[1:1 + k] + gap * (b[0] / n)
    return np.concatenate([[n], mean, a[1 + k:] + b[1 + k:] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)])


def _per_task(rows: DataFrame, vec: str, start, step, fan_in, tag: str) -> bytes | None:
    """One state per task, reduced ``FAN`` at a time; states are written after every level."""
    def run(batches):
        from pyspark import TaskContext
        state = None
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                if part.num_rows:
                    state = step(start if state is None else state, part.column(0))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.tobytes()], pa.binary())], names=["k", "state"])
    level = written(rows.select(vec).mapInArrow(run, "k long, state binary"), tag)
    left = (level.agg(F.max("k")).first()[0] or 0) + 1
    while left > 1:
        level = written(level.withColumn("k", F.expr(f"k div {FAN}")).groupBy("k").applyInArrow(fan_in, "k long, state binary"), tag)
        left = -(-left // FAN)
    got = level.select("state").first()
    return None if got is None else bytes(got[0])


def reduced_triangle(rows: DataFrame, vec: str, n: int, sums: list[int], scale: int, shift: int) -> np.ndarray:
    """R of the centred rows' QR."""
    dim = len(sums)

    def step(r, col):
        return _triangle(np.vstack([r, _centred(n, integers(col, dim, scale, shift), sums)]))
    raw = _per_task(rows, vec, np.zeros((0, dim)), step, _reduce_triangles(dim), "triangle")
    r = np.zeros((dim, dim))
    got = np.frombuffer(raw).reshape(-1, dim)
    r[:len(got)] = got
    return r


# -- the solver, on one triangle ----------------------------------------------------------------

def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit ``v`` and ``alpha`` with ``(I - 2 v v') x = alpha e1``."""
    size = float(np.abs(x).max(initial=0.0))
    if size == 0.0:
        return np.zeros_like(x), 0.0
    v = x / size
    norm = math.sqrt(float(v @ v))
    alpha = -norm if v[0] >= 0 else norm
    v[0] -= alpha
    return v / math.sqrt(float(v @ v)), alpha * size


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V of ``r = U B V'``."""
    a, m = r.astype(float).copy(), len(r)
    v_all, diag, upper = np.eye(m), np.zeros(m), np.zeros(max(m - 1, 0))
    for i in range(m):
        v, diag[i] = _reflector(a[i:, i])
        a[i:, i:] -= 2.0 * np.outer(v, v @ a[i:, i:])
        if i + 1 < m:
            v, upper[i] = _reflector(a[i, i + 1:])
            a[i:, i + 1:] -= 2.0 * np.outer(a[i:, i + 1:] @ v, v)
            v_all[:, i + 1:] -= 2.0 * np.outer(v_all[:, i + 1:] @ v, v)
    return diag, upper, v_all


def _transform(q: list, e: list, tau: float) -> tuple[list, list, float] | None:
    """One dqds sweep by ``tau``; None if the shift passed the smallest value."""
    m = len(q)
    nq, ne, d = [0.0] * m, [0.0] * (m - 1), q[0] - tau
    for i in range(m - 1):
        if d < 0 or math.isnan(d):
            return None
        nq[i] = d + e[i]
        if nq[i] == 0.0:                   # a zero value: the rest starts anew
            ne[i], d = 0.0, q[i + 1] - tau
            continue
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - tau
    nq[m - 1] = d
    return None if d < 0 or math.isnan(d) else (nq, ne, d)


def dqds(diag, upper) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    blocks = [([float(x) ** 2 for x in diag], [float(x) ** 2 for x in upper], 0.0)]
    out: list[float] = []
    rounds = 0
    while blocks:
        q, e, base = blocks.pop()
        while q:
            m = len(q)
            if m == 1:
                out.append(base + q[0])
                break
            cut = next((i for i in range(m - 2, -1, -1) if e[i] <= EPS * EPS * (base + min(q[i], q[i + 1])) or e[i] == 0.0), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1] * 0.5:           # graded upwards: turn it round, the values stay
                q, e = _turned(q, e)
            rounds += 1
            if rounds > 200 * len(diag):
                raise RuntimeError("dqds did not settle")
            # the smaller value of the last two rows of B B' is an upper bound: go somewhat below it
            a, b, c = q[-2] + e[-1], math.sqrt(q[-1] * e[-1]), q[-1]
            half, mean = (a - c) / 2, (a + c) / 2
            low = max(0.0, (a * c - b * b) / (mean + math.hypot(half, b))) if mean > 0 else 0.0
            near = e[-1] / (e[-1] + q[-2]) if q[-2] > 0 else 1.0
            tau = low * max(0.0, 1.0 - 2.0 * math.sqrt(near))
            got = None
            for tau in (tau, tau / 4, 0.0):
                got = _transform(q, e, tau)
                if got is not None:
                    break
            q, e, _ = got
            base += tau
    return np.array(sorted(out, reverse=True))


def _turned(q: list, e: list) -> tuple[list, list]:
    """qd arrays of the same values with the order of the rows reversed: of ``J B' J``, whose
    diagonal and upper diagonal are those of B backwards."""
    return q[::-1], e[::-1]


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of ``B'B`` for ``value``, B from the squares ``q`` (diagonal) and ``e``
    (upper diagonal, signs taken as positive), by a twisted factorisation."""
    m = len(q)
    if m == 1:
        return np.ones(1)
    tiny = EPS * EPS * (value + float(q.max()) + float(e.max(initial=0.0)))
    # B'B = L D L' with D = q and L's subdiagonal l = sqrt(e/q)
    l = np.sqrt(e / np.where(q[:-1] > 0, q[:-1], tiny))
    s, p = np.zeros(m), np.zeros(m)
    lp, um = np.zeros(m - 1), np.zeros(m - 1)
    s[0] = -value
    for i in range(m - 1):                  # stationary, from the top
        dp = q[i] + s[i]
        dp = dp if abs(dp) > tiny else -tiny
        lp[i] = q[i] * l[i] / dp
        s[i + 1] = lp[i] * l[i] * s[i] - value
    p[m - 1] = q[m - 1] - value
    for i in range(m - 2, -1, -1):          # progressive, from the bottom
        dm = q[i] * l[i] * l[i] + p[i + 1]
        dm = dm if abs(dm) > tiny else -tiny
        t = q[i] / dm
        um[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    k = int(np.abs(gamma).argmin())
    z = np.zeros(m)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(k, m - 1):
        z[i + 1] = -um[i] * z[i]
    return z / math.sqrt(float(z @ z))


def _inverse_step(q: np.ndarray, e: np.ndarray, value: float, z: np.ndarray) -> np.ndarray:
    """Solves ``(B'B - value) y = z`` by elimination with row exchanges."""
    t = np.diag(q + np.concatenate([[0.0], e])) + np.diag(np.sqrt(q[:-1] * e), 1) + np.diag(np.sqrt(q[:-1] * e), -1)
    y = np.linalg.solve(t - (value * (1 + 4 * EPS) + EPS * EPS) * np.eye(len(q)), z)
    return y / math.sqrt(float(y @ y))


def _without_zeros(diag: np.ndarray, upper: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    """The same B' B with every row that starts with a zero emptied by rotations of rows (they
    leave V alone), so that B splits there."""
    a, b = diag.copy(), upper.copy()
    for i in range(len(a) - 1):
        if abs(a[i]) <= tiny:
            f, a[i], b[i] = b[i], 0.0, 0.0
            for j in range(i + 1, len(a)):
                if f == 0.0:
                    break
                r = math.hypot(a[j], f)
                c, s, a[j] = a[j] / r, f / r, r
                if j + 1 < len(a):
                    f, b[j] = -s * b[j], c * b[j]
    return a, b


def leading_vectors(diag: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values (falling), and the right singular vectors of the first ``k``
    as columns."""
    m = len(diag)
    tiny = 1e-3 * EPS * max(float(np.abs(diag).max(initial=0.0)), float(np.abs(upper).max(initial=0.0)))
    diag, upper = _without_zeros(diag, upper, tiny)
    cuts = [0, *[i + 1 for i in range(m - 1) if abs(upper[i]) <= tiny], m]
    spectrum = []
    for lo, hi in zip(cuts, cuts[1:]):
        for v in dqds(diag[lo:hi], upper[lo:hi - 1]):
            spectrum.append((float(v), lo, hi))
    spectrum.sort(key=lambda x: (-x[0], x[1]))
    # the signs of B: with s_0 = 1 and s_{i+1} = s_i * sign(diag_i * upper_i), S B'B S has positive entries
    vectors = np.zeros((m, min(k, m)))
    noise = np.random.default_rng(7)
    for c in range(min(k, m)):
        value, lo, hi = spectrum[c]
        q, e = diag[lo:hi] ** 2, upper[lo:hi - 1] ** 2
        sign = np.concatenate([[1.0], np.cumprod(np.where(diag[lo:hi - 1] * upper[lo:hi - 1] < 0, -1.0, 1.0))])
        near = [j for j in range(c) if spectrum[j][1] == lo and spectrum[j][0] - value <= CLOSE * spectrum[j][0]]
        z = _twisted(q, e, value) * sign
        for _ in range(6):
            before = math.sqrt(float(z @ z))
            for j in near:
                z = z - (vectors[lo:hi, j] @ z) * vectors[lo:hi, j]
            size = math.sqrt(float(z @ z))
            if size > 0.5 * before:
                break
            z = _inverse_step(q, e, value, noise.standard_normal(hi - lo)) * sign
        for j in near:                       # once more: what rounding left
            z = z - (vectors[lo:hi, j] @ z) * vectors[lo:hi, j]
        vectors[lo:hi, c] = z / math.sqrt(float(z @ z))
    return np.array([s[0] for s in spectrum]), vectors


def directions(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading eigenvalues of the covariance ``r'r / n``, their unit vectors as columns, its trace."""
    size = float(np.abs(r).max(initial=0.0))
    if not n or size == 0.0:
        return np.zeros(0), np.zeros((len(r), 0)), 0.0
    r = r / size
    diag, upper, v = bidiagonal(r)
    values, w = leading_vectors(diag, upper, k)
    # variance below rounding is none
    keep = int((values[:k] > len(r) * 1e-15 * values[0]).sum())
    unit = v @ w[:, :keep]
    return values[:keep] * (size * size / n), unit, float(values.sum()) * (size * size / n)


# -- whitened rows ------------------------------------------------------------------------------

def _identity_error(rows, vec, n, sums, scale, shift, axes) -> float:
    dim, k = axes.shape

    def step(state, col):
        w = _centred(n, integers(col, dim, scale, shift), sums) @ axes
        mean = w.mean(axis=0)
        w = w - mean
        return merged(state, np.concatenate([[len(w)], mean, (w.T @ w).ravel()]), k)
    raw = _per_task(rows, vec, np.zeros(1 + k + k * k), step, _merge_moments(k), "moments")
    total = np.frombuffer(raw)
    return float(np.abs(total[1 + k:].reshape(k, k) / total[0] - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row per usable vector and component: ``vec_id, component, n, deviation, whitened,
    explained, identity_error``."""
    need(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    prepare(spark)
    rows = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
            .filter(usable("vec")))
    n, sums = fit_sums(rows, "vec", scale, shift)
    empty = spark.createDataFrame([], OUT)
    if not n:
        return empty
    r = reduced_triangle(rows, "vec", n, sums, scale, shift)
    values, unit, trace = directions(r, n, components)
    k = len(values)
    if not k:
        return empty
    axes = unit / np.sqrt(values)
    error = _identity_error(rows, "vec", n, sums, scale, shift, axes)
    dim = len(sums)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                if not part.num_rows:
                    continue
                gap = _exact(n, integers(part.column(1), dim, scale, shift), sums)
                if gap.dtype == object or dim * int(np.abs(gap).max()) ** 2 > LONG_MAX:
                    dev = [sum(int(g) * int(g) for g in row) for row in gap]
                    if max(dev) > LONG_MAX:
                        raise OverflowError("a deviation does not fit a long")
                else:
                    dev = (gap * gap).sum(axis=1)
                w = (gap / n).astype(np.float64) @ axes
                m = len(w)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(np.array(dev, np.int64), k)), pa.array(w.ravel()),
                    pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, OUT)
