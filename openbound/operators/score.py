"""Scoring samples against prototypes (J1, J2, T1-T4, V2-V8 per class).

J1 plan: the prototype set is one row ``ARRAY<STRUCT<cls, p, pn, m, mn, r,
mrg>>`` (norms precomputed once per class) attached to every sample by a
broadcast nested-loop join against a one-row local relation.  The sample side
is never shuffled; each row computes its own norm once and then ``transform``s
over the classes.  J2 (proxy <-> own margin) is a same-struct field, so only
the diagonal of the margin x proxy matrix is ever computed.

Broadcast guard: one broadcast row holds at most ``BROADCAST_LIMIT_BYTES`` of
prototypes.  A larger set is cut into blocks of classes, attached one after
the other inside the same map; the per-row best is folded over the blocks, or
the blocks' class arrays are concatenated.  No key, no shuffle, same result.

One rule for rows that cannot be scored (vector NULL, or with a NULL, NaN or
infinite component): T1, T2 and T3 give the out-of-domain id, the class terms
(V2-V8, L1-L4) are NULL, and such rows add nothing to a loss.  Both engines
follow it: ``engine="expr"`` (expressions, the default) and ``engine="arrow"``
(numpy matrix products over Arrow batches, for wide prototype sets).  Which
one runs is the caller's choice, not a matter of size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clamp_unit, dot, is_usable, safe_norm
from .prototypes import Prototypes

BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
ENGINES = ("expr", "arrow")

_PROTO_SCHEMA = ("protos array<struct<cls:int, p:array<double>, pn:double, m:array<double>, "
                 "mn:double, r:double, mrg:double>>")


def prototype_row(spark, protos: Prototypes, classes: list[int] | None = None) -> DataFrame:
    """The one-row frame carrying (a block of) the prototype set."""
    import numpy as np

    ids = list(range(protos.n_classes)) if classes is None else list(classes)
    pn = np.sqrt((protos.proxy ** 2).sum(axis=1) + 1e-12)
    mn = np.sqrt((protos.margin_vec ** 2).sum(axis=1) + 1e-12)
    r = protos.radius()
    items = [(int(c), protos.proxy[c].tolist(), float(pn[c]), protos.margin_vec[c].tolist(),
              float(mn[c]), float(r[c]), float(protos.margin[c])) for c in ids]
    return spark.createDataFrame([(items,)], _PROTO_SCHEMA)


def _blocks(protos: Prototypes, limit: int) -> list[list[int]]:
    per_class = max(1, protos.nbytes() // max(1, protos.n_classes))
    size = max(1, int(limit // per_class))
    ids = list(range(protos.n_classes))
    return [ids[i:i + size] for i in range(0, len(ids), size)]


def with_norm(df: DataFrame, x_col: str = "x") -> DataFrame:
    """Add ``_xn``: the row norm, NULL for a vector that cannot be scored."""
    n = safe_norm(x_col)
    return df.withColumn("_xn", n).withColumn("_xn", F.when(is_usable(F.col("_xn")), F.col("_xn")))


def attach(df: DataFrame, protos: Prototypes, classes: list[int] | None = None) -> DataFrame:
    """Attach (a block of) the prototype row as ``protos``."""
    return df.crossJoin(F.broadcast(prototype_row(df.sparkSession, protos, classes)))


# -------------------------------------------------------- per-class terms ----

def class_scores(x_col: str = "x", clamp: bool = True, with_unclamped: bool = False) -> Column:
    """``ARRAY<STRUCT<cls, cos, xm, r, mrg[, ucos]>>`` over the attached prototypes."""
    x = F.col(x_col)

    def one(p):
        c = dot(x, p["p"]) / (F.col("_xn") * p["pn"])
        xm = clamp_unit(dot(x, p["m"]) / (F.col("_xn") * p["mn"]))
        fields = [p["cls"].alias("cls"), (clamp_unit(c) if clamp else c).alias("cos"),
                  xm.alias("xm"), p["r"].alias("r"), p["mrg"].alias("mrg")]
        if with_unclamped:
            fields.append(c.alias("ucos"))
        return F.struct(*fields)

    return F.transform(F.col("protos"), one)


def _best_accepted(scores: Column, threshold_field: str) -> Column:
    """Among classes with cos strictly above their threshold: max cos, lowest id on ties."""
    accepted = F.filter(scores, lambda s: (s["cos"] > s[threshold_field]) & ~F.isnan(s["cos"]))
    return F.array_max(F.transform(accepted, lambda s: F.struct(s["cos"].alias("c"),
                                                                (-s["cls"]).alias("nc"))))


def _best_dot(x_col: str) -> Column:
    x = F.col(x_col)
    return F.array_max(F.transform(F.col("protos"), lambda p: F.struct(
        dot(x, p["p"]).alias("c"), (-p["cls"]).alias("nc"))))


def _fold(df: DataFrame, protos: Prototypes, x_col: str, make, merge, limit: int) -> DataFrame:
    """Evaluate ``make()`` -> ``{column: expression}`` over every block of classes and merge the
    blocks' columns with ``merge(so_far, new)``."""
    out = with_norm(df, x_col)
    for i, block in enumerate(_blocks(protos, limit)):
        part = attach(out, protos, block)
        cols = make()
        for name, expr in cols.items():
            part = part.withColumn(f"{name}_b", expr)
        part = part.drop("protos")
        for name in cols:
            value = F.col(f"{name}_b") if i == 0 else merge(F.col(name), F.col(f"{name}_b"))
            part = part.withColumn(name, value).drop(f"{name}_b")
        out = part
    return out


def _scored(df: DataFrame, protos: Prototypes, x_col: str, limit: int, **kind) -> DataFrame:
    """Add ``_sc``: the class scores of all classes, block by block."""
    return _fold(df, protos, x_col, lambda: {"_sc": class_scores(x_col, **kind)}, F.concat, limit)


# ------------------------------------------------------------- predictors ----

def _stack(vectors, dim: int):
    """Matrix of the row vectors and which rows can be scored (others are zero rows)."""
    import numpy as np

    x = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None:
            row = np.asarray([np.nan if e is None else e for e in v] if getattr(v, "dtype", None) == object
                             or isinstance(v, (list, tuple)) else v, dtype=float)
            x[i] = row
    with np.errstate(over="ignore", invalid="ignore"):
        usable = np.isfinite((x * x).sum(axis=1)) & np.array([v is not None for v in vectors], dtype=bool)
    x[~usable] = 0.0
    return x, usable


def decide_numpy(vectors, protos: Prototypes, kind: str):
    """T1/T2/T3 for a block of rows with numpy (same formulas and the same rule for rows that
    cannot be scored as the expressions)."""
    import numpy as np

    x, usable = _stack(vectors, protos.dim)
    if kind == "dot":
        best = np.argmax(x @ protos.proxy.T, axis=1)      # first max = lowest id
        return np.where(usable, best, protos.n_known).astype("int32")
    xn = np.sqrt((x * x).sum(axis=1) + 1e-12)
    pn = np.sqrt((protos.proxy ** 2).sum(axis=1) + 1e-12)
    cos = np.clip((x @ protos.proxy.T) / (xn[:, None] * pn[None, :]), -1.0, 1.0)
    thr = protos.radius() if kind == "vector" else protos.margin
    acc = (cos > thr[None, :]) & usable[:, None]
    best = np.argmax(np.where(acc, cos, -np.inf), axis=1)
    return np.where(acc.any(axis=1), best, protos.n_known).astype("int32")


def predict_arrow(df: DataFrame, protos: Prototypes, kind: str, x_col: str = "x",
                  out_col: str = "pred", limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Map-only scoring over Arrow batches: one matrix product per batch.

    The prototype set is broadcast as arrays behind the size check; every
    other column passes through unchanged.
    """
    import numpy as np
    from pyspark.sql.types import IntegerType, StructField, StructType

    if protos.nbytes() > limit:
        raise ValueError("prototype set exceeds the broadcast limit: the arrow engine takes one block only, "
                         "use engine='expr'")
    shipped = df.sparkSession.sparkContext.broadcast(protos)
    schema = StructType(list(df.schema.fields) + [StructField(out_col, IntegerType())])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                pdf[out_col] = decide_numpy(pdf[x_col].to_numpy(), shipped.value, kind)
            else:
                pdf[out_col] = np.zeros(0, dtype="int32")
            yield pdf

    return df.mapInPandas(run, schema)


def _predict(df: DataFrame, protos: Prototypes, x_col: str, out_col: str, kind: str, limit: int,
             engine: str) -> DataFrame:
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}")
    if engine == "arrow":
        return predict_arrow(df, protos, kind, x_col, out_col, limit)

    def best() -> dict[str, Column]:
        if kind == "dot":
            return {"_best": _best_dot(x_col)}
        return {"_best": _best_accepted(class_scores(x_col), "r" if kind == "vector" else "mrg")}

    # greatest skips NULL: a block without an accepted class changes nothing
    out = _fold(df, protos, x_col, best, F.greatest, limit)
    pred = F.when(F.col("_xn").isNotNull(), -F.col("_best")["nc"])
    return (out.withColumn(out_col, F.coalesce(pred, F.lit(int(protos.n_known))).cast("int"))
            .drop("_best", "_xn"))


def reject_both(df: DataFrame, protos: Prototypes, x_col: str = "x", vector_col: str = "pred_vector",
                scalar_col: str = "pred_scalar", limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """T2 and T3 from one pass over the class scores (one broadcast, one scan)."""
    n = F.lit(int(protos.n_known))
    out = _scored(df, protos, x_col, limit)
    ok = F.col("_xn").isNotNull()
    for col, threshold in ((vector_col, "r"), (scalar_col, "mrg")):
        out = out.withColumn(col, F.coalesce(F.when(ok, -_best_accepted(F.col("_sc"), threshold)["nc"]), n).cast("int"))
    return out.drop("_sc", "_xn")


def reject_vector(df: DataFrame, protos: Prototypes, x_col: str = "x", out_col: str = "pred",
                  limit: int = BROADCAST_LIMIT_BYTES, engine: str = "expr") -> DataFrame:
    """Boundary rejection with vector margins.

    Keep classes whose cos is strictly greater than their radius
    cos(margin_c, proxy_c); among them the highest cos wins (lowest id on
    ties); if none is kept the row is out-of-domain (id n).  The trailing
    out-of-domain prototype competes like any other class.
    """
    return _predict(df, protos, x_col, out_col, "vector", limit, engine)


def reject_scalar(df: DataFrame, protos: Prototypes, x_col: str = "x", out_col: str = "pred",
                  limit: int = BROADCAST_LIMIT_BYTES, engine: str = "expr") -> DataFrame:
    """As T2 with the per-class scalar margin as the threshold."""
    return _predict(df, protos, x_col, out_col, "scalar", limit, engine)


def nearest_dot(df: DataFrame, protos: Prototypes, x_col: str = "x", out_col: str = "pred",
                limit: int = BROADCAST_LIMIT_BYTES, engine: str = "expr") -> DataFrame:
    """Nearest prototype by raw inner product (no normalisation); lowest id on ties."""
    return _predict(df, protos, x_col, out_col, "dot", limit, engine)


def argmax_logits(logits: Column) -> Column:
    """T4: index of the first maximal logit (0-based)."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cosine_logits(df: DataFrame, protos: Prototypes, x_col: str = "x", out_col: str = "logits",
                  limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Per-row ``ARRAY<DOUBLE>`` of clamped cosines in class order (T4 input); NULL for a row
    that cannot be scored."""
    out = _scored(df, protos, x_col, limit)
    logits = F.when(F.col("_xn").isNotNull(), F.transform("_sc", lambda s: s["cos"]))
    return out.withColumn(out_col, logits).drop("_sc", "_xn")


def class_rows(df: DataFrame, protos: Prototypes, x_col: str = "x", limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Every row with its class scores as one array ``_sc`` (clamped and unclamped cosines)."""
    return _scored(df, protos, x_col, limit, with_unclamped=True).drop("_xn")


def class_terms(df: DataFrame, protos: Prototypes, x_col: str = "x", clamp: bool = True,
                with_unclamped: bool = False, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Long form ``(..., cls, cos, xm, r, mrg[, ucos])``: one row per (sample, class).

    Produced map-side from the broadcast row; used by the loss aggregates and
    the per-class similarity queries (V2, V3, V8).  The similarities of a row
    that cannot be scored are NULL.
    """
    out = _scored(df, protos, x_col, limit, clamp=clamp, with_unclamped=with_unclamped)
    return out.withColumn("_s", F.explode("_sc")).drop("_sc", "_xn").select("*", "_s.*").drop("_s")


def dot_terms(df: DataFrame, protos: Prototypes, x_col: str = "x", limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Long form ``(..., cls, dot)`` of raw inner products (V4)."""
    x = F.col(x_col)
    make = lambda: {"_sc": F.transform(F.col("protos"), lambda p: F.struct(
        p["cls"].alias("cls"), dot(x, p["p"]).alias("dot")))}
    out = _fold(df, protos, x_col, make, F.concat, limit)
    return out.withColumn("_s", F.explode("_sc")).drop("_sc", "_xn").select("*", "_s.*").drop("_s")
