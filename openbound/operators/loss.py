"""Proxy-anchor losses (L1-L9) as grouped masked sums.

For sample i and class c (C = n_known + 1 classes, the last one
out-of-domain):

* vector-margin family (``new``, ``wo_shared``): cos = V2(x, P_c),
  r_c = V2(M_c, P_c), xm = V2(x, M_c); inside = cos > r_c (L1);
  pos = inside ? xm : cos - r_c, neg = inside ? cos - r_c : xm (L2);
* scalar-margin family (``org``, ``wo_margin``): unclamped cos (V3);
  pos = cos - m_c, neg = cos + m_c;
* exponentials exp(-alpha * pos), exp(alpha * neg) (L3/L4);
* positive mask y = c, plus every row positive for the last class in the
  ``new`` and ``wo_margin`` variants (P11); negatives are the complement;
* S+_c, S-_c = masked column sums (L5); n_valid = classes with >= 1
  positive (L6); loss = sum ln(1+S+)/n_valid + sum ln(1+S-)/C (L7).

Plan: the per-class terms of a row are one array, made map-side from the
broadcast prototype row; the losses sum these arrays as dense vectors per batch
(``Summarizer``, merged map-side), so N rows stay N rows and the shuffle
carries one vector per batch and task.  L1-L5 also exist in long form, one row
per (sample, class), which is their result.  Maths in DOUBLE (the reference's float32 overflows to inf for
large alpha; here results stay finite up to e^(2 alpha)).

Rows whose vector cannot be scored (see ``score``) add nothing to sums,
positives or the class count.  ``engine`` chooses expressions ("expr") or
numpy over Arrow batches ("arrow"); both give the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_usable, safe_norm
from . import score as S
from .labels import positive_mask
from .prototypes import Prototypes

# fixed values: the four loss variants of the reference experiment grid
# name -> (margin kind, every row also positive for the last class)
VARIANTS = {
    "new": ("vector", True),
    "wo_shared": ("vector", False),
    "org": ("scalar", False),
    "wo_margin": ("scalar", True),
}


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _usable(df: DataFrame, x_col: str) -> DataFrame:
    return df.filter(is_usable(safe_norm(x_col)))


def loss_terms(df: DataFrame, protos: Prototypes, variant: str, alpha: float,
               x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Long form per (row, class): ``inside, pos_cos, neg_cos, pos_exp, neg_exp, is_pos``."""
    kind, shared = VARIANTS[variant]
    t = S.class_terms(df, protos, x_col, clamp=(kind == "vector"))
    cos = F.col("cos")
    if kind == "vector":
        inside = cos > F.col("r")
        pos_cos = F.when(inside, F.col("xm")).otherwise(cos - F.col("r"))
        neg_cos = F.when(inside, cos - F.col("r")).otherwise(F.col("xm"))
    else:
        inside = cos > F.col("mrg")
        pos_cos = cos - F.col("mrg")
        neg_cos = cos + F.col("mrg")
    a = float(alpha)
    is_pos = positive_mask(F.col(y_col), F.col("cls"), protos.n_known, shared)
    return (t.withColumn("inside", inside)
            .withColumn("pos_cos", pos_cos).withColumn("neg_cos", neg_cos)
            .withColumn("pos_exp", F.exp(F.lit(-a) * F.col("pos_cos")))
            .withColumn("neg_exp", F.exp(F.lit(a) * F.col("neg_cos")))
            .withColumn("is_pos", is_pos))


def class_sums(terms: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """``(by..., cls, s_pos, s_neg, has_pos)``."""
    keys = _keys(by)
    return terms.groupBy(*keys, "cls").agg(
        F.sum(F.when(F.col("is_pos"), F.col("pos_exp")).otherwise(F.lit(0.0))).alias("s_pos"),
        F.sum(F.when(~F.col("is_pos"), F.col("neg_exp")).otherwise(F.lit(0.0))).alias("s_neg"),
        F.max(F.col("is_pos").cast("int")).alias("has_pos"))


def combine(sums: DataFrame, n_classes: int, by: Sequence[str] | str | None = None) -> DataFrame:
    """L7 from the class sums: ``(by..., loss, pos_term, neg_term, n_valid)``."""
    keys = _keys(by)
    g = sums.groupBy(*keys).agg(
        F.sum(F.log1p("s_pos")).alias("_lp"), F.sum(F.log1p("s_neg")).alias("_ln"),
        F.sum("has_pos").cast("int").alias("n_valid"))
    return g.select(*keys, (F.col("_lp") / F.col("n_valid") + F.col("_ln") / F.lit(float(n_classes)))
                    .alias("loss"),
                    (F.col("_lp") / F.col("n_valid")).alias("pos_term"),
                    (F.col("_ln") / F.lit(float(n_classes))).alias("neg_term"), "n_valid")


def class_sums_arrow(df: DataFrame, protos: Prototypes, variants, alpha: float,
                     by: Sequence[str] | str | None = None, x_col: str = "x",
                     y_col: str = "y") -> DataFrame:
    """L5/L6 for wide prototype sets: numpy per partition (one matrix product
    per batch and group key), ``(variant, by..., cls, s_pos, s_neg, has_pos)``
    partial rows merged by a partial ``groupBy``."""
    if protos.nbytes() > S.BROADCAST_LIMIT_BYTES:
        raise ValueError("prototype set exceeds the broadcast limit: use engine='expr'")
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField, StructType)

    from .fit import partial_sums

    keys = _keys(by)
    src = df.select(*keys, F.col(y_col).cast("int").alias("_y"), F.col(x_col).alias("_x"))
    fields = [StructField("variant", StringType())] + [src.schema[k] for k in keys] + [
        StructField("cls", IntegerType()), StructField("s_pos", DoubleType()),
        StructField("s_neg", DoubleType()), StructField("has_pos", IntegerType())]
    C = protos.n_classes
    variants = list(variants)

    shipped = df.sparkSession.sparkContext.broadcast(protos)

    def run(batches):
        # sums accumulate over the whole partition: one row per (variant, batch key, class) leaves it
        total: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            p = shipped.value
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for gkey, g in groups:
                gkey = gkey if isinstance(gkey, tuple) else (gkey,)
                x, usable = S._stack(g["_x"].to_numpy(), p.dim)
                xh = x[usable] / np.sqrt((x[usable] ** 2).sum(axis=1) + 1e-12)[:, None]
                y = g["_y"].to_numpy()[usable]
                for v in variants:
                    ps = partial_sums(xh, y, p, v, alpha)
                    new = np.stack([ps["pos_in"][0] + ps["pos_out"][0], ps["neg_in"][0] + ps["neg_out"][0], ps["npos"]])
                    old = total.get((v, *gkey))
                    total[(v, *gkey)] = new if old is None else old + new
        for (v, *gkey), sums in total.items():
            out = {"variant": [v] * C} | {k: [gkey[i]] * C for i, k in enumerate(keys)}
            yield pd.DataFrame(out | {"cls": np.arange(C, dtype="int32"), "s_pos": sums[0], "s_neg": sums[1],
                                      "has_pos": (sums[2] > 0).astype("int32")})

    parts = src.mapInPandas(run, StructType(fields))
    return parts.groupBy("variant", *keys, "cls").agg(
        F.sum("s_pos").alias("s_pos"), F.sum("s_neg").alias("s_neg"),
        F.max("has_pos").alias("has_pos"))


def _row_sums(df: DataFrame, protos: Prototypes, variants: Sequence[str], alpha: float, keys: list[str],
              x_col: str, y_col: str) -> DataFrame:
    """L5/L6 of several variants, ``(variant, keys..., cls, s_pos, s_neg, has_pos)``: every row makes one
    dense vector of its masked exponentials, and the vectors are summed per key.  No row is ever
    multiplied by the number of classes."""
    t = S.class_rows(_usable(df, x_col), protos, x_col)
    a, y, c = float(alpha), F.col(y_col), protos.n_classes

    def arrays(kind: str, shared: bool) -> list:
        def mask(s):
            return positive_mask(y, s["cls"], protos.n_known, shared)

        def terms(s):
            if kind == "scalar":
                return s["ucos"] - s["mrg"], s["ucos"] + s["mrg"]
            inside = s["cos"] > s["r"]
            return (F.when(inside, s["xm"]).otherwise(s["cos"] - s["r"]), F.when(inside, s["cos"] - s["r"]).otherwise(s["xm"]))
        return [F.transform("_sc", lambda s: F.when(mask(s), F.exp(F.lit(-a) * terms(s)[0])).otherwise(0.0)),
                F.transform("_sc", lambda s: F.when(~mask(s), F.exp(F.lit(a) * terms(s)[1])).otherwise(0.0)),
                F.transform("_sc", lambda s: mask(s).cast("double"))]
    parts = [x for v in variants for x in arrays(*VARIANTS[v])]
    total = (t.select(*keys, array_to_vector(F.concat(*parts)).alias("_v")).groupBy(*keys)
             .agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("_t")))
    cells = total.filter(F.size("_t") > 0).select(*keys, "_t", F.explode(F.sequence(F.lit(0), F.lit(len(variants) * c - 1))).alias("_i"))
    v, cls = F.floor(F.col("_i") / c).cast("int"), (F.col("_i") % c).cast("int")
    at = lambda k: F.element_at("_t", v * (3 * c) + k * c + cls + 1)
    names = F.array(*[F.lit(n) for n in variants])
    return cells.select(F.element_at(names, v + 1).alias("variant"), *keys, cls.alias("cls"), at(0).alias("s_pos"),
                        at(1).alias("s_neg"), (at(2) > 0).cast("int").alias("has_pos"))


def proxy_loss(df: DataFrame, protos: Prototypes, variant: str = "new", alpha: float = 64.0,
               by: Sequence[str] | str | None = None, x_col: str = "x", y_col: str = "y",
               engine: str = "expr") -> DataFrame:
    """One entry point for the four variants; ``by`` = batch keys."""
    return multi_variant_loss(df, protos, [variant], alpha, by, x_col, y_col, engine).drop("variant")


def multi_variant_loss(df: DataFrame, protos: Prototypes, variants=tuple(VARIANTS), alpha: float = 64.0,
                       by: Sequence[str] | str | None = None, x_col: str = "x",
                       y_col: str = "y", engine: str = "expr") -> DataFrame:
    """All requested variants from ONE pass over the rows: ``(variant, by..., loss, n_valid)``."""
    keys = _keys(by)
    make = class_sums_arrow if engine == "arrow" else _row_sums
    sums = make(df, protos, list(variants), alpha, keys, x_col, y_col)
    return combine(sums, protos.n_classes, ["variant", *keys])


def epoch_loss(batch_losses: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """Unweighted mean of the per-batch losses (one row per ``by`` group)."""
    return batch_losses.groupBy(*_keys(by)).agg(F.avg("loss").alias("epoch_loss"),
                                                F.count(F.lit(1)).alias("n_batches"))
