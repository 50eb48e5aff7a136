"""Prototype ("proxy") tables and their initialisation.

A prototype set holds, per class of the label space (known classes plus the
trailing out-of-domain class), a proxy vector, a scalar margin and a margin
vector.  It is a model: its size is ``n_classes x dim`` and does not grow with
the data, so it lives on the driver as numpy arrays between fit steps and is
shipped to executors as broadcast rows of checked size (see ``score.py``).

Initialisers are Spark jobs over the embedding table:
* ``centroid``: per-class mean of the known training rows (JVM Summarizer,
  partial aggregation, one pass); the out-of-domain row is the mean of all
  known training rows, derived from the same class sums;
* ``random``: the reference's Kaiming-normal init (fan-out = n_classes);
* ``label_text``: the embedding of each label's name (see ``embed.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import NORM_EPS

# fixed values: the reference's initial scalar margin
INITIAL_SCALAR_MARGIN = 0.2


def _unit_rows(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True) + NORM_EPS)


@dataclass
class Prototypes:
    """Per-class model parameters; row i is class id i (last = out-of-domain)."""

    proxy: np.ndarray                   # (C, d)
    margin: np.ndarray | None = None    # (C,)   scalar margins (``org`` family)
    margin_vec: np.ndarray | None = None  # (C, d) vector margins (``new`` family)

    def __post_init__(self):
        self.proxy = np.asarray(self.proxy, dtype=np.float64)
        if self.margin is None:
            self.margin = np.full(self.n_classes, INITIAL_SCALAR_MARGIN)
        self.margin = np.asarray(self.margin, dtype=np.float64)
        if self.margin_vec is None:
            # reference init: the margin vector starts as a copy of the proxy
            self.margin_vec = self.proxy.copy()
        self.margin_vec = np.asarray(self.margin_vec, dtype=np.float64)

    @property
    def n_classes(self) -> int:
        return int(self.proxy.shape[0])

    @property
    def n_known(self) -> int:
        return self.n_classes - 1

    @property
    def dim(self) -> int:
        return int(self.proxy.shape[1])

    def radius(self) -> np.ndarray:
        """V8 on the driver: cos(margin_c, proxy_c), clamped."""
        r = (_unit_rows(self.margin_vec) * _unit_rows(self.proxy)).sum(axis=1)
        return np.clip(r, -1.0, 1.0)

    def nbytes(self) -> int:
        return int(self.proxy.nbytes + self.margin_vec.nbytes + self.margin.nbytes)

    def copy(self) -> "Prototypes":
        return Prototypes(self.proxy.copy(), self.margin.copy(), self.margin_vec.copy())

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """S10 long table ``(cls, proxy, margin, margin_vec, radius)``."""
        r = self.radius()
        rows = [(i, self.proxy[i].tolist(), float(self.margin[i]), self.margin_vec[i].tolist(),
                 float(r[i])) for i in range(self.n_classes)]
        return spark.createDataFrame(
            rows, "cls int, proxy array<double>, margin double, margin_vec array<double>, "
                  "radius double")

    @staticmethod
    def from_frame(df: DataFrame) -> "Prototypes":
        """Restore from a prototype table (bounded by the class count)."""
        rows = df.orderBy("cls").collect()           # the model: one row per class
        return Prototypes(np.array([r["proxy"] for r in rows]),
                          np.array([r["margin"] for r in rows]),
                          np.array([r["margin_vec"] for r in rows]))


def centroid_and_first_rows(raw_train: DataFrame, n_known: int, x_col: str = "x", y_col: str = "y",
                            order_col: str = "row_id") -> tuple[Prototypes, np.ndarray]:
    """R5 ``centroid`` and the first-row vectors from ONE grouped aggregation
    over the raw training rows (out-of-domain rows only feed the first-row
    vector of the last class)."""
    summ = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(x_col))).alias("s")
    agg = (raw_train.groupBy(F.col(y_col).alias("cls"))
           .agg(summ, F.min_by(x_col, order_col).alias("first"))
           .select("cls", vector_to_array("s.sum").alias("sum"), F.col("s.count").alias("count"), "first"))
    rows = agg.collect()                             # the model: one row per class
    C = n_known + 1
    dim = len(rows[0]["sum"]) if rows else 0
    sums, counts, first = np.zeros((C, dim)), np.zeros(C), np.zeros((C, dim))
    for r in rows:
        c = r["cls"]
        if 0 <= c < C:
            first[c] = r["first"]
            if c < n_known:
                sums[c], counts[c] = r["sum"], r["count"]
    proxy = np.zeros_like(sums)
    has = counts > 0
    proxy[has] = sums[has] / counts[has, None]
    if counts.sum() > 0:
        proxy[n_known] = sums[:n_known].sum(axis=0) / counts[:n_known].sum()
    return Prototypes(proxy), first


def random_prototypes(n_classes: int, dim: int, seed: int = 0) -> Prototypes:
    """R5 ``random``: Kaiming-normal with fan-out = n_classes, std = sqrt(2/n_classes)."""
    rng = np.random.default_rng(seed)
    return Prototypes(rng.normal(0.0, np.sqrt(2.0 / n_classes), size=(n_classes, dim)))


def random_vectors(classes: DataFrame, dim: int, seed: int = 0, cls_col: str = "cls") -> DataFrame:
    """R5 ``random`` as expressions: ``(cls, dim, value)``, normal numbers with deviation
    sqrt(2 / number of classes).  A number is a function of seed, class and dimension alone (two
    uniform numbers from MD5, then Box-Muller), so it is the same for any partitioning.  ``cls_col``
    holds unique ids; an empty table gives an empty result."""
    n = classes.count()
    at = classes.select(F.col(cls_col).alias("cls"), F.explode(F.sequence(F.lit(0), F.lit(int(dim) - 1))).alias("dim"))

    def uniform(which: int):
        text = F.concat_ws(":", F.lit(str(int(seed))), F.col("cls").cast("string"), F.col("dim").cast("string"), F.lit(str(which)))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") + 0.5) / float(2 ** 48)

    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * float(np.pi) * uniform(1))
    return at.select("cls", "dim", (normal * float(np.sqrt(2.0 / max(1, n)))).alias("value"))
