"""Open-set setup shared by the registered queries (the reference's data path).

``prepare`` = S4/S5 vocabulary -> P4 known count -> P5/P6 known list -> P7
label map -> P8 train OOD drop.  The vocabulary size is one small driver-side
number (a count over distinct labels); everything else stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators.prototypes import Prototypes, centroid_and_first_rows
from ..session import cut_lineage


@dataclass
class OpenSet:
    data: DataFrame          # (row_id, split, label, ..., y) after the train OOD drop
    mapped: DataFrame        # same, before the drop
    vocab: DataFrame         # (pos, label)
    known: DataFrame         # (cls, label)
    vocab_size: int
    n_known: int

    @property
    def n_classes(self) -> int:
        return self.n_known + 1

    def split(self, name: str) -> DataFrame:
        return self.data.filter(self.data["split"] == name)


def prepare(df: DataFrame, ratio: float, mode: str = "first", seed: int = 0,
            order_col: str = "row_id", vocab: DataFrame | None = None) -> OpenSet:
    """``vocab(pos, label)`` is the label vocabulary (S4); without one it is built from the
    training rows (S5), so a label that only occurs elsewhere is out-of-domain.

    The vocabulary (one row per label) is checkpointed once; its size is all that the driver
    sees, whatever the number of labels."""
    if vocab is None:
        vocab = L.vocab_first_seen(df.filter(F.col("split") == "train"), "label", order_col)
    vocab = cut_lineage(vocab.select("pos", "label"))
    vocab_size = vocab.count()
    n_known = L.known_count(vocab_size, ratio)
    known = cut_lineage(L.select_known(vocab, n_known, mode, seed))
    L.check_known(known)
    mapped = L.map_labels(df, known, n_known)
    data = L.drop_train_ood(mapped, n_known)
    return OpenSet(data, mapped, vocab, known, vocab_size, n_known)


def centroid_fixture(os_: OpenSet, with_margin_vectors: bool = False) -> Prototypes:
    """Prototype fixture without learning: centroids, scalar
    margin 0.2; optionally margin vector = midpoint of the proxy and the
    class's first training row (first unknown-label training row for the
    out-of-domain class).  The midpoint keeps every data row off the
    acceptance boundary, so ``cos > radius`` never hinges on rounding."""
    raw_train = os_.mapped.filter(os_.mapped["split"] == "train")
    protos, first = centroid_and_first_rows(raw_train, os_.n_known)
    if with_margin_vectors:
        protos = Prototypes(protos.proxy, protos.margin, 0.5 * (protos.proxy + first))
    return protos


def prepare_with_prototypes(df: DataFrame, ratio: float, mode: str = "first", seed: int = 0,
                            margin_vectors: bool = False, x_col: str = "x",
                            order_col: str = "row_id") -> tuple[OpenSet, Prototypes]:
    """``prepare`` + ``centroid_fixture`` from ONE aggregation over the data.

    ``groupBy(label, is_train)`` yields, per label and side, the first id,
    the vector sum and count (``Summarizer``) and the first vector -- at most
    two rows per label reach the driver.  The vocabulary order, the known
    list, the class ids, the centroids (out-of-domain = mean of all known
    training rows) and the first-row margin fixture all follow from that
    bounded result, so the data is read once instead of twice.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    from pyspark.sql import functions as F

    summ = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(x_col))).alias("s")
    agg = (df.groupBy("label", (F.col("split") == "train").alias("_tr"))
           .agg(F.min(order_col).alias("_first"), summ, F.min_by(x_col, order_col).alias("_fx"))
           .select("label", "_tr", "_first", vector_to_array("s.sum").alias("_sum"),
                   F.col("s.count").alias("_n"), "_fx"))
    rows = agg.collect()                             # two rows per label: the model's raw material
    # vocabulary from the training rows, as in prepare
    first = {r["label"]: r["_first"] for r in rows if r["_tr"]}
    labels = sorted(first, key=lambda lab: (first[lab], lab))
    vocab_size = len(labels)
    n_known = L.known_count(vocab_size, ratio)
    known_labels = L.known_list(labels, n_known, mode, seed)
    if L.OOS_LABEL in known_labels:
        raise ValueError("'oos' cannot be a known class")
    cls_of = {lab: i for i, lab in enumerate(known_labels)}
    spark = df.sparkSession
    vocab = spark.createDataFrame(list(enumerate(labels)), "pos int, label string")
    known = spark.createDataFrame(list(enumerate(known_labels)), "cls int, label string")
    mapped = L.map_labels(df, known, n_known)
    os_ = OpenSet(L.drop_train_ood(mapped, n_known), mapped, vocab, known, vocab_size, n_known)

    train = [r for r in rows if r["_tr"]]
    dim = len(train[0]["_sum"]) if train else 0
    C = n_known + 1
    sums, counts, fx = np.zeros((C, dim)), np.zeros(C), np.zeros((C, dim))
    oos_first = None
    for r in train:
        c = cls_of.get(r["label"])
        if c is not None:
            sums[c], counts[c], fx[c] = r["_sum"], r["_n"], r["_fx"]
        elif oos_first is None or r["_first"] < oos_first[0]:
            oos_first = (r["_first"], r["_fx"])
    if oos_first is not None:
        fx[n_known] = oos_first[1]
    proxy = np.zeros((C, dim))
    has = counts > 0
    proxy[has] = sums[has] / counts[has, None]
    if counts.sum() > 0:
        proxy[n_known] = sums.sum(axis=0) / counts.sum()
    protos = Prototypes(proxy)
    if margin_vectors:
        protos = Prototypes(protos.proxy, protos.margin, 0.5 * (protos.proxy + fx))
    return os_, protos
