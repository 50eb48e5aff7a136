"""Label space construction.

Data model
----------
* ``vocab(pos INT, label STRING)`` -- ordered label vocabulary;
* ``known(cls INT, label STRING)`` -- known classes, list position = class id;
* the label space is ``known`` plus ``(n, 'oos')``: the last id is always
  out-of-domain.

The vocabulary and the known list are bounded by the number of classes, not
by the data; they are the only frames broadcast here, and only behind the
``BROADCAST_MAX_LABELS`` check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import mix_key

# fixed values: the out-of-domain label name of the reference
OOS_LABEL = "oos"
BROADCAST_MAX_LABELS = 1_000_000


def known_count(vocab_size: int, ratio: float) -> int:
    """``round(len(vocab) * ratio)`` with Python's half-even rounding."""
    return int(round(vocab_size * ratio))


def known_count_col(vocab_size: Column, ratio: Column) -> Column:
    """P4 as a Column: ``bround`` is half-even like Python (``round`` is not)."""
    return F.bround(vocab_size.cast("double") * ratio, 0).cast("int")


def vocab_first_seen(df: DataFrame, label_col: str = "label",
                     order_col: str = "row_id") -> DataFrame:
    """Distinct labels in first-seen order -> ``(pos, label)``.

    Partial aggregation collapses the data to one row per label before the
    single ordered window, so the window only ever sees the vocabulary.
    """
    firsts = df.groupBy(F.col(label_col).alias("label")).agg(F.min(order_col).alias("_first"))
    w = Window.orderBy("_first", "label")
    return firsts.select((F.row_number().over(w) - 1).cast("int").alias("pos"), "label")


def known_list(labels: list[str], n_known: int, mode: str = "first", seed: int = 0) -> list[str]:
    """P5 / P6 on the driver-side vocabulary (same order as :func:`select_known`)."""
    from ..functions.ordering import mix_value
    if mode == "first":
        return labels[:n_known]
    if mode == "random":
        order = sorted(range(len(labels)), key=lambda p: (mix_value(p, seed), p))
        return [labels[p] for p in order[:n_known]]
    raise ValueError(f"unknown selection mode {mode!r}")


def select_known(vocab: DataFrame, n_known: int, mode: str = "first",
                 seed: int = 0) -> DataFrame:
    """P5 (``mode='first'``) / P6 (``mode='random'``): the known-class list.

    ``random`` draws n labels without replacement in a seeded, hash-defined
    order (numpy's stream is not reproduced); the draw order is the class id.
    """
    if mode == "first":
        return vocab.filter(F.col("pos") < n_known).select(
            F.col("pos").cast("int").alias("cls"), "label")
    if mode == "random":
        w = Window.orderBy(mix_key("pos", seed), "pos")
        ranked = vocab.select("label", (F.row_number().over(w) - 1).cast("int").alias("cls"))
        return ranked.filter(F.col("cls") < n_known).select("cls", "label")
    raise ValueError(f"unknown selection mode {mode!r}")


def label_space(known: DataFrame, n_known: int) -> DataFrame:
    """Known labels plus the trailing out-of-domain class ``(n, 'oos')``."""
    oos = known.sparkSession.createDataFrame([(int(n_known), OOS_LABEL)], "cls int, label string")
    return known.select("cls", "label").unionByName(oos)


def _maybe_broadcast(small: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(small) if bound <= BROADCAST_MAX_LABELS else small


def map_labels(df: DataFrame, known: DataFrame, n_known: int,
               label_col: str = "label", out_col: str = "y") -> DataFrame:
    """Label -> class id via a left lookup; unknown labels -> ``n``.

    Labels equal to ``'oos'`` are never known classes (the reference would
    silently overwrite that id), so a known list containing it is rejected
    upstream by :func:`check_known`.
    """
    lookup = known.select(F.col("label").alias("_lk_label"), F.col("cls").alias("_lk_cls"))
    joined = df.join(_maybe_broadcast(lookup, n_known),
                     F.col(label_col) == F.col("_lk_label"), "left")
    return joined.withColumn(out_col, F.coalesce(F.col("_lk_cls"), F.lit(int(n_known)))
                             .cast("int")).drop("_lk_label", "_lk_cls")


def drop_train_ood(df: DataFrame, n_known: int, split_col: str = "split",
                   y_col: str = "y") -> DataFrame:
    """Out-of-domain rows are dropped from the training split only."""
    return df.filter(~((F.col(split_col) == "train") & (F.col(y_col) == int(n_known))))


def known_semi(df: DataFrame, known: DataFrame, n_known: int, label_col: str = "label",
               anti: bool = False) -> DataFrame:
    """Keep rows whose label is known (semi) or unknown (anti)."""
    lookup = known.select(F.col("label").alias("_lk_label"))
    return df.join(_maybe_broadcast(lookup, n_known), F.col(label_col) == F.col("_lk_label"),
                   "left_anti" if anti else "left_semi")


def check_known(known: DataFrame) -> None:
    """Fail fast if the out-of-domain label was listed as a known class."""
    if known.filter(F.col("label") == OOS_LABEL).limit(1).count():
        raise ValueError("'oos' cannot be a known class")


# ---------------------------------------------------------------- masks ----

def one_hot(y_col: str, n_classes: int) -> Column:
    """P10: materialised one-hot ``ARRAY<INT>`` of length n_classes."""
    y = F.col(y_col)
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: (c == y).cast("int"))


def positive_mask(y: Column, cls: Column, last_cls: int, shared: bool) -> Column:
    """Row is a positive of ``cls``; with ``shared`` every row is
    also a positive of the last (out-of-domain) class."""
    pos = y == cls
    return (pos | (cls == F.lit(int(last_cls)))) if shared else pos


def negative_mask(y: Column, cls: Column, last_cls: int, shared: bool) -> Column:
    """Complement of the positive mask."""
    return ~positive_mask(y, cls, last_cls, shared)


def block_one_hot(task_cols: list[str], task_sizes: list[int]) -> Column:
    """One-hot over the concatenated class lists of several tasks.

    Task t's class k sits at column ``offset_t + k``; a NULL task value (no
    label for that task) leaves its block all zeros.  (The reference
    notebook offsets the row index but not the column; here both move.)
    """
    total = sum(task_sizes)
    hot = []
    off = 0
    for col, size in zip(task_cols, task_sizes):
        hot.append(F.col(col) + F.lit(off))
        off += size
    hot_arr = F.array(*hot)
    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)),
                       lambda j: F.coalesce(F.exists(hot_arr, lambda h: h == j).cast("int"),
                                            F.lit(0)))


def head_slice(df: DataFrame, n: int, order_cols: list[str], index_col: str = "pos") -> DataFrame:
    """The first ``n`` rows in order with their position: an ordered limit (every task
    passes on its first n), numbered afterwards, so only n rows are ever sorted in one place."""
    head = df.orderBy(*order_cols).limit(int(n))
    w = Window.orderBy(*order_cols)
    return head.withColumn(index_col, (F.row_number().over(w) - 1).cast("long"))
