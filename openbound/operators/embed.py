"""Text -> embedding.

The reference runs a transformer and mean-pools its token vectors over all
``max_len`` positions, padding included (V9).  Here:

* ``embed_text``: the built-in encoder that needs no model (R2).  A token maps
  to a fixed pseudo-random sign vector, bit j of a hash of the token itself;
  a text's embedding is the mean over *all* its tokens.  One explode and one
  partial aggregation, JVM expressions only;
* ``sign_component`` / ``mean_pool``: token-id vectors and V9 for any
  ``ARRAY<ARRAY<DOUBLE>>`` of token vectors, with an optional mask (the
  reference does not mask);
* ``embed_with``: the hook for a real encoder (e.g. an ONNX model): a
  ``mapInPandas`` over Arrow batches; the user's ``load`` runs once per Python
  worker and ``encode(list[str]) -> ndarray`` once per batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import mix_key


def sign_bit(token: Column, j: Column, dim: int, seed: int) -> Column:
    return mix_key(token.cast("long") * F.lit(int(dim)) + j, seed) % 2


def sign_component(token: Column, j: Column, dim: int, seed: int) -> Column:
    return F.lit(1.0) - F.lit(2.0) * sign_bit(token, j, dim, seed).cast("double")


# bits of the token hash that one block of dimensions uses (15 hexadecimal digits)
BLOCK_BITS = 60


def token_bits(token: Column, block: int) -> Column:
    """60 hash bits of a token for dimensions ``60 * block`` and on (MD5, so SQL can follow)."""
    digest = F.md5(F.concat(token, F.lit(f":{block}")))
    return F.conv(F.substring(digest, 1, BLOCK_BITS // 4), 16, 10).cast("long")


def embed_text(df: DataFrame, key_col: str, tokens_col: str = "tokens", dim: int = 64, out_col: str = "x") -> DataFrame:
    """R2: ``(key, x ARRAY<DOUBLE>[dim])``, the mean sign vector of all tokens of a key (rows that
    share a key are one text; no tokens: the zero vector).

    The sums of a row are complete in the task that reads it; only one row per key and task is
    shuffled, however long a text is."""
    dim = int(dim)
    tokens = df.select(key_col, F.explode_outer(tokens_col).alias("_t"))
    for b in range(-(-dim // BLOCK_BITS)):
        tokens = tokens.withColumn(f"_h{b}", token_bits(F.col("_t"), b))
    ones = [F.sum(F.shiftright(F.col(f"_h{j // BLOCK_BITS}"), j % BLOCK_BITS).bitwiseAND(F.lit(1))).alias(f"_s{j}") for j in range(dim)]
    g = tokens.groupBy(key_col).agg(F.count("_t").alias("_n"), *ones)
    x = F.array(*[F.when(F.col("_n") > 0, (F.col("_n") - 2 * F.col(f"_s{j}")) / F.col("_n")).otherwise(0.0) for j in range(dim)])
    return g.select(key_col, x.alias(out_col))


def mean_pool(vectors_col: str, mask_col: str | None = None) -> Column:
    """V9: element-wise mean of token vectors; with ``mask_col`` only mask = 1 rows count."""
    vecs = F.col(vectors_col)
    dim = F.size(F.element_at(vecs, 1))
    if mask_col is None:
        n = F.size(vecs).cast("double")
        return F.transform(F.sequence(F.lit(0), dim - 1), lambda j: F.aggregate(
            vecs, F.lit(0.0), lambda acc, v: acc + v[j]) / n)
    pairs = F.arrays_zip(vecs.alias("v"), F.col(mask_col).alias("m"))
    n = F.aggregate(F.col(mask_col), F.lit(0.0), lambda acc, m: acc + m)
    return F.transform(F.sequence(F.lit(0), dim - 1), lambda j: F.aggregate(
        pairs, F.lit(0.0), lambda acc, p: acc + p["v"][j] * p["m"]) / n)


def mean_pool_tokens(df: DataFrame, keys: list[str], ids_col: str = "input_ids", dim: int = 64, seed: int = 0,
                     out_col: str = "x") -> DataFrame:
    """V9 of the token-id sign vectors over *all* positions of a row, padding included:
    ``(keys, x ARRAY<DOUBLE>[dim])``.  One explode and one partial aggregation: nested lambdas would
    evaluate every token vector once per dimension."""
    pos = df.select(*keys, F.explode(ids_col).alias("_t"))
    # the minus signs are counted: one number per dimension and a common count, exact in any order
    minus = [F.sum(sign_bit(F.col("_t"), F.lit(j), dim, seed)).alias(f"_m{j}") for j in range(int(dim))]
    g = pos.groupBy(*keys).agg(F.count("_t").alias("_n"), *minus)
    mean = [F.when(F.col("_n") > 0, (F.col("_n") - 2 * F.col(f"_m{j}")) / F.col("_n")) for j in range(int(dim))]
    return g.select(*keys, F.array(*mean).alias(out_col))


def embed_with(df: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], np.ndarray]],
               dim: int, out_col: str = "x") -> DataFrame:
    """R2 hook: run a user encoder over Arrow batches (one model load per worker)."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    out_schema = StructType(list(df.schema.fields) + [StructField(out_col, ArrayType(DoubleType()))])

    def run(batches):
        encode = load()
        for pdf in batches:
            vecs = encode(pdf[text_col].fillna("").tolist()) if len(pdf) else np.zeros((0, dim))
            pdf[out_col] = [np.asarray(v, dtype=float).tolist() for v in vecs]
            yield pdf

    return df.mapInPandas(run, out_schema)


def label_text_prototypes(label_texts: DataFrame, n_classes: int, dim: int = 64):
    """R5 ``label_text``: proxy of class c = the embedding of its label text.

    ``label_texts(cls, text)`` holds the texts of every class of the label
    space, the out-of-domain class included (several rows of a class are one
    text).  A class without a text, or a class outside ``0..n_classes-1``, is
    an error: ids never move.
    """
    from .encode import tokenize
    from .prototypes import Prototypes

    emb = embed_text(tokenize(label_texts.select("cls", "text"), "text"), "cls", dim=dim)
    odd = emb.filter(~F.col("cls").between(0, n_classes - 1) | F.col("cls").isNull()).select("cls").head(1)
    if odd:
        raise ValueError(f"class {odd[0]['cls']} is outside 0..{n_classes - 1}")
    # one row per class of the model
    rows = {r["cls"]: r["x"] for r in emb.collect()}
    missing = [c for c in range(n_classes) if c not in rows]
    if missing:
        raise ValueError(f"classes without a text: {missing[:5]}")
    return Prototypes(np.array([rows[c] for c in range(n_classes)], dtype=float))
