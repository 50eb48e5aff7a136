"""Vocabulary build and fixed-length encoding (R1, the re-aimed P9 tokenizer).

* tokens = whitespace words of the normalised (P1-P3), lower-cased text;
* vocabulary = the ``size`` most frequent tokens over *whole* texts (count
  desc, token asc), ids from 2; 0 = padding, 1 = unknown.  Token counting is
  a partial aggregation, so a token holding a third of all words costs no
  more than any other; the top-``size`` cut is the feature (a bounded table);
* encode = first ``max_len`` token ids, padded with 0, plus the attention mask,
  exactly the shape of the reference's tokenizer output (no word-piece
  splitting, no special tokens).  ``token_stats`` reports whole-text counts.

The vocabulary is bounded by ``size`` and broadcast behind that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_rows

PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2
MAX_BROADCAST_VOCAB = 2_000_000


def tokens_from(norm_col) -> Column:
    c = F.col(norm_col) if isinstance(norm_col, str) else norm_col
    return F.filter(F.split(F.lower(c), " "), lambda t: t != "")


def tokenize(df: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """Normalise (P1-P3) and split into lower-cased whitespace tokens."""
    n = normalize_rows(df, text_col, "_norm")
    return n.withColumn(out_col, tokens_from("_norm")).drop("_norm")


def build_vocab(tokens: DataFrame, size: int, tokens_col: str = "tokens") -> DataFrame:
    """``(token_id INT, token STRING, count LONG)`` of the ``size`` most frequent tokens."""
    # explode_outer + explicit null filter: a plain explode makes the optimizer
    # infer size(tokens) > 0 below the normalisation and evaluate the Python
    # unescape UDF twice
    counts = (tokens.select(F.explode_outer(tokens_col).alias("token")).filter(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    top = counts.orderBy(F.desc("count"), F.asc("token")).limit(int(size))
    w = Window.orderBy(F.desc("count"), F.asc("token"))
    return top.select((F.row_number().over(w) + FIRST_ID - 1).cast("int").alias("token_id"),
                      "token", "count")


def _vocab_side(vocab: DataFrame, size: int) -> DataFrame:
    v = vocab.select(F.col("token").alias("_vt"), F.col("token_id").alias("_vid"))
    return F.broadcast(v) if size <= MAX_BROADCAST_VOCAB else v


def encode(tokens: DataFrame, vocab: DataFrame, vocab_size: int, key_col: str = "row_id",
           tokens_col: str = "tokens", max_len: int = 50) -> DataFrame:
    """``(key, input_ids ARRAY<INT>[max_len], attention_mask ARRAY<INT>[max_len])``."""
    ex = tokens.select(key_col, F.posexplode_outer(F.slice(tokens_col, 1, int(max_len))).alias("pos", "tok"))
    ex = ex.join(_vocab_side(vocab, vocab_size), F.col("tok") == F.col("_vt"), "left")
    ex = ex.withColumn("_id", F.when(F.col("tok").isNull(), None)
                       .otherwise(F.coalesce(F.col("_vid"), F.lit(UNK_ID))))
    g = ex.groupBy(key_col).agg(F.array_sort(F.collect_list(
        F.when(F.col("_id").isNotNull(), F.struct("pos", "_id")))).alias("_p"))
    ids = F.transform("_p", lambda s: s["_id"].cast("int"))
    n = F.size(ids)
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(int(max_len)) - n)
    return g.select(key_col,
                    F.concat(ids, pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(int(max_len)) - n))
                    .alias("attention_mask"))


def encode_windows(tokens: DataFrame, vocab: DataFrame, vocab_size: int, key_col: str = "row_id",
                   tokens_col: str = "tokens", max_len: int = 50) -> DataFrame:
    """Whole texts in fixed-length windows: ``(key, win, input_ids[max_len], attention_mask[max_len])``.
    Window w holds tokens ``w * max_len`` and on; a text without tokens has one empty window."""
    n = F.greatest(F.lit(1), F.ceil(F.size(tokens_col) / F.lit(int(max_len))).cast("int"))
    # cut before they are dealt out: a window row carries its own tokens, not the whole text
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda w: F.slice(tokens_col, w * int(max_len) + 1, int(max_len)))
    wins = tokens.select(key_col, F.posexplode(parts).alias("win", "_part"))
    part = wins.select(F.struct(key_col, "win").alias("_kw"), "_part")
    enc = encode(part, vocab, vocab_size, "_kw", "_part", max_len)
    return enc.select(f"_kw.{key_col}", "_kw.win", "input_ids", "attention_mask")


def token_stats(tokens: DataFrame, vocab: DataFrame, vocab_size: int, key_col: str = "row_id",
                tokens_col: str = "tokens") -> DataFrame:
    """Whole-text ``(key, n_tokens, n_in_vocab)``: every token, not a prefix."""
    ex = tokens.select(key_col, F.explode_outer(tokens_col).alias("tok"))
    ex = ex.join(_vocab_side(vocab, vocab_size), F.col("tok") == F.col("_vt"), "left")
    return ex.groupBy(key_col).agg(F.count("tok").alias("n_tokens"),
                                   F.count("_vid").alias("n_in_vocab"))
