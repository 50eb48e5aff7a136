"""Quality classifier from weak labels.

Heuristic labellers read a whole text and vote low, good or nothing.  Their votes overlap and
err, so their reliabilities are estimated without any gold label: expectation-maximisation
over a two-class model in which every labeller votes independently given the class.  The
votes of the whole corpus enter as counts per vote pattern (at most ``3 ** labellers`` rows,
whatever the corpus holds), so one partial aggregation feeds every iteration.  The posterior
of a document's pattern is its soft label; a linear scorer over hashed features (byte trigrams
and binned statistics) learns these labels on a bounded hash sample and scores every text.

Defined results: null text is the empty text; a text on which no labeller votes has the class
prior as its label.  Repeated rows are scored alike, null ids are kept.  An empty table gives
an empty result.  Other columns are kept, and may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, prepare

SAMPLE_DOCS = 4000        # documents the scorer is fitted on, at most about (a documented bound)
DIM_BITS = 12             # hashed features: 2 ** DIM_BITS
ROUNDS = 200              # expectation-maximisation rounds, at most
THRESHOLD = 0.5           # documents whose probability of being good is lower are rejected
LOW, NONE, GOOD = 0, 1, 2

#: ASCII symbols that prose seldom holds, and the classes a text's bytes are mapped to
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
MARKS = bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~"
_ALL = bytes(range(256))
_NOT_SYMBOL = bytes(b for b in _ALL if b not in SYMBOLS)
_NOT_LETTER = bytes(b for b in _ALL if not chr(b).isalpha() or b > 127)
_NOT_CAPITAL = bytes(b for b in _ALL if not 65 <= b <= 90)
_CLASS = bytes(42 if b in MARKS else 32 if b in b" \t\n\v\f\r" else 97 for b in _ALL)


@dataclass(frozen=True)
class Labeller:
    """Votes low on one side of a statistic, good on the other, nothing between."""

    stat: str
    low: float
    good: float
    least_words: int = 5

    def vote(self, s: dict) -> int:
        x = s[self.stat]
        if s["words"] < self.least_words:
            return NONE
        if self.low > self.good:
            return LOW if x >= self.low else GOOD if x <= self.good else NONE
        return LOW if x <= self.low else GOOD if x >= self.good else NONE


LABELLERS = (
    Labeller("symbols", 0.10, 0.03),           # symbols among the bytes
    Labeller("symbol_words", 0.30, 0.05),      # pairs of marks per word
    Labeller("capitals", 0.50, 0.15),          # capitals among the ASCII letters
    Labeller("shouts", 0.30, 0.05),            # exclamation marks per word
    Labeller("bare_marks", 0.20, 0.05),        # single marks between spaces, per word
    Labeller("distinct", 0.25, 0.45, 20),      # distinct words among the words
    Labeller("top_word", 0.25, 0.15, 20),      # share of the most frequent word
    Labeller("echoes", 0.20, 0.05, 8),         # words equal to the word before
    Labeller("packed", 0.20, 0.30, 20),        # compressed size per byte
    Labeller("same_lines", 0.50, 0.34, 8),     # lines that repeat another line
)


def statistics(text: str | None) -> dict:
    """What the labellers and the binned features look at, from the whole text."""
    t = text or ""
    words = t.split()
    n = len(words)
    raw = t.encode("utf-8", "surrogatepass")
    seen = Counter(words)
    count = lambda drop: len(raw.translate(None, drop))
    classes = raw.translate(_CLASS)
    lines = [x for x in t.split("\n") if x]
    d = max(n, 1)
    return {
        "words": n,
        "symbols": count(_NOT_SYMBOL) / max(len(raw) - n, 1),
        "symbol_words": classes.count(b"**") / d,
        "capitals": count(_NOT_CAPITAL) / max(count(_NOT_LETTER), 1),
        "shouts": t.count("!") / d,
        "bare_marks": classes.count(b" * ") / d,
        # long natural texts repeat words, roughly as the square root of their length
        "distinct": len(seen) / d * max(1.0, n / 500) ** 0.5,
        "top_word": max(seen.values(), default=0) / d,
        "echoes": sum(map(str.__eq__, words, words[1:])) / d,
        "packed": len(zlib.compress(raw, 1)) / len(raw) if raw else 1.0,
        "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
    }


def votes(text: str | None) -> int:
    """The vote pattern as one number, three states a labeller."""
    s, code = statistics(text), 0
    for lab in LABELLERS:
        code = code * 3 + lab.vote(s)
    return code


def unpack(codes: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    out = np.empty((len(codes), n), np.int64)
    for j in range(n - 1, -1, -1):
        out[:, j] = codes % 3
        codes = codes // 3
    return out


@F.pandas_udf(T.LongType())
def _votes_udf(text: pd.Series) -> pd.Series:
    return text.map(votes).astype("int64")


def vote_pattern(text: Column) -> Column:
    return _votes_udf(F.coalesce(text.cast("string"), F.lit("")))


@dataclass
class LabelModel:
    """Class prior and probabilities ``table[labeller, class, vote]`` of a vote that is cast
    (class 1 is good).  Casting none says nothing about the class: most labellers are silent
    on texts too short to judge."""

    prior: float
    table: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability of being good for each vote pattern."""
        v = unpack(codes, len(self.table))
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :] + sum(
            (np.log(self.table[j][:, v[:, j]]).T for j in range(len(self.table))), np.zeros((len(codes), 2)))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """Of each labeller: the chance that a vote it casts is right."""
        pri = np.array([1 - self.prior, self.prior])
        return pri[0] * self.table[:, 0, LOW] + pri[1] * self.table[:, 1, GOOD]


def fit_label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, n: int = len(LABELLERS)) -> LabelModel:
    """Expectation-maximisation over vote patterns with their counts, started from the share
    of good votes (any low vote weighs as much as all good ones: most labellers look for one
    fault and say good of every other)."""
    v = unpack(codes, n)
    low, good = (v == LOW).sum(axis=1), (v == GOOD).sum(axis=1)
    p = np.where(low > 0, np.where(low >= 2, 0.05, 0.25), np.where(good > 0, 0.95, 0.8))
    hot = np.stack([(v == k) for k in (LOW, NONE, GOOD)], axis=2).astype(float)
    w = counts.astype(float)
    hot[:, :, NONE] = 0.0
    model = LabelModel(0.5, np.ones((n, 2, 3)))
    last = None
    for _ in range(rounds):
        by_class = np.stack([w * (1 - p), w * p], axis=1)
        size = by_class.sum(axis=0)
        # one imagined vote of each kind keeps every probability above zero
        table = np.einsum("ic,ijk->jck", by_class, hot) + 1.0
        table[:, :, NONE] = 0.0
        table /= table.sum(axis=2, keepdims=True)
        table[:, :, NONE] = 1.0
        model = LabelModel(float((size[1] + 1) / (size.sum() + 2)), table)
        p = model.posterior(codes) if len(codes) else p
        if last is not None and (len(p) == 0 or np.abs(p - last).max() < 1e-6):
            break
        last = p
    return model


# -- hashed linear scorer ----------------------------------------------------------------------

def _bin_features(s: dict, dim_bits: int) -> list[int]:
    """Hashed bins of the statistics."""
    out = []
    for name, x in s.items():
        step = int(np.log2(x + 1) * 2) if name == "words" else int(min(x, 2.0) * 20)
        out.append(zlib.crc32(f"{name}={step}".encode()) >> (32 - dim_bits))
    return out


def _trigrams(raw: bytes, dim_bits: int) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    key = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - dim_bits)


def features(text: str | None, dim_bits: int = DIM_BITS) -> np.ndarray:
    """Dense hashed features: shares of byte trigrams plus one for every binned statistic."""
    grams = _trigrams((text or "").encode("utf-8", "surrogatepass"), dim_bits)
    x = np.bincount(grams, minlength=1 << dim_bits).astype(np.float32)
    if len(grams):
        x *= np.float32(4.0 / len(grams))
    for i in _bin_features(statistics(text), dim_bits):
        x[i] += 0.25
    return x


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    dim_bits: int = DIM_BITS

    def probability(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        z = self.bias + 0.25 * float(self.weights[_bin_features(statistics(text), self.dim_bits)].sum())
        total, n = 0.0, max(len(raw) - 2, 0)
        for lo in range(0, n, 1 << 20):                  # stretches keep the memory of long texts bounded
            total += float(self.weights[_trigrams(raw[lo:lo + (1 << 20) + 2], self.dim_bits)].sum())
        z += 4.0 * total / n if n else 0.0
        return float(1 / (1 + np.exp(-z)))


def fit_scorer(x: np.ndarray, p: np.ndarray, dim_bits: int = DIM_BITS, steps: int = 250, rate: float = 0.5, l2: float = 1e-4,
               copies: np.ndarray | None = None) -> Scorer:
    """Logistic regression on soft labels: full-batch gradient steps with momentum; a row counts ``copies`` times."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return Scorer(w, 1.0, dim_bits)
    p = p.astype(np.float32)
    # both classes weigh alike, but no document more than ten times another
    copies = np.ones(len(p), np.float32) if copies is None else copies.astype(np.float32)
    share = float(np.clip(np.average(p, weights=copies), 0.09, 0.91))
    weight = copies * (p / share + (1 - p) / (1 - share))
    weight /= weight.sum()
    b, vw, vb, sw, sb = 0.0, np.zeros_like(w), 0.0, np.full_like(w, 1e-8), 1e-8
    for _ in range(steps):
        z = x @ w + b
        g = weight * (1 / (1 + np.exp(-z)) - p)
        gw, gb = x.T @ g + l2 * w, float(g.sum())
        sw += gw * gw
        sb += gb * gb
        vw = 0.9 * vw + gw / np.sqrt(sw)
        vb = 0.9 * vb + gb / sb ** 0.5
        w -= rate * 0.1 * vw
        b -= rate * 0.1 * vb
    return Scorer(w, b, dim_bits)


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer
    patterns: int


def fit_quality(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Fit on a table: vote statistics cover all rows, the scorer's sample is bounded
    (a text takes its share of the table's rows in it, however many copies it has)."""
    need(docs, text_col)
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"))
    counts = rows.select(vote_pattern(F.col("text")).alias("v")).groupBy("v").count().collect()
    codes, n = np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64)
    labels = fit_label_model(codes, n)
    # every different text counts in the sample as often as its rows are due, sample_docs in all; the hash of the
    # text decides about the part of a row that is left over
    total = int(n.sum())
    picked = rows.withColumn("h", F.lit(0)).withColumn("w", F.lit(1))
    if total > sample_docs:
        buckets = 1 << 30
        h = F.xxhash64("text", F.lit(11))
        due = F.col("n") * F.lit(int(buckets * sample_docs / total))
        extra = F.pmod("h", F.lit(buckets)) < due % F.lit(buckets)
        texts = (rows.groupBy(h.alias("h")).agg(F.count("*").alias("n"))
                 .select("h", (F.floor(due / F.lit(buckets)) + extra.cast("long")).alias("w")).filter("w > 0"))
        picked = rows.withColumn("h", h).join(F.broadcast(texts), "h").dropDuplicates(["h"])
    bits = DIM_BITS

    @F.pandas_udf("binary")
    def sparse(t: pd.Series) -> pd.Series:
        def one(x):
            f = features(x, bits)
            i = np.flatnonzero(f)
            return i.astype("<u2").tobytes() + f[i].astype("<f4").tobytes()
        return t.map(one)
    got = picked.select("h", "w", vote_pattern(F.col("text")).alias("v"), sparse("text").alias("x")).collect()
    if total > sample_docs:
        got.sort(key=lambda r: r["h"])
    x = np.zeros((len(got), 1 << bits), np.float32)
    for row, r in zip(x, got):
        m = len(r["x"]) // 6
        row[np.frombuffer(r["x"], "<u2", m)] = np.frombuffer(r["x"], "<f4", m, 2 * m)
    scorer = fit_scorer(x, labels.posterior(np.array([r["v"] for r in got], np.int64)), bits,
                        copies=np.array([r["w"] for r in got]))
    return QualityModel(labels, scorer, len(codes))


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of being good (an existing column of that name is replaced)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.scorer)      # 2 ** DIM_BITS numbers

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return t.map(shipped.value.probability).astype("float64")
    return docs.withColumn(score_col, score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def classify(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, model: QualityModel | None = None,
             score_col: str = "quality_score", kept_col: str = "kept") -> DataFrame:
    """``docs`` with ``quality_score`` and ``kept``."""
    prepare(docs.sparkSession)
    scored = score_documents(docs, model or fit_quality(docs, text_col), text_col, score_col)
    return scored.withColumn(kept_col, F.col(score_col) >= threshold)
