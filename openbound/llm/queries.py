"""Registered queries of the training-data operators: ``opN_<name>(spark, sf_dir)``.

Each query applies its operator with production parameters to the whole table and derives
the contract's digest columns from the operator's real outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (divergence, exact_dedup, html_extract, line_dedup, nn_descent, packing, quality, simhash, sp_transducer, stable_search, warc, wavelet,
               whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    return nn_descent.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_token_wavelet(spark, sf_dir):
    return wavelet.token_output(_table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    out = warc.page_records(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_text(spark, sf_dir):
    out = html_extract.extract_pages(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_exact_dedup(spark, sf_dir):
    out = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs).select("doc_id", "quality_score", "kept")


def op8_sentencepiece(spark, sf_dir):
    return sp_transducer.round_trip(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    before = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"))
    return line_dedup.line_dedup(before, removed_col="n_removed")


def op10_simhash(spark, sf_dir):
    out = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark, sf_dir):
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_stable_search(spark, sf_dir):
    return stable_search.nearest(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


# every pair of equal lines, the later one first; equal stretches along a diagonal of 50 words or more go
LINE_DEDUP_SQL = r"""
    WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS s,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
    lw AS (SELECT doc_id, text, s, ln, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words FROM l),
    p AS (SELECT a.doc_id, a.ln, a.words, b.doc_id AS b_doc, a.ln - b.ln AS d FROM lw a JOIN lw b ON a.s = b.s
          AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.ln < a.ln))),
    q AS (SELECT *, ln - row_number() OVER (PARTITION BY doc_id, b_doc, d ORDER BY ln) AS island FROM p),
    r AS (SELECT doc_id, min(ln) AS lo, max(ln) AS hi FROM q GROUP BY doc_id, b_doc, d, island HAVING sum(words) >= 50),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS ln FROM r)
    SELECT lw.doc_id, CASE WHEN first(lw.text) IS NULL THEN NULL
                      ELSE coalesce(string_agg(s, chr(10) ORDER BY lw.ln) FILTER (WHERE gone.ln IS NULL), '') END AS text,
           count(*)::INTEGER AS n_lines, count(gone.ln)::INTEGER AS n_removed
    FROM lw LEFT JOIN gone ON lw.doc_id = gone.doc_id AND lw.ln = gone.ln GROUP BY lw.doc_id"""

# every kept term for every pair of sources, in whole numbers
DIVERGENCE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
    c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
    g AS (SELECT DISTINCT lang, source FROM d),
    grid AS (SELECT g.lang, g.source, kept.term, kept.lang_n, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    tot AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own_n, count(*) OVER (PARTITION BY lang, source) AS v,
                   sum(lang_n) OVER (PARTITION BY lang, source) AS all_n FROM grid),
    x AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (own_n + 2 * v) AS p,
                 1 + (1000000000::HUGEINT * (lang_n + 2)) // (all_n + 2 * v) AS q FROM tot),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM x WHERE n > 0 AND p > q)
    SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
    UNION ALL
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 10"""

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_wavelet": op3_token_wavelet,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_stable_search": op12_stable_search,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op9_line_dedup": LINE_DEDUP_SQL,
    "op11_source_divergence": DIVERGENCE_SQL,
}
