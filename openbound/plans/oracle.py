"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Written from the operator definitions, not from the Spark code: long-form
outputs, the same column names, doubles rounded to 6 places, DuckDB lists are
1-based.  The tables of the driver are pre-registered views.
"""

from __future__ import annotations

from ..functions.ordering import mix_sql

RATIO = 0.5
SEED = 42

EMB_VIEW = """e AS (
  SELECT vec_id AS row_id,
         CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'valid' ELSE 'test' END AS split,
         CAST(label AS VARCHAR) AS label,
         CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings)"""

DOC_VIEW = """e AS (
  SELECT doc_id AS row_id,
         CASE WHEN (doc_id // 20) % 10 < 7 THEN 'train' WHEN (doc_id // 20) % 10 = 7 THEN 'valid'
              ELSE 'test' END AS split,
         source AS label, text
  FROM documents)"""


def label_ctes(ratio: float = RATIO, mode: str = "first", seed: int = SEED) -> str:
    if mode == "first":
        known = "known AS (SELECT pos AS cls, label FROM vocab WHERE pos < (SELECT n FROM nk))"
    else:
        known = f"""known AS (
  SELECT cls, label FROM (
    SELECT CAST(row_number() OVER (ORDER BY {mix_sql('pos', seed)}, pos) - 1 AS INTEGER) AS cls, label
    FROM vocab) WHERE cls < (SELECT n FROM nk))"""
    return f"""vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY min(row_id), label) - 1 AS INTEGER) AS pos, label
  FROM e WHERE split = 'train' GROUP BY label),
nk AS (SELECT CAST(round_even(count(*) * {ratio}, 0) AS INTEGER) AS n FROM vocab),
{known},
m AS (
  SELECT e.*, CAST(COALESCE(k.cls, (SELECT n FROM nk)) AS INTEGER) AS y
  FROM e LEFT JOIN known k ON e.label = k.label),
d AS (SELECT * FROM m WHERE NOT (split = 'train' AND y = (SELECT n FROM nk)))"""


PROTO_CTES = """tr AS (
  SELECT y, unnest(x) AS v, generate_subscripts(x, 1) AS i
  FROM d WHERE split = 'train' AND y < (SELECT n FROM nk)),
cd AS (
  SELECT y AS cls, i, avg(v) AS v FROM tr GROUP BY y, i
  UNION ALL
  SELECT (SELECT n FROM nk) AS cls, i, avg(v) AS v FROM tr GROUP BY i),
mv AS (SELECT y AS cls, arg_min(x, row_id) AS mvec FROM m WHERE split = 'train' GROUP BY y),
protos AS (
  SELECT cls, p, list_transform(generate_series(1, len(p)), lambda i: (p[i] + f[i]) / 2) AS mvec, mrg FROM (
    SELECT CAST(c.cls AS INTEGER) AS cls, list(c.v ORDER BY c.i) AS p, any_value(mv.mvec) AS f, 0.2 AS mrg
    FROM cd c LEFT JOIN mv ON c.cls = mv.cls GROUP BY c.cls))"""


def cos_sql(a: str, b: str, clamp: bool = True) -> str:
    c = (f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a}) + 1e-12)"
         f" * sqrt(list_dot_product({b}, {b}) + 1e-12)))")
    return f"greatest(-1.0, least(1.0, {c}))" if clamp else c


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def emb(*extra: str, ratio: float = RATIO) -> str:
    return with_(EMB_VIEW, label_ctes(ratio), PROTO_CTES, *extra)


def docs(*extra: str, mode: str = "first") -> str:
    return with_(DOC_VIEW, label_ctes(RATIO, mode), *extra)


SC = f"""sc AS (
  SELECT m.row_id, m.split, m.y, p.cls,
         {cos_sql('m.x', 'p.p')} AS cos,
         {cos_sql('m.x', 'p.p', clamp=False)} AS ucos,
         list_dot_product(m.x, p.p) AS dot,
         {cos_sql('p.mvec', 'p.p')} AS r,
         {cos_sql('m.x', 'p.mvec')} AS xm,
         p.mrg
  FROM m CROSS JOIN protos p)"""


def _pred(threshold: str, rows: str) -> str:
    return f"""acc AS (
  SELECT row_id, cls, row_number() OVER (PARTITION BY row_id ORDER BY cos DESC, cls) AS rk
  FROM sc WHERE cos > {threshold}),
pr AS (
  SELECT d.row_id, d.split, d.y, CAST(COALESCE(a.cls, (SELECT n FROM nk)) AS INTEGER) AS pred
  FROM d LEFT JOIN acc a ON d.row_id = a.row_id AND a.rk = 1
  WHERE {rows})"""


SCALAR_PRED = _pred("mrg", "true")
VECTOR_PRED = _pred("r", "true")

CLASS_COUNTS = """cells AS (SELECT split, y, pred, count(*) AS n FROM pr GROUP BY split, y, pred),
cc AS (
  SELECT split, cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT split, y AS cls, n AS support, 0 AS predicted, CASE WHEN y = pred THEN n ELSE 0 END AS tp FROM cells
    UNION ALL
    SELECT split, pred AS cls, 0 AS support, n AS predicted, 0 AS tp FROM cells)
  GROUP BY split, cls),
rep AS (
  SELECT split, CAST(cls AS INTEGER) AS cls,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 1.0 END AS precision,
         tp / support AS recall, 2.0 * tp / (support + predicted) AS f1, CAST(support AS BIGINT) AS support
  FROM cc WHERE support > 0)"""


def _metric(*final: str) -> str:
    return emb(SC, SCALAR_PRED, CLASS_COUNTS) + "\n".join(final)


ORACLES: dict[str, str] = {
    # ---------------------------------------------------------------- vectors
    "v1_l2_norm": with_(EMB_VIEW) + """
SELECT row_id, CAST(i - 1 AS INTEGER) AS dim, round(v / sqrt(ss + 1e-12), 6) AS value FROM (
  SELECT row_id, unnest(x) AS v, generate_subscripts(x, 1) AS i, list_dot_product(x, x) AS ss FROM e)""",
    "v2_cosine": emb(SC) + "SELECT row_id, cls, round(cos, 6) AS cos FROM sc",
    "v3_cosine_unclamped": emb(SC) + "SELECT row_id, cls, round(ucos, 6) AS cos FROM sc",
    "v4_dot": emb(SC) + "SELECT row_id, cls, round(dot, 6) AS dot FROM sc",
    "v5_acos_clamped": emb(SC) + """
SELECT row_id, cls, round(acos(least(greatest(cos, -1 + 1e-7), 1 - 1e-7)), 6) AS angle FROM sc""",
    "v6_angle": emb(SC) + "SELECT row_id, cls, round(acos(ucos), 6) AS angle FROM sc",
    "v7_sin": emb(SC) + "SELECT row_id, cls, round(sqrt(1 - cos * cos), 6) AS sin FROM sc",
    "v8_radius": emb() + f"SELECT cls, round({cos_sql('mvec', 'p')}, 6) AS radius FROM protos",
    # ---------------------------------------------------------------- scoring
    "t1_nearest_dot": emb(SC) + """
SELECT row_id, cls AS pred FROM (
  SELECT row_id, cls, row_number() OVER (PARTITION BY row_id ORDER BY dot DESC, cls) AS rk FROM sc)
WHERE rk = 1""",
    "t2_reject_vector": emb(SC, VECTOR_PRED) + "SELECT row_id, pred FROM pr",
    "t3_reject_scalar": emb(SC, SCALAR_PRED) + "SELECT row_id, pred FROM pr",
    # a document without a vector, or with NaN in it, has no class inside a boundary: out-of-domain
    "t2_t3_missing_vectors": emb(SC) + """,
ok AS (SELECT * FROM sc WHERE row_id % 7 <> 0),
vec AS (SELECT row_id, cls, row_number() OVER (PARTITION BY row_id ORDER BY cos DESC, cls) AS rk FROM ok WHERE cos > r),
sca AS (SELECT row_id, cls, row_number() OVER (PARTITION BY row_id ORDER BY cos DESC, cls) AS rk FROM ok WHERE cos > mrg)
SELECT d.doc_id AS row_id, CAST(coalesce(v.cls, (SELECT n FROM nk)) AS INTEGER) AS pred_vector,
       CAST(coalesce(s.cls, (SELECT n FROM nk)) AS INTEGER) AS pred_scalar
FROM documents d LEFT JOIN vec v ON v.row_id = d.doc_id AND v.rk = 1 LEFT JOIN sca s ON s.row_id = d.doc_id AND s.rk = 1""",
    "t4_argmax_accuracy": emb(SC) + """
SELECT split, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
  SELECT s.split, s.y, s.cls AS pred,
         row_number() OVER (PARTITION BY s.row_id ORDER BY s.cos DESC, s.cls) AS rk
  FROM sc s JOIN d ON s.row_id = d.row_id) WHERE rk = 1 GROUP BY split""",
    # ---------------------------------------------------------------- labels
    "s5_vocab_first_seen": """
SELECT CAST(row_number() OVER (ORDER BY min(doc_id), source) - 1 AS INTEGER) AS pos, source AS label
FROM documents GROUP BY source""",
    "p4_known_count": """
WITH sizes AS (
  SELECT 'embeddings' AS source_table, CAST(count(DISTINCT label) AS INTEGER) AS vocab_size FROM embeddings
  UNION ALL
  SELECT 'documents', CAST(count(DISTINCT source) AS INTEGER) FROM documents)
SELECT source_table, ratio, vocab_size, CAST(round_even(vocab_size * ratio, 0) AS INTEGER) AS n_known
FROM sizes, (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS ratio)""",
    "p5_known_first": docs() + "SELECT cls, label FROM known",
    "p6_known_random": docs(mode="random") + "SELECT cls, label FROM known",
    "p7_label_map": docs() + "SELECT row_id, split, label, y FROM m",
    "p8_drop_train_ood": docs() + "SELECT row_id, split, y FROM d",
    "j4_known_semi": docs() + "SELECT row_id, label FROM m WHERE label IN (SELECT label FROM known)",
    "j4_unknown_anti": docs() + "SELECT row_id, label FROM m WHERE label NOT IN (SELECT label FROM known)",
    "u3_label_space": docs() + "SELECT cls, label FROM known UNION ALL SELECT n, 'oos' FROM nk",
    "p10_one_hot": with_(EMB_VIEW, label_ctes()) + """
SELECT row_id, CAST(c AS INTEGER) AS cls, CAST(y = c AS INTEGER) AS hot
FROM d, (SELECT unnest(range(0, (SELECT n FROM nk) + 1)) AS c)""",
    "p11_shared_positive": with_(EMB_VIEW, label_ctes()) + """
SELECT row_id, CAST(c AS INTEGER) AS cls, CAST(y = c OR c = (SELECT n FROM nk) AS INTEGER) AS pos
FROM d, (SELECT unnest(range(0, (SELECT n FROM nk) + 1)) AS c)""",
    "p12_negative": with_(EMB_VIEW, label_ctes()) + """
SELECT row_id, CAST(c AS INTEGER) AS cls, CAST(NOT (y = c OR c = (SELECT n FROM nk)) AS INTEGER) AS neg
FROM d, (SELECT unnest(range(0, (SELECT n FROM nk) + 1)) AS c)""",
    "p13_block_one_hot": """
SELECT d.doc_id, CAST(j AS INTEGER) AS col,
       CAST(coalesce(l.quality = j, false) OR coalesce(l.toxic + 2 = j, false) AS INTEGER) AS v
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (SELECT unnest(range(0, 4)) AS j)""",
    "p14_class_filter": with_(EMB_VIEW) + "SELECT row_id, label FROM e WHERE label IN ('0','1','2','3','4','5')",
    "p15_distinct_targets": with_(EMB_VIEW, label_ctes()) + "SELECT DISTINCT y FROM d",
    "p16_rename": 'SELECT vec_id AS row_id, label AS "class" FROM embeddings',
    # ---------------------------------------------------------------- metrics
    "m1_accuracy": emb(SC, SCALAR_PRED) + """
SELECT split, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr GROUP BY split""",
    "m2_confusion": emb(SC, SCALAR_PRED) + """
SELECT s.split, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT split FROM pr) s CROSS JOIN (SELECT unnest(range(0, (SELECT n FROM nk) + 1)) AS a)
CROSS JOIN (SELECT unnest(range(0, (SELECT n FROM nk) + 1)) AS b)
LEFT JOIN (SELECT split, y, pred, count(*) AS n FROM pr GROUP BY split, y, pred) c
  ON c.split = s.split AND c.y = a AND c.pred = b""",
    "m3_report": _metric("""
SELECT split, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM rep"""),
    "m4_macro_f1": _metric("""
SELECT split, round(avg(2.0 * tp / (support + predicted)), 6) AS macro_f1 FROM cc GROUP BY split"""),
    "m5_ind_ood_f1": _metric("""
SELECT split, round(avg(f1) FILTER (WHERE cls < (SELECT n FROM nk)), 6) AS ind_f1,
       round(max(f1) FILTER (WHERE cls = (SELECT n FROM nk)), 6) AS ood_f1
FROM rep GROUP BY split"""),
    "m5_ind_ood_positional": _metric("""
, k AS (SELECT split, count(*) AS k FROM rep GROUP BY split)
SELECT r.split,
       round(CASE WHEN count(*) FILTER (WHERE r.cls < k.k - 1) = k.k - 1
                  THEN sum(r.f1) FILTER (WHERE r.cls < k.k - 1) / (k.k - 1) END, 6) AS ind_f1,
       round(max(r.f1) FILTER (WHERE r.cls = k.k - 1), 6) AS ood_f1
FROM rep r JOIN k ON r.split = k.split GROUP BY r.split, k.k"""),
    "m10_value_counts": "SELECT source AS label, count(*) AS count FROM documents GROUP BY source",
    "m12_weighted": _metric("""
SELECT split,
       round(sum(support * CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END) / sum(support), 6)
         AS weighted_precision,
       round(sum(support * CASE WHEN support > 0 THEN tp / support ELSE 0 END) / sum(support), 6)
         AS weighted_recall,
       round(sum(support * 2.0 * tp / (support + predicted)) / sum(support), 6) AS weighted_f1
FROM cc GROUP BY split"""),
}
