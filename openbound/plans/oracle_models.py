"""SQL oracles for ``catalog_models``: brute-force all-pairs forms."""

from __future__ import annotations

from ..functions.ordering import mix_sql
from .oracle import CLASS_COUNTS, SC, SCALAR_PRED, emb, with_

K = 5
VOCAB = 1000
MAX_LEN = 50
DIM = 16

TOK = f"""tk AS (
  SELECT doc_id AS row_id,
         list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z가-힣ㄱ-ㅎ0-9.!?]+', ' ', 'g')), ' '),
                     lambda t: t <> '') AS tokens
  FROM documents),
cnt AS (SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM tk) GROUP BY token),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY count DESC, token) + 1 AS INTEGER) AS token_id, token, count
  FROM cnt ORDER BY count DESC, token LIMIT {VOCAB}),
enc AS (
  SELECT t.row_id, CAST(p.pos AS INTEGER) AS pos,
         CAST(CASE WHEN p.pos < len(t.tokens) THEN coalesce(v.token_id, 1) ELSE 0 END AS INTEGER) AS token_id,
         CAST(p.pos < len(t.tokens) AS INTEGER) AS mask
  FROM tk t CROSS JOIN (SELECT unnest(range(0, {MAX_LEN})) AS pos) p
  LEFT JOIN vocab v ON v.token = t.tokens[p.pos + 1])"""

# the mean over all tokens of +1 or -1 by bit j of the token's MD5
BIT = "((CAST('0x' || substr(md5(token || ':0'), 1, 15) AS BIGINT) >> j) & 1)"
HASHED = with_(TOK) + f"""
SELECT t.row_id, CAST(d.j AS INTEGER) AS dim, round(coalesce(v.v, 0.0), 6) AS value
FROM tk t CROSS JOIN (SELECT unnest(range(0, {DIM})) AS j) d
LEFT JOIN (SELECT row_id, j, avg(1.0 - 2 * {BIT}) AS v
           FROM (SELECT row_id, unnest(tokens) AS token FROM tk) CROSS JOIN (SELECT unnest(range(0, {DIM})) AS j)
           GROUP BY row_id, j) v ON v.row_id = t.row_id AND v.j = d.j"""

# fixed-length windows over the whole text, pooled over all positions
POOLED = with_(TOK) + f"""
, w AS (SELECT row_id, tokens, CAST(unnest(range(0, greatest(1, (len(tokens) + {MAX_LEN - 1}) // {MAX_LEN}))) AS INTEGER) AS win FROM tk),
we AS (
  SELECT w.row_id, w.win,
         CASE WHEN w.win * {MAX_LEN} + p.pos < len(w.tokens) THEN coalesce(v.token_id, 1) ELSE 0 END AS token_id
  FROM w CROSS JOIN (SELECT unnest(range(0, {MAX_LEN})) AS pos) p
  LEFT JOIN vocab v ON v.token = w.tokens[w.win * {MAX_LEN} + p.pos + 1])
SELECT row_id, win, CAST(j AS INTEGER) AS dim,
       round(avg(1 - 2 * (({mix_sql(f'CAST(token_id AS BIGINT) * {DIM} + j', 0)}) % 2)), 6) AS value
FROM we CROSS JOIN (SELECT unnest(range(0, {DIM})) AS j) GROUP BY row_id, win, j"""

IX = """ix AS (
  SELECT 0 AS kind, row_id AS iid, y AS label,
         list_transform(x, lambda v: v / sqrt(list_dot_product(x, x) + 1e-12)) AS v
  FROM d WHERE split = 'train'
  UNION ALL
  SELECT 1 AS kind, cls AS iid, cls AS label, p AS v FROM protos),
qd AS (
  SELECT q.row_id, ix.kind, ix.iid, ix.label, list_dot_product(q.x, ix.v) AS dot
  FROM d q CROSS JOIN ix)"""

LABEL_TEXT = with_("""dv AS (SELECT source AS label FROM documents GROUP BY source)""",
                   """nk AS (SELECT CAST(round_even(count(*) * 0.5, 0) AS INTEGER) AS n FROM dv)""", """lt AS (
  SELECT b.item_id % (SELECT n FROM nk) AS cls, b.text FROM benchmark b
  UNION ALL SELECT (SELECT n FROM nk), 'oos')""", """ltk AS (
  SELECT cls, unnest(list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z가-힣ㄱ-ㅎ0-9.!?]+', ' ', 'g')), ' '),
                                 lambda t: t <> '')) AS token
  FROM lt)""") + f"""
SELECT CAST(cls AS INTEGER) AS cls, CAST(j AS INTEGER) AS dim, round(avg(1.0 - 2 * {BIT}), 6) AS value
FROM ltk CROSS JOIN (SELECT unnest(range(0, {DIM})) AS j) GROUP BY cls, j"""


def _e2e_text() -> str:
    from .oracle import PROTO_CTES, label_ctes
    tok = TOK[:TOK.index("cnt AS (")].rstrip().rstrip(",")
    return with_(tok, f"""hx AS (
  SELECT row_id, j, avg(1.0 - 2 * {BIT}) AS v
  FROM (SELECT row_id, unnest(tokens) AS token FROM tk) CROSS JOIN (SELECT unnest(range(0, {DIM})) AS j) GROUP BY row_id, j)""",
                 """xv AS (SELECT row_id, list(v ORDER BY j) AS x FROM hx GROUP BY row_id)""",
                 """e AS (
  SELECT d.doc_id AS row_id,
         CASE WHEN (d.doc_id // 20) % 10 < 7 THEN 'train' WHEN (d.doc_id // 20) % 10 = 7 THEN 'valid'
              ELSE 'test' END AS split,
         d.source AS label, xv.x
  FROM documents d JOIN xv ON xv.row_id = d.doc_id)""",
                 label_ctes(), PROTO_CTES, SC, SCALAR_PRED) + \
        "SELECT split, y, pred, count(*) AS n FROM pr GROUP BY split, y, pred"


DOC_NORM = """WITH e AS (
  SELECT doc_id AS row_id,
         CASE WHEN (doc_id // 20) % 10 < 7 THEN 'train' WHEN (doc_id // 20) % 10 = 7 THEN 'valid'
              ELSE 'test' END AS split,
         source AS label, regexp_replace(text, '[^a-zA-Z가-힣ㄱ-ㅎ0-9.!?]+', ' ', 'g') AS text
  FROM documents)
"""

ORACLES = {
    "s10_s11_bundle_round_trip": emb() + """
SELECT CAST(cls AS INTEGER) AS cls, CAST(i - 1 AS INTEGER) AS dim, round(v, 6) AS value, 0.2::DOUBLE AS margin
FROM cd""",
    "s12_metrics_log_round_trip": emb(SC, SCALAR_PRED, CLASS_COUNTS) + """
SELECT 'r1' AS run_id, 0 AS epoch, split, 'accuracy' AS name,
       round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS value FROM pr GROUP BY split
UNION ALL
SELECT 'r1', 1, split, 'macro_f1', round(avg(2.0 * tp / (support + predicted))::DOUBLE, 6) FROM cc GROUP BY split""",
    "s1b_strip_lines": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id,
       trim(regexp_replace(text, '[^a-zA-Z가-힣ㄱ-ㅎ0-9.!?]+', ' ', 'g')) AS value
FROM documents""",
    "s6_split_label_profile": DOC_NORM + """
SELECT split, label, count(*) AS count FROM e GROUP BY split, label""",
    "s9_balanced_sample_tsv": f"""
WITH s AS (
  SELECT vec_id, label, embedding FROM (
    SELECT vec_id, label, embedding,
           row_number() OVER (PARTITION BY label ORDER BY {mix_sql('vec_id', 42)}, vec_id) AS rn
    FROM embeddings) WHERE rn <= 30),
p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, label AS target,
             CAST(embedding AS DOUBLE[]) AS x FROM s)
SELECT row_id, target, CAST(i - 1 AS INTEGER) AS dim, round(v, 6) AS value FROM (
  SELECT row_id, target, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p)""",
    "s13_split_tsv_round_trip": DOC_NORM + """
SELECT split, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS row_id, label, text FROM e""",
    "e2e_text_openset": _e2e_text(),
    "r5_label_text": LABEL_TEXT,
    "t6_class_average": emb(IX) + """
SELECT row_id, CAST(label AS INTEGER) AS pred FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY row_id ORDER BY a DESC NULLS LAST, label) AS rk
  FROM (SELECT row_id, label, sum(dot) / count(*) FILTER (WHERE dot <> 0) AS a FROM qd GROUP BY row_id, label))
WHERE rk = 1""",
    "t5_knn_vote": emb(IX) + f"""
SELECT row_id, CAST(label AS INTEGER) AS pred FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) AS rk FROM (
    SELECT row_id, label, count(*) AS n FROM (
      SELECT row_id, label, row_number() OVER (PARTITION BY row_id ORDER BY dot DESC, kind, iid) AS r FROM qd)
    WHERE r <= {K} GROUP BY row_id, label))
WHERE rk = 1""",
    "r1_vocab": with_(TOK) + "SELECT token_id, token, count FROM vocab",
    "r1_encode": with_(TOK) + "SELECT row_id, pos, token_id, mask FROM enc",
    "r1_token_stats": with_(TOK) + """
SELECT t.row_id, count(u.tok) AS n_tokens, count(v.token_id) AS n_in_vocab
FROM tk t LEFT JOIN (SELECT row_id, unnest(tokens) AS tok FROM tk) u ON t.row_id = u.row_id
LEFT JOIN vocab v ON v.token = u.tok GROUP BY t.row_id""",
    "r2_embed": HASHED,
    "v9_mean_pool": POOLED,
    "s7_s8_tsv_round_trip": emb() + """
SELECT split, row_id, target, CAST(i - 1 AS INTEGER) AS dim, round(v, 6) AS value FROM (
  SELECT split, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS row_id, y AS target, unnest(x) AS v,
         generate_subscripts(x, 1) AS i
  FROM d)""",
    "s7_parquet_round_trip": emb() + """
SELECT '01' AS run_id, 1 AS epoch, split, row_id, y, CAST(i - 1 AS INTEGER) AS dim, round(v, 6) AS value FROM (
  SELECT split, row_id, y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM d)""",
    "s1_s3_line_files_round_trip": """
WITH e AS (
  SELECT doc_id AS row_id,
         CASE WHEN (doc_id // 20) % 10 < 7 THEN 'train' WHEN (doc_id // 20) % 10 = 7 THEN 'valid'
              ELSE 'test' END AS split,
         source AS label, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text
  FROM documents),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY min(row_id), label) - 1 AS INTEGER) AS pos, label
  FROM e GROUP BY label)
SELECT e.split, row_number() OVER (PARTITION BY e.split ORDER BY e.row_id) - 1 AS row_id, e.label, v.pos, e.text
FROM e JOIN vocab v ON e.label = v.label""",
    "r5_centroid": emb() + """
SELECT cls, CAST(i - 1 AS INTEGER) AS dim, round(v, 6) AS value FROM cd""",
}
# the block paths give the same rows
ORACLES["t5_knn_vote_blocked"] = ORACLES["t5_knn_vote"]
ORACLES["s1_quoted_line_ends_round_trip"] = """
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id, coalesce(text, '') AS text, source AS label, 2 AS n_fields FROM documents"""
ORACLES["t5_knn_vote_pruned"] = ORACLES["t5_knn_vote"]
ORACLES["j6_topk_pruned"] = emb(IX) + f"""
SELECT row_id, CAST(r AS INTEGER) AS rank, CAST(kind AS INTEGER) AS kind, CAST(iid AS BIGINT) AS iid, CAST(label AS INTEGER) AS label,
       round(dot, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dot DESC, kind, iid) AS r FROM qd) WHERE r <= {K}"""
ORACLES["r5_random"] = emb() + """
SELECT cls, CAST(j AS INTEGER) AS dim, round(sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) * sqrt(2.0 / n), 6) AS value
FROM (SELECT cls, j, (SELECT count(*) FROM protos) AS n,
             (CAST('0x' || substr(md5('7:' || cls || ':' || j || ':0'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u0,
             (CAST('0x' || substr(md5('7:' || cls || ':' || j || ':1'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u1
      FROM (SELECT cls, unnest(range(0, len(p))) AS j FROM protos))"""
ORACLES["r4_neighbours"] = emb() + """
SELECT row_id, CAST(r AS INTEGER) AS rank, CAST(nbr AS BIGINT) AS neighbour, round(d2, 6) AS dist2
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, nbr) AS r
      FROM (SELECT a.row_id, b.row_id AS nbr, power(list_distance(a.x, b.x), 2) AS d2 FROM d a, d b WHERE a.row_id <> b.row_id))
WHERE r <= 10"""
ORACLES["t6_class_average_blocked"] = ORACLES["t6_class_average"]
# one gradient step: weights w of the four kinds, times the similarity they act on, times the unit vector
PARTIALS = """,
t AS (
  SELECT s.cls, s.row_id, s.y = s.cls OR s.cls = (SELECT n FROM nk) AS is_pos, s.cos > s.r AS inside, s.cos, s.r, s.xm,
         list_transform(m.x, lambda v: v / sqrt(list_dot_product(m.x, m.x) + 1e-12)) AS xh
  FROM sc s JOIN m ON m.row_id = s.row_id WHERE s.split = 'train' AND s.y < (SELECT n FROM nk)),
k AS (
  SELECT cls, is_pos, xh, CAST(CASE WHEN is_pos THEN CASE WHEN inside THEN 0 ELSE 1 END ELSE CASE WHEN inside THEN 2 ELSE 3 END END AS INTEGER) AS kind,
         CASE WHEN is_pos THEN exp(-4.0 * CASE WHEN inside THEN xm ELSE cos - r END)
              ELSE exp(4.0 * CASE WHEN inside THEN cos - r ELSE xm END) END AS w,
         CASE WHEN is_pos = inside THEN xm ELSE cos END AS s
  FROM t),
a AS (
  SELECT cls, kind, sum(w) AS w, sum(w * s) AS ws FROM k GROUP BY cls, kind),
x AS (
  SELECT cls, kind, i, sum(w * v) AS xs FROM (
    SELECT cls, kind, w, unnest(xh) AS v, generate_subscripts(xh, 1) AS i FROM k) GROUP BY cls, kind, i),"""
ORACLES["r3_partials"] = emb(SC) + PARTIALS + """
spine AS (
  SELECT p.cls, CAST(q AS INTEGER) AS kind, i FROM protos p, (SELECT unnest(range(0, 4)) AS q), (SELECT unnest(range(1, 65)) AS i)),
np AS (SELECT cls, count(*) FILTER (WHERE is_pos) AS npos FROM k GROUP BY cls)
SELECT s.cls, s.kind, round(coalesce(a.w, 0), 6) AS w, round(coalesce(a.ws, 0), 6) AS ws,
       CAST(CASE WHEN s.kind = 0 THEN np.npos ELSE 0 END AS BIGINT) AS npos, CAST(s.i - 1 AS INTEGER) AS dim,
       round(coalesce(x.xs, 0), 6) AS xs
FROM spine s LEFT JOIN a ON a.cls = s.cls AND a.kind = s.kind LEFT JOIN x ON x.cls = s.cls AND x.kind = s.kind AND x.i = s.i
LEFT JOIN np ON np.cls = s.cls"""
# gradient of the loss from those sums, joint clipping, and the first step of the optimiser
ORACLES["r3_epoch"] = emb(SC) + PARTIALS + """
np AS (SELECT cls, count(*) FILTER (WHERE is_pos) AS npos FROM k GROUP BY cls),
cc AS (
  SELECT p.cls, p.p, p.mvec, sqrt(list_dot_product(p.p, p.p) + 1e-12) AS pn, sqrt(list_dot_product(p.mvec, p.mvec) + 1e-12) AS mn,
         coalesce(sum(a.w) FILTER (WHERE kind = 0), 0) AS w0, coalesce(sum(a.w) FILTER (WHERE kind = 1), 0) AS w1,
         coalesce(sum(a.w) FILTER (WHERE kind = 2), 0) AS w2, coalesce(sum(a.w) FILTER (WHERE kind = 3), 0) AS w3,
         coalesce(sum(a.ws) FILTER (WHERE kind = 0), 0) AS s0, coalesce(sum(a.ws) FILTER (WHERE kind = 1), 0) AS s1,
         coalesce(sum(a.ws) FILTER (WHERE kind = 2), 0) AS s2, coalesce(sum(a.ws) FILTER (WHERE kind = 3), 0) AS s3
  FROM protos p LEFT JOIN a ON a.cls = p.cls GROUP BY p.cls, p.p, p.mvec),
tt AS (SELECT (SELECT count(*) FROM np WHERE npos > 0) AS valid, count(*) AS n FROM cc),
ff AS (
  SELECT cc.*, -4.0 / (valid * (1 + w0 + w1)) AS kp, 4.0 / (n * (1 + w2 + w3)) AS kn,
         greatest(-1, least(1, list_dot_product(cc.p, cc.mvec) / (pn * mn))) AS r FROM cc, tt),
loss AS (SELECT sum(ln(1 + w0 + w1)) / max(valid) + sum(ln(1 + w2 + w3)) / max(n) AS loss FROM cc, tt),
ee AS (
  SELECT cls, i, kp, kn, pn, mn, r, p[i] AS p, mvec[i] AS m, p[i] / pn AS ph, mvec[i] / mn AS mh,
         kp * s1 + kn * s2 AS a_s, kp * w1 + kn * w2 AS a_w, kp * s0 + kn * s3 AS b_s
  FROM ff, (SELECT unnest(range(1, 65)) AS i)),
ys AS (
  SELECT cls, i, coalesce(sum(xs) FILTER (WHERE kind = 0), 0) AS x0, coalesce(sum(xs) FILTER (WHERE kind = 1), 0) AS x1,
         coalesce(sum(xs) FILTER (WHERE kind = 2), 0) AS x2, coalesce(sum(xs) FILTER (WHERE kind = 3), 0) AS x3 FROM x GROUP BY cls, i),
gr AS (
  SELECT ee.*, (kp * x1 + kn * x2 - a_s * ph) / pn - a_w * (mh - r * ph) / pn AS dp,
         -a_w * (ph - r * mh) / mn + (kp * x0 + kn * x3 - b_s * mh) / mn AS dm FROM ee JOIN ys USING (cls, i)),
zz AS (SELECT CASE WHEN sqrt(sum(dp * dp + dm * dm)) > 0.6 THEN 0.6 / (sqrt(sum(dp * dp + dm * dm)) + 1e-6) ELSE 1 END AS z FROM gr)
SELECT cls, CAST(i - 1 AS INTEGER) AS dim,
       round(p * (1 - 0.1 * 1e-3) - 0.1 * z * dp / (abs(z * dp) + 1e-8), 6) AS proxy,
       round(m * (1 - 0.01 * 1e-3) - 0.01 * z * dm / (abs(z * dm) + 1e-8), 6) AS margin, round(loss, 6) AS loss
FROM gr, zz, loss"""
