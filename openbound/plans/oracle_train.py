"""SQL oracles for ``catalog_train`` (DuckDB dialect)."""

from __future__ import annotations

from ..functions.ordering import mix_sql
from .oracle import EMB_VIEW, SC, emb, label_ctes, with_

ALPHA = 4.0
BATCH = 32

# fixed values: loss variants -> (margin kind, shared last-class positive)
VARIANTS = {"new": ("vector", True), "wo_shared": ("vector", False),
            "org": ("scalar", False), "wo_margin": ("scalar", True)}


def _lt(variant: str, batched: bool = False,
        rows: str = "split = 'train' AND y < (SELECT n FROM nk)") -> str:
    kind, shared = VARIANTS[variant]
    if kind == "vector":
        pos = "CASE WHEN cos > r THEN xm ELSE cos - r END"
        neg = "CASE WHEN cos > r THEN cos - r ELSE xm END"
        inside = "cos > r"
    else:
        pos, neg, inside = "ucos - mrg", "ucos + mrg", "ucos > mrg"
    is_pos = "(y = cls OR cls = (SELECT n FROM nk))" if shared else "(y = cls)"
    src = "sc JOIN bt USING (row_id)" if batched else "sc"
    bcol = "batch, " if batched else ""
    return f"""lt AS (
  SELECT {bcol}row_id, cls, y, {inside} AS inside, {pos} AS pos_cos, {neg} AS neg_cos, {is_pos} AS is_pos,
         exp(-{ALPHA} * ({pos})) AS pos_exp, exp({ALPHA} * ({neg})) AS neg_exp
  FROM {src} WHERE {rows}),
cs AS (
  SELECT {bcol}cls, sum(CASE WHEN is_pos THEN pos_exp ELSE 0 END) AS s_pos,
         sum(CASE WHEN NOT is_pos THEN neg_exp ELSE 0 END) AS s_neg,
         max(CAST(is_pos AS INTEGER)) AS has_pos
  FROM lt GROUP BY {bcol}cls),
ls AS (
  SELECT {bcol}sum(ln(1 + s_pos)) / sum(has_pos) + sum(ln(1 + s_neg)) / ((SELECT n FROM nk) + 1) AS loss,
         CAST(sum(has_pos) AS INTEGER) AS n_valid
  FROM cs {"GROUP BY batch" if batched else ""})"""


BT = f"""bt AS (
  SELECT row_id, (row_number() OVER (ORDER BY {mix_sql('row_id', 0)}, row_id) - 1) // {BATCH} AS batch
  FROM d WHERE split = 'train')"""


ORACLES = {
    "l1_inside_mask": emb(SC, _lt("new")) + "SELECT row_id, cls, CAST(inside AS INTEGER) AS inside FROM lt",
    "l2_vector_terms": emb(SC, _lt("new")) +
        "SELECT row_id, cls, round(pos_cos, 6) AS pos_cos, round(neg_cos, 6) AS neg_cos FROM lt",
    "l3_vector_exp": emb(SC, _lt("new")) +
        "SELECT row_id, cls, round(pos_exp, 6) AS pos_exp, round(neg_exp, 6) AS neg_exp FROM lt",
    "l4_scalar_exp": emb(SC, _lt("org")) +
        "SELECT row_id, cls, round(pos_exp, 6) AS pos_exp, round(neg_exp, 6) AS neg_exp FROM lt",
    "l6_valid_classes": emb(SC, BT, _lt("wo_shared", batched=True)) +
        "SELECT CAST(batch AS BIGINT) AS batch, n_valid FROM ls",
    "l9_epoch_loss": emb(SC, BT, *[_lt(v, True).replace("lt AS", f"lt_{v} AS").replace("FROM lt ", f"FROM lt_{v} ")
                                   .replace("cs AS", f"cs_{v} AS").replace("FROM cs ", f"FROM cs_{v} ")
                                   .replace("ls AS", f"ls_{v} AS") for v in VARIANTS]) +
        "\nUNION ALL\n".join(f"SELECT '{v}' AS variant, round(avg(loss), 6) AS epoch_loss, count(*) AS n_batches "
                             f"FROM ls_{v}" for v in VARIANTS),
    # --------------------------------------------------------------- sampling
    "b1_balanced": with_(EMB_VIEW) + f"""
SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {mix_sql('row_id', 42)}, row_id) AS rn
  FROM e) WHERE rn <= 30""",
    "b2_batches": emb(BT) + "SELECT row_id, CAST(batch AS BIGINT) AS batch FROM bt",
    "p17_head_slice": """
SELECT row_id, pos FROM (SELECT vec_id AS row_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)
WHERE pos < 117""",
    # ----------------------------------------------------------------- epochs
    "m6_running_mean": """
SELECT user_id AS run_id, event_id AS epoch,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS running_sum, count(value) OVER w AS running_count,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / count(value) OVER w / 100 AS running_mean
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "m7_best_epoch": """
SELECT run_id, best_epoch, best_valid_f1 FROM (
  SELECT user_id AS run_id, event_id AS best_epoch, value AS best_valid_f1,
         row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rk
  FROM events WHERE value >= 0) WHERE rk = 1""",
    "m8_improved": """
SELECT user_id AS run_id, event_id AS epoch,
       value >= greatest(coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS improved
FROM events""",
    "m9_export_gate": """
WITH i AS (
  SELECT user_id, event_id,
         value >= greatest(coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS improved
  FROM events)
SELECT user_id AS run_id, event_id AS epoch,
       coalesce(lag(improved) OVER (PARTITION BY user_id ORDER BY event_id), true) AS export
FROM i""",
    # ------------------------------------------------------------------- text
    # the character references that the pages hold; one at the very end may lack its semicolon
    "p1_html_unescape": """
SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '&(amp|quot|copy|middot)$', '&\\1;'),
       '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text FROM pages""",
    "p3_normalize": """
SELECT doc_id, regexp_replace(text, '[^a-zA-Z가-힣ㄱ-ㅎ0-9.!?]+', ' ', 'g') AS norm_text FROM documents""",
    "s2_positional_zip": """
SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS row_id, role, text
FROM conversations""",
}

for _v in VARIANTS:
    ORACLES[f"l5_class_sums_{_v}"] = emb(SC, _lt(_v)) + \
        "SELECT cls, round(s_pos, 6) AS s_pos, round(s_neg, 6) AS s_neg, has_pos FROM cs"
    ORACLES[f"l7_loss_{_v}"] = emb(SC, _lt(_v)) + "SELECT round(loss, 6) AS loss, n_valid FROM ls"


def grid_sql(ratios=(0.25, 0.5, 0.75)) -> str:
    from .oracle import SC as _SC, _pred
    cells = []
    for r in ratios:
        for v, (kind, _) in VARIANTS.items():
            pred = _pred("r" if kind == "vector" else "mrg", "d.split = 'test'")
            f1 = (emb(_SC, pred, _lt(v, rows="split = 'test'"), ratio=r) + f"""
, cells AS (SELECT y, pred, count(*) AS n FROM pr GROUP BY y, pred),
cc AS (
  SELECT cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT y AS cls, n AS support, 0 AS predicted, CASE WHEN y = pred THEN n ELSE 0 END AS tp FROM cells
    UNION ALL SELECT pred AS cls, 0, n, 0 FROM cells) GROUP BY cls)
SELECT 'embeddings' AS dataset, CAST({r} AS DOUBLE) AS ratio, '{v}' AS variant, 'macro_f1' AS metric,
       round(avg(2.0 * tp / (support + predicted)), 6) AS value FROM cc
UNION ALL
SELECT 'embeddings', {r}, '{v}', 'loss', round(loss, 6) FROM ls""")
            cells.append(f"SELECT * FROM ({f1})")
    return "\nUNION ALL\n".join(cells)


ORACLES["m11_grid"] = grid_sql()
ORACLES["m11_grid_pivot"] = f"SELECT dataset, ratio, {', '.join(f'max(value) FILTER (WHERE variant = {v!r}) AS {v}' for v in VARIANTS)} " \
    f"FROM ({grid_sql()}) WHERE metric = 'macro_f1' GROUP BY dataset, ratio"
