"""Registry of named queries with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def md5(seed, purpose: str, *keys: str) -> str:
    """SQL of :func:`loomtext.functions.rng.draw`."""
    return f"md5(concat_ws(':', '{seed}:{purpose}', {', '.join(f'({k})::VARCHAR' for k in keys)}))"


def md5_int(seed, purpose: str, *keys: str) -> str:
    return f"('0x' || substr({md5(seed, purpose, *keys)}, 1, 8))::BIGINT"


SPECIES = r"[A-Z](?:[a-z]+|\.)\s[a-z]+"
#: SQL of the views in :mod:`loomtext.fixtures`, each a list of common table expressions.
ART = r"art AS (SELECT doc_id AS article_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS tokens FROM documents)"
LEX = rf"men AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SPECIES}')) AS name FROM documents), lex AS (SELECT name FROM men WHERE name LIKE '% %' GROUP BY name HAVING count(*) >= 5)"
TOK = f"{ART}, tok AS (SELECT article_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS pos FROM art)"
SPANS = f"""{TOK}, {LEX},
nxt AS (SELECT article_id, pos, w || ' ' || lead(w) OVER (PARTITION BY article_id ORDER BY pos) AS name FROM tok),
spans AS (
  SELECT article_id, pos AS ord, 'SPEC/name' AS source_key, 'SPEC' AS label4, pos AS start, 2 AS length, pos + 2 AS end_excl FROM nxt WHERE name IN (SELECT name FROM lex)
  UNION ALL SELECT article_id, 1000000000 + pos, 'STRA/digit', 'STRA', pos, 1, pos + 1 FROM tok WHERE regexp_matches(w, '[0-9]'))"""
LAB = f"""{SPANS},
cell AS (SELECT article_id, ord, start, label4, unnest(range(start, start + length)) AS pos FROM spans),
top AS (SELECT article_id, pos, arg_max(CASE WHEN pos = start THEN 'B-' ELSE 'I-' END || label4, ord) AS label FROM cell GROUP BY 1, 2),
lab AS (SELECT t.article_id, t.pos, t.w, coalesce(top.label, 'O') AS label FROM tok t LEFT JOIN top USING (article_id, pos))"""
STOP = "(w LIKE '%.' AND (w = '].' OR (length(w) >= 3 AND lower(w) NOT IN ('fig.', 'al.', 'sp.', 'spp.', 'e.g.', 'pv.', 'eg.'))))"
SENT = f"""sn AS (SELECT article_id, pos, w, coalesce(sum(CASE WHEN {STOP} THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM tok),
sent AS (SELECT article_id, k::BIGINT AS k, min(pos) AS s, max(pos) AS e FROM sn GROUP BY 1, 2)"""
RUNS = """runs0 AS (
  SELECT event_id AS ord, 'task1' AS task, 'set' || (user_id % 2 + 1) AS "set", (user_id % 5)::INT AS seed, event_type AS model_id,
    CASE WHEN event_id % 2 = 0 THEN 'all' ELSE 'none' END AS train_variant, 'test' AS eval_split,
    CASE WHEN event_id % 3 = 0 THEN 'augmented_exclusive' ELSE 'unaugmented' END AS eval_set, (event_id % 4 + 1)::INT AS epoch,
    (event_id % 97) / 96.0::DOUBLE AS precision, (event_id % 89) / 88.0::DOUBLE AS recall, value AS loss, ts AS run_updated_at FROM events),
runs AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM runs0)"""
PAIRS = "pairs AS (SELECT doc_id AS i, quality AS y_true, 1 - toxic AS y_pred, abs(quality - (1 - toxic)) + 0.1::DOUBLE AS loss FROM labels)"


def classify_sql(types: str, pooled: str, negative: str, neg_raw: str) -> str:
    """SQL reason of the relevance rules over sorted type lists."""
    some = lambda x, cond: f"len(list_filter({x}, lambda t: {cond})) > 0"
    neg, other = some(pooled, f"list_contains({negative}, t)"), some(pooled, f"NOT list_contains({negative}, t)")
    rneg, rother = some(types, neg_raw), some(types, f"NOT ({neg_raw})")
    return f"CASE WHEN {neg} AND {other} THEN 'negative_and_other' WHEN {other} THEN 'has_non_negative_label' WHEN {rneg} AND {rother} THEN 'negative_and_raw_other' WHEN {rother} THEN 'has_raw_label_only' ELSE 'no_non_negative_labels' END"
