"""Queries of the operators of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import shared_dir, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.langid import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.warc import read_warc, with_revisits, write_warc

    path = shared_dir(spark, "warc")
    write_warc(with_revisits(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path, keep_payload=False).where("status = 'record'")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), g AS (
  SELECT html, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY html
)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN g.original IS NULL OR g.original = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.original <> p.page_id THEN g.original END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    from loomtext.llm.licenses import COPYRIGHT, NOTICES, PUNCTUATION, SPELLINGS, TEXTS, VERSION, forms

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def lines(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        out = f"regexp_replace(regexp_replace({out}, {quoted(COPYRIGHT)}, chr(10), 'g'), {quoted(PUNCTUATION)}, ' ', 'g')"
        for found, same in SPELLINGS:
            out = f"replace({out}, {quoted(found)}, {quoted(same)})"
        return f"regexp_replace({out}, {quoted(VERSION)}, '\\1version \\2\\3', 'g')"

    def canonical(text: str) -> str:
        return f"trim(regexp_replace({lines(text)}, '[ \\n]+', ' ', 'g'))"

    texts = ", ".join(f"({quoted(i)}, {quoted(f)})" for i, t in TEXTS.items() for f in forms(t))
    notices = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, each in NOTICES.items() for t in each)
    return f"""
WITH known AS (SELECT {canonical("t")} AS c, min(i) AS license_id FROM (VALUES {texts}) v(i, t) GROUP BY 1),
notice AS (SELECT {canonical("t")} AS c, min(i) AS i FROM (VALUES {notices}) v(i, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines("text")} AS lines, {canonical("text")} AS c FROM documents),
found AS (
  SELECT r, string_agg(DISTINCT i, ',' ORDER BY i) AS notices
  FROM (SELECT r, trim(unnest(string_split(lines, chr(10)))) AS line FROM d) x JOIN notice ON notice.c = line GROUP BY r
)
SELECT doc_id, sha256(d.c) AS digest, license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON known.c = d.c LEFT JOIN found USING (r)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.mixing import mixed

    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.col("mix_topic").alias("topic"), "n_tokens", F.round("probability", 9).alias("probability"), "sampled")


def _op10_sql() -> str:
    from loomtext.llm.mixing import DIMENSIONS, FLATTEN, LIKE_NULL, NULL, RATE, ROUNDS, SEED, TOPICS

    def quoted(s: str) -> str:
        return "'" + s.replace("\n", "' || chr(10) || '") + "'"

    topic = " ".join(f"WHEN contains(coalesce(text, ''), {quoted(m)}) THEN '{t}'" for t, m in TOPICS)
    steps, last = [], "w0"
    for r in range(ROUNDS * len(DIMENSIONS)):
        d = DIMENSIONS[r % len(DIMENSIONS)]
        own = f"sum(weight) OVER (PARTITION BY {d})"
        steps.append(f"w{r + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {own} > 0 THEN weight * (target_{d} / {own}) ELSE 0.0 END AS weight) FROM {last})")
        last = f"w{r + 1}"
    targets = ", ".join(
        f"t_{d} AS (SELECT {d}, sum(n) OVER () * f / sum(f) OVER () AS target_{d} FROM (SELECT {d}, sum(tokens) AS n, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {FLATTEN}) ELSE 0.0 END AS f FROM cells GROUP BY {d}) x)"
        for d in DIMENSIONS
    )
    joins = " ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_replace(source, '{LIKE_NULL}', '(\\1'), '{NULL}') AS source, coalesce(regexp_replace(lang, '{LIKE_NULL}', '(\\1'), '{NULL}') AS lang, CASE {topic} ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_tokens
  FROM documents
),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY 1, 2, 3),
{targets},
w0 AS MATERIALIZED (SELECT cells.*, tokens AS weight, {", ".join(f"target_{d}" for d in DIMENSIONS)} FROM cells {joins}),
{", ".join(steps)},
r AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1.0 END AS ratio FROM {last}),
s AS (
  SELECT *, ({RATE} * sum(tokens) OVER () - coalesce(sum(tokens) OVER b, 0)) / nullif(sum(tokens * ratio) OVER () - coalesce(sum(tokens * ratio) OVER b, 0), 0) AS c
  FROM r WINDOW b AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
p AS (SELECT source, lang, topic, least(1.0, coalesce((SELECT arg_max(c, ratio) FROM s WHERE c * ratio <= 1), 1.0) * ratio) AS p FROM s)
SELECT doc_id, topic, n_tokens, round(p, 9) AS probability,
  coalesce(('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < p, false) AS sampled
FROM d JOIN p USING (source, lang, topic)
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), share=85)


def op11_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.balltree import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    from loomtext.llm.balltree import CENTROIDS, DIM, ROUNDS, SCALE

    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT r, arg_min(j, (v.q - 2 * list_inner_product(v.x, c.x) + c.q, j)) AS j, min(v.q - 2 * list_inner_product(v.x, c.x) + c.q) AS d FROM v, c{r} c GROUP BY r)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS x FROM (SELECT j, i, floor(sum(x[i]) / count(*)) AS m FROM a{r} JOIN v USING (r), range(1, {DIM + 1}) t(i) GROUP BY j, i) y GROUP BY j),"
                f"c{r + 1} AS MATERIALIZED (SELECT j, z.x, list_inner_product(z.x, z.x) AS q FROM (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j)) z)"
            )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, x, list_inner_product(x, x) AS q
  FROM (
    SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS x FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
  ) e
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x, q FROM (SELECT sha256('2:' || vec_id) AS h, x, q FROM v ORDER BY h LIMIT {CENTROIDS}) f),
{", ".join(steps)}
SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} c USING (j)
"""


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.lines import LineIndex

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark, shared_dir(spark, "lines"), docs.schema["doc_id"].dataType.simpleString()).insert(docs)
    out = index.dedupe(docs)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (
  SELECT r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d) x
),
s AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (owner <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN s USING (k) GROUP BY r
"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.llm.codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    from loomtext.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE

    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT r, p, arg_min(j, (v.q - 2 * list_inner_product(v.x, c.x) + c.q, j)) AS j, min(v.q - 2 * list_inner_product(v.x, c.x) + c.q) AS d FROM v JOIN c{r} c USING (p) GROUP BY r, p)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT p, j, list(m ORDER BY i) AS x FROM (SELECT p, j, i, floor(sum(x[i]) / count(*)) AS m FROM a{r} JOIN v USING (r, p), range(1, (SELECT max(len(x)) FROM v) + 1) t(i) GROUP BY p, j, i) y GROUP BY p, j),"
                f"c{r + 1} AS MATERIALIZED (SELECT p, j, z.x, list_inner_product(z.x, z.x) AS q FROM (SELECT c.p, c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, j)) z)"
            )
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
v AS MATERIALIZED (SELECT r, p, x, list_inner_product(x, x) AS q FROM (SELECT r, p, list_slice(y, p * len(y) // {PARTS} + 1, (p + 1) * len(y) // {PARTS}) AS x FROM e, range({PARTS}) t(p)) z),
f AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM e ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT p, j, x, q FROM f JOIN v USING (r)),
{", ".join(steps)},
g AS (SELECT r, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda e: e::BIGINT), ','), ',' ORDER BY p, j)) FROM c{ROUNDS}) AS codebooks_sha256
FROM g JOIN e USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_neighbours": op7_neighbours,
    "op8_licenses": op8_licenses,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
    "op11_balltree": op11_balltree,
    "op12_lines": op12_lines,
    "op13_codes": op13_codes,
}
ORACLES: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op8_licenses": _op8_sql(),
    "op10_mixing": _op10_sql(),
    "op11_balltree": _op11_sql(),
    "op12_lines": OP12_SQL,
    "op13_codes": _op13_sql(),
}
