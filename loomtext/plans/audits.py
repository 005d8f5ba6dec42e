"""Queries that check, name and render rows of the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext import fixtures as fx
from loomtext.functions import labels as lb
from loomtext.functions import text as tx
from loomtext.operators import claims as cl
from loomtext.operators import lexicon as lx
from loomtext.operators import matrix as mx
from loomtext.operators import metrics as me
from loomtext.operators import reports as rp
from loomtext.operators import spans as sp
from loomtext.operators import splits as st
from loomtext.operators import summary as sm
from loomtext.operators import variants as va
from loomtext.operators import windows as wn
from loomtext.plans.annotation import _map
from loomtext.plans.augmentation import _ATTR, _BARRED, _PERMITTED, _RAW, _SPECS, _SPLIT, _STRA, SEED, _assigned, _class_sql, _license_sql, _phrases, _scrambled_sql
from loomtext.plans.evaluation import _CHECKED_ERRORS, _KEYS, _ROWS, _faulty_runs, _orders
from loomtext.plans.registry import LAB, RUNS, SENT, SPANS, SPECIES, classify_sql, query
from loomtext.shared import materialise, shared_dir
from loomtext.sources import runs
from loomtext.sources.attribution import parse_attribution

# ---------------------------------------------------------------- example sets and claims

_MOST = 5
_CATEGORIES, _FLAGS, _PRIORITIES = ("F", "O", "X"), ("A", "Z"), ("1-URGENT", "9-NONE")


def _absent(kind: str, values: tuple[str, ...], seen: str) -> str:
    return f"SELECT 'missing_required_{kind}:' || v AS error FROM (VALUES {', '.join(f'({v!r})' for v in values)}) x(v) WHERE v NOT IN ({seen})"


@query(f"""WITH {_ROWS}, n AS (SELECT l_orderkey, count(*) AS n, list(label ORDER BY l_linenumber, t, label) AS l FROM lb GROUP BY 1),
c AS (SELECT l_orderkey, n, CASE WHEN l_orderkey % 50 = 0 THEN l[:n - 1] ELSE l END AS l FROM n), ty AS (SELECT l_orderkey, unnest(l) AS label FROM c),
sh AS (SELECT 'token_label_length_mismatch:' || l_orderkey AS error FROM c WHERE len(l) <> n UNION ALL SELECT * FROM (SELECT 'max_tokens_exceeded:' || max(n) || '>{_MOST}' AS error FROM c HAVING max(n) > {_MOST})),
me AS (SELECT 'example_meta_length_mismatch:' || a || '!=' || b AS error FROM (SELECT (SELECT count(*) FROM c) AS a, (SELECT count(*) FROM orders) AS b) x WHERE a <> b)
SELECT 'with_meta' AS name, error FROM (SELECT * FROM sh UNION ALL SELECT * FROM me UNION ALL {_absent("category", _CATEGORIES, "SELECT o_orderstatus FROM orders")} UNION ALL {_absent("raw_type", _PRIORITIES, "SELECT o_orderpriority FROM orders")}) y
UNION ALL SELECT 'labels_only', error FROM (SELECT * FROM sh UNION ALL {_absent("category", ("O-only",), "SELECT 'O-only' FROM c WHERE len(list_filter(l, lambda x: x <> 'O')) = 0")} UNION ALL {_absent("raw_type", _FLAGS, "SELECT substr(label, 3) FROM ty")}) z""")
def validate_sets(spark, sf_dir):
    """A2: failed checks of a set made of all orders, with metadata and from labels alone."""
    ex = _orders(spark, sf_dir)
    cut = F.when(F.col("example_id").cast("bigint") % 50 == 0, F.slice("labels", 1, F.size("labels") - 1)).otherwise(F.col("labels"))
    ex, none = ex.withColumn("labels", cut), F.lit(None)
    meta = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("category"), none.cast("string").alias("reason"), none.cast("boolean").alias("forced_relevant"),
        F.array("o_orderpriority").alias("types_raw"), none.cast("array<string>").alias("types_pooled"),
    )
    a = sm.validate(ex, meta, max_tokens=_MOST, required_categories=_CATEGORIES, required_raw_types=_PRIORITIES)
    b = sm.validate(ex, max_tokens=_MOST, required_categories=("O-only",), required_raw_types=_FLAGS)
    return a.select(F.lit("with_meta").alias("name"), "error").unionByName(b.select(F.lit("labels_only").alias("name"), "error"))


@query("""WITH p AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.set' AS path FROM documents)
SELECT * FROM (SELECT path, CASE WHEN regexp_full_match(path, 'src0/.*\\.set') THEN 'first' WHEN regexp_full_match(path, 'src[^0-3]/.*') THEN 'rest' WHEN regexp_full_match(path, '.*/doc_.[02468]\\.set') THEN 'even' END AS rule FROM p) x""")
def qa_rules(spark, sf_dir):
    """A3: the first rule whose glob matches the path of a document; a star crosses slashes."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".set"))
    rules = [(0, "first", "src0/*.set"), (1, "rest", "src[!0-3]/*"), (2, "even", "*/doc_?[02468].set")]
    return sm.first_rule(fx.table(spark, sf_dir, "documents").select(path.alias("path")), spark.createDataFrame(rules, "ord int, name string, pattern string"))


@query(f"""WITH {_SPLIT}, men AS (SELECT doc_id, lang AS context, unnest(regexp_extract_all(text, '{SPECIES}')) AS value FROM documents),
cl AS (SELECT DISTINCT context, value FROM men WHERE doc_id % 2 = 0), ac AS (SELECT DISTINCT context, value FROM men WHERE doc_id % 3 < 2),
cal AS (SELECT article_id, CASE WHEN split = 'train' AND article_id % 10 = 0 THEN 'eval' ELSE split END AS split FROM asg
  WHERE NOT (split = 'test' AND article_id % 7 = 0) AND NOT (split = 'train' AND article_id % 11 = 0) AND NOT (split = 'eval' AND article_id % 5 <> 0)),
v AS (SELECT 'exclusion' AS c, context, value, 0 AS side FROM (SELECT * FROM cl EXCEPT SELECT * FROM ac) x UNION ALL SELECT 'exclusion', context, value, 1 FROM (SELECT * FROM ac EXCEPT SELECT * FROM cl) x
  UNION ALL SELECT 'calibration_test', 's/test', article_id::VARCHAR, 0 FROM asg WHERE split = 'test' AND article_id NOT IN (SELECT article_id FROM cal WHERE split = 'test')
  UNION ALL SELECT 'calibration_train', 's/train', article_id::VARCHAR, 0 FROM asg WHERE split = 'train' AND article_id NOT IN (SELECT article_id FROM cal WHERE split <> 'test')
  UNION ALL SELECT 'calibration_train', 's/train', article_id::VARCHAR, 1 FROM cal WHERE split <> 'test' AND article_id NOT IN (SELECT article_id FROM asg WHERE split = 'train'))
SELECT c AS "check", context, count(*) || CASE side WHEN 0 THEN ' values claimed only' ELSE ' values missing' END AS message FROM v GROUP BY c, context, side""")
def claims_sets(spark, sf_dir):
    """Names that an exclusion list of a language lacks or has too many; a split against its calibration split."""
    found = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("context"), F.explode(tx.mentions(F.col("text"))).alias("value"))
    main = _assigned(spark, sf_dir).select(F.lit("s").alias("lineage"), "split", "article_id")
    a, split = F.col("article_id"), F.col("split")
    kept = main.where(~((split == "test") & (a % 7 == 0)) & ~((split == "train") & (a % 11 == 0)) & ~((split == "eval") & (a % 5 != 0)))
    calibration = kept.withColumn("split", F.when((split == "train") & (a % 10 == 0), "eval").otherwise(split))
    return cl.set_differences(found.where("doc_id % 2 = 0"), found.where("doc_id % 3 < 2"), "exclusion").unionByName(cl.calibration_relation(main, calibration))


@query(_CHECKED_ERRORS)
def run_validation(spark, sf_dir):
    """Failed checks of the runs of the table, some of which have faults."""
    specs, metrics, states = _faulty_runs(spark, sf_dir)
    rows = metrics.select("*", "m.*").drop("m").withColumn("metrics_sha256", F.md5(F.concat("run", F.lit("m")).cast("binary")))
    out = cl.validate_runs(specs, states, rows, eval_sets=("augmented_exclusive", "unaugmented"), epsilon=0.2)
    return out.withColumn("errors", F.array_join("errors", ","))


@query("""WITH a AS (SELECT doc_id::VARCHAR AS key, md5(text) AS value FROM documents), b AS (SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 8 = 0 THEN lang ELSE md5(text) END AS value FROM documents WHERE doc_id % 9 <> 0),
h AS (SELECT page_id::VARCHAR AS key, sha256(coalesce(html, '')) AS h FROM pages), f AS (SELECT page_id::VARCHAR AS key, CASE WHEN page_id % 7 = 0 THEN sha256(coalesce(html, '') || ' ') ELSE sha256(coalesce(html, '')) END AS h FROM pages WHERE page_id % 10 <> 3)
SELECT 'signature' AS kind, coalesce(a.key, b.key) AS key, NULL AS status FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value
UNION ALL SELECT 'asset', h.key, CASE WHEN f.h IS NULL THEN 'missing' ELSE 'differs' END FROM h LEFT JOIN f ON f.key = h.key WHERE h.h IS DISTINCT FROM f.h""")
def signature_and_assets(spark, sf_dir):
    """Signatures of documents compared key by key; hashes of pages against a manifest."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.md5(F.col("text").cast("binary")).alias("value"), "lang")
    other = d.where("doc_id % 9 <> 0").withColumn("value", F.when(F.col("doc_id") % 8 == 0, F.col("lang")).otherwise(F.col("value")))
    s = cl.signature_mismatches(d.select("key", "value"), other.select("key", "value"))
    html = F.coalesce("html", F.lit(""))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    p = fx.table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("asset"), html.alias("html"))
    found = p.where("page_id % 10 <> 3").select("asset", sha(F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))).alias("sha256"))
    a = cl.manifest_mismatches(p.select("asset", sha(F.col("html")).alias("sha256")), found)
    return s.select(F.lit("signature").alias("kind"), "key", F.lit(None).cast("string").alias("status")).unionByName(a.select(F.lit("asset").alias("kind"), F.col("asset").alias("key"), "status"))


@query("""WITH j AS (SELECT DISTINCT event_type AS task, 'set' || user_id AS "set", CASE WHEN event_id % 2 = 0 THEN 'all' ELSE 'none' END AS train_variant, 'e' || (user_id % 3) AS e, user_id FROM events),
n AS (SELECT task, "set", train_variant, task || '/' || "set" || '/train/' || train_variant || '.set' AS path FROM j UNION SELECT task, "set", train_variant, task || '/test/' || e || '.set' FROM j UNION SELECT task, "set", train_variant, task || '/test/u.set' FROM j),
f AS (SELECT event_type || '/set' || user_id || '/train/' || CASE WHEN event_id % 2 = 0 THEN 'all' ELSE 'none' END || '.set' AS path FROM events WHERE user_id % 5 > 0 OR event_id % 2 = 0
  UNION SELECT event_type || '/test/u.set' FROM events UNION SELECT 'click/test/e0.set')
SELECT task, "set", train_variant, path FROM n WHERE path NOT IN (SELECT path FROM f)""")
def missing_artifacts(spark, sf_dir):
    """Files that the jobs of the events need and a listing lacks."""
    e, variant = fx.table(spark, sf_dir, "events"), F.when(F.col("event_id") % 2 == 0, "all").otherwise("none")
    user = F.col("user_id").cast("string")
    sets = F.array(F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string")), F.lit("u"))
    jobs = e.select(F.col("event_type").alias("task"), F.concat(F.lit("set"), user).alias("set"), variant.alias("train_variant"), F.lit("test").alias("eval_split"), sets.alias("eval_sets"))
    train = e.where("user_id % 5 > 0 or event_id % 2 = 0").select(F.concat_ws("/", "event_type", F.concat(F.lit("set"), user), F.lit("train"), F.concat(variant, F.lit(".set"))).alias("path"))
    tests = e.select(F.concat("event_type", F.lit("/test/u.set")).alias("path"))
    files = train.unionByName(tests).unionByName(e.limit(1).select(F.lit("click/test/e0.set").alias("path"))).distinct()
    return cl.missing_artifacts(jobs, files)


# ---------------------------------------------------------------- licences

_RAW_OF = f"""{_ATTR}, raws AS (SELECT article_id, coalesce(license, list_extract([{", ".join(repr(x) for x in _RAW)}], (article_id % {len(_RAW)})::INT + 1)) AS raw FROM att)"""


def _raws(spark, sf_dir):
    """(article_id, raw): the licence line of a document, or one of the usual forms."""
    line = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike("[Ll]icen[sc]e")), F.lit(0))
    forms = F.array(*map(F.lit, _RAW))
    return fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.coalesce(line, F.element_at(forms, (F.col("doc_id") % len(_RAW)).cast("int") + 1)).alias("raw"))


@query(f"WITH {_RAW_OF} SELECT article_id, {_license_sql('raw')} AS license_id FROM raws")
def licence_normalise(spark, sf_dir):
    """L4: licence ids of the statements in documents."""
    return _raws(spark, sf_dir).select("article_id", tx.license_id(F.col("raw")).alias("license_id"))


@query(f"""WITH {_RAW_OF}, u AS (SELECT article_id, upper(trim({_license_sql('raw')})) AS lid FROM raws)
SELECT article_id, lid LIKE '%-ND%' OR ({_PERMITTED} AND lid NOT IN ('MIT', 'CC0-1.0')) AS attribution_required, {_PERMITTED} AS redistribution_allowed, {_PERMITTED} AS derivative_allowed,
  CASE WHEN {_BARRED} THEN 'disallowed' WHEN {_PERMITTED} THEN 'allowed' ELSE 'unknown' END AS policy_status FROM u""")
def licence_flags(spark, sf_dir):
    """Policy flags of the licence ids of documents."""
    return _raws(spark, sf_dir).select("article_id", tx.license_flags(tx.license_id(F.col("raw"))).alias("f")).select("article_id", "f.*")


@query(f"""WITH {_RAW_OF}, s AS (SELECT article_id, md5(article_id::VARCHAR) AS checksum, CASE article_id % 4 WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'mit' ELSE raw END AS raw FROM raws WHERE raw <> '' OR article_id % 4 > 1)
SELECT article_id::VARCHAR AS path, checksum, {_license_sql('raw')} AS license_id FROM s""")
def attribution_parse(spark, sf_dir):
    """IO18: an attribution text for each document: a block in either order, a table line, a block cut by a blank line, a statement that a later one overrules."""
    r = _raws(spark, sf_dir).withColumn("h", F.md5(F.col("article_id").cast("string").cast("binary"))).where("raw <> '' or article_id % 4 > 1")
    lines = (
        F.when(F.col("article_id") % 4 == 0, F.concat(F.when(F.col("article_id") % 8 == 0, F.concat(F.lit("checksum: "), "h", F.lit("\nlicence: "), "raw")).otherwise(F.concat(F.lit("licence: "), "raw", F.lit("\r\nHash = "), "h"))))
        .when(F.col("article_id") % 4 == 1, F.concat("h", F.lit("\t"), "raw"))
        .when(F.col("article_id") % 4 == 2, F.concat(F.lit("sha256: "), "h", F.lit("\n\nlicense: "), "raw"))
        .otherwise(F.concat(F.lit("licence: "), "raw", F.lit("\nchecksum: "), "h", F.lit("\n\n"), "h", F.lit(" ; mit")))
    )
    texts = r.select(F.col("article_id").cast("string").alias("path"), lines.alias("value"))
    return parse_attribution(texts).select("path", "checksum", "license_id")


# ---------------------------------------------------------------- splits, jobs, names

_PARTS = ", ".join(f"('{s.name}', {i}, {s.fraction}::DOUBLE)" for i, s in enumerate(_SPECS))


@query(f"""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), fl AS (SELECT *, floor(n * f) AS k, n * f - floor(n * f) AS rem FROM c, (VALUES {_PARTS}) v(split, ord, f))
SELECT source, lang, split, (k + CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY rem DESC, ord) <= n - sum(k) OVER (PARTITION BY source, lang) THEN 1 ELSE 0 END)::BIGINT AS n_articles FROM fl""")
def split_apportion(spark, sf_dir):
    """Sizes of the splits of each source and language by largest remainders."""
    n = fx.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return st.apportioned(n, _SPECS, "source", "lang")


@query("""WITH m AS (SELECT source AS model, lang AS tokenizer, max(n_chars)::BIGINT AS max_length FROM documents GROUP BY 1, 2)
SELECT t AS task, s AS "set", model, tokenizer, max_length, d AS seed, v AS train_variant, 'test' AS eval_split, 'a,u' AS eval_sets, 'runs/' || model || '/' || s || '/seed_' || d || '/' || v AS run_dir
FROM m, (VALUES ('t1'), ('t2')) a(t), (VALUES ('set1'), ('set2')) b(s), (VALUES (1), (2), (3)) e(d), (VALUES ('none'), ('all')) f(v)""")
def job_matrix(spark, sf_dir):
    """Cross product of tasks, sets, seeds and variants with a model for each source and language."""
    models = fx.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("model"), F.col("lang").alias("tokenizer")).agg(F.max("n_chars").cast("bigint").alias("max_length"))
    j = mx.run_dir(mx.job_matrix(["t1", "t2"], ["set1", "set2"], models, [1, 2, 3], ["none", "all"], eval_sets=["a", "u"]))
    return j.withColumn("eval_sets", F.array_join("eval_sets", ","))


@query("""WITH a AS (SELECT l_orderkey AS id, max(l_linenumber)::VARCHAR AS lr FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS id, min(l_linenumber)::VARCHAR AS lr, count(*)::VARCHAR AS epochs FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderkey AS job_id, n.name, CASE n.name WHEN 'lr' THEN coalesce(a.lr, b.lr, '2e-5') WHEN 'epochs' THEN coalesce(b.epochs, '8') ELSE '16' END AS value
FROM orders LEFT JOIN a ON a.id = o_orderkey LEFT JOIN b ON b.id = o_orderkey, (VALUES ('lr'), ('epochs'), ('batch')) n(name)""")
def hparam_precedence(spark, sf_dir):
    """For each order as a job, the most specific level that states a parameter wins."""
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_returnflag").join(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")), "job_id", "left_semi")
    level = lambda df, name, value: df.groupBy("job_id").agg(value.cast("string").alias("value")).select("job_id", F.lit(name).alias("name"), "value")
    own = level(rows.where("l_returnflag = 'R'"), "lr", F.max("l_linenumber"))
    wide = rows.where("l_returnflag <> 'N'")
    shared = level(wide, "lr", F.min("l_linenumber")).unionByName(level(wide, "epochs", F.count("*")))
    jobs = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    return mx.resolve_hparams(jobs, [own, shared], {"lr": "2e-5", "epochs": "8", "batch": "16"})


@query("""WITH v AS (SELECT DISTINCT source || '_' || lang || '_' || (doc_id % 100) AS train_variant FROM documents)
SELECT * FROM (SELECT train_variant, CASE WHEN regexp_full_match(train_variant, 'src._en_.*') THEN 'src?_en_*' WHEN regexp_full_match(train_variant, 'src1.*') THEN 'src1*' WHEN regexp_full_match(train_variant, '.*_7') THEN '*_7' ELSE '*' END AS pattern,
  CASE WHEN regexp_full_match(train_variant, 'src._en_.*') THEN 'b' WHEN regexp_full_match(train_variant, 'src1.*') THEN 'c' WHEN regexp_full_match(train_variant, '.*_7') THEN 'd' ELSE 'a' END AS params FROM v) x""")
def variant_pattern(spark, sf_dir):
    """The longest glob that matches the variant of a job wins."""
    jobs = fx.table(spark, sf_dir, "documents").select(F.concat_ws("_", "source", "lang", (F.col("doc_id") % 100).cast("string")).alias("train_variant"))
    return mx.variant_pattern(jobs, spark.createDataFrame([("*", "a"), ("src?_en_*", "b"), ("src1*", "c"), ("*_7", "d")], "pattern string, params string"))


@query("""SELECT page_id, CASE WHEN s IS NULL OR s = '' THEN 'item' ELSE s END AS slug, left(sha1(url), 8) AS profile, xor(42::BIGINT, ('0x' || left(sha1(url), 8))::BIGINT) AS seed
FROM (SELECT page_id, url, left(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS s FROM pages) x""")
def identifiers(spark, sf_dir):
    """Slugs, stable seeds and short labels of addresses."""
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"), tx.profile_label(F.col("url")).alias("profile"), tx.stable_seed(42, F.col("url")).alias("seed"))


# ---------------------------------------------------------------- metrics


@query(f"""WITH {RUNS} SELECT ord, metric, round(CASE metric WHEN 'loss' THEN loss WHEN 'f1' THEN f1 * 100 WHEN 'precision' THEN precision * 100 ELSE recall * 100 END, 6) AS value
FROM runs, (VALUES ('precision'), ('recall'), ('f1'), ('loss')) v(metric)""")
def metric_scale(spark, sf_dir):
    """Percent for all metrics of runs but the loss."""
    r = fx.run_metrics(spark, sf_dir)
    long = r.select("ord", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in rp.METRICS))).alias("x")).select("ord", "x.*")
    return long.select("ord", "metric", F.round(tx.percent(F.col("metric"), F.col("value")), 6).alias("value"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN round_even((event_id % 7) + 0.5::DOUBLE, 0) ELSE event_id % 9 END AS e FROM events)
SELECT event_id, CASE WHEN e > 0 THEN e::INT END AS epoch, event_id % 4 > 1 AS kept FROM e""")
def epoch_parse(spark, sf_dir):
    """Epochs of events rounded half to even, rows whose metrics are numbers."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "x").when(i % 5 == 1, F.concat((i % 7).cast("string"), F.lit(".5"))).otherwise((i % 9).cast("string"))
    metric = F.when(i % 4 == 0, "nan").when(i % 4 == 1, "bad").otherwise(F.col("value").cast("string"))
    d = fx.table(spark, sf_dir, "events").select("event_id", text.alias("e"), *(metric.alias(c) for c in rp.METRICS))
    kept = rp.lenient_metrics(d).select("event_id", F.lit(True).alias("kept"))
    return d.select("event_id", rp.parse_epoch(F.col("e")).alias("epoch")).join(kept, "event_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


_NAMES = ("O", "B-A", "B-R")


@query("""WITH s AS (SELECT CASE l_returnflag WHEN 'N' THEN 'O' ELSE 'B-' || l_returnflag END AS y_true, l_discount AS a, l_tax AS b, l_quantity / 1000 AS c FROM lineitem WHERE l_linenumber % 4 > 0)
SELECT y_true, CASE WHEN a >= b AND a >= c THEN 'O' WHEN b >= c THEN 'B-A' ELSE 'B-R' END AS y_pred, count(*) AS n FROM s GROUP BY 1, 2""")
def argmax_labels(spark, sf_dir):
    """Labels of the highest of three scores of each line of an order, ignored positions skipped, the first of ties."""
    own = F.when(F.col("l_linenumber") % 4 == 0, lb.IGNORE).when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    line = F.struct("l_linenumber", F.array("l_discount", "l_tax", F.col("l_quantity") / 1000).alias("s"), own.alias("y"))
    d = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("r"))
    scores, truth = F.transform("r", lambda r: r["s"]), F.transform("r", lambda r: r["y"])
    pairs = d.select(F.explode(me.argmax_labels(scores, truth, F.array(*map(F.lit, _NAMES)))).alias("x"))
    return pairs.groupBy("x.y_true", "x.y_pred").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- rows for models and readers

_LABEL_IDS = {"O": 0, "B-SPEC": 1, "I-SPEC": 2, "B-STRA": 3, "I-STRA": 4}


@query(f"""WITH {LAB}, p AS (SELECT article_id, string_agg(CASE label {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABEL_IDS.items())} END || repeat(',-100', ((length(w) + 3) // 4 - 1)::INT), ',' ORDER BY pos) AS x, sum((length(w) + 3) // 4)::BIGINT AS n FROM lab GROUP BY 1)
SELECT doc_id AS article_id, coalesce(n, 0) + 2 AS n_subwords, md5('-100,' || coalesce(x || ',', '') || '-100') AS labels FROM documents LEFT JOIN p ON p.article_id = doc_id""")
def subword_alignment(spark, sf_dir):
    """Labels of documents on subwords, here pieces of four characters between two specials; the label ids as a digest."""
    special = F.array(F.lit(None).cast("int"))
    pieces = F.flatten(F.transform("tokens", lambda t, i: F.array_repeat(i, F.ceil(F.length(t) / 4).cast("int"))))
    ids = F.create_map(*(F.lit(x) for kv in _LABEL_IDS.items() for x in kv))
    own = fx.labelled(spark, sf_dir).select("article_id", "labels", F.concat(special, pieces, special).alias("w"))
    aligned = F.transform(lb.align_subwords(F.col("w"), F.col("labels"), ids), lambda v: v.cast("string"))
    return own.select("article_id", F.size("w").cast("bigint").alias("n_subwords"), F.md5(F.array_join(aligned, ",").cast("binary")).alias("labels"))


@query("""WITH r AS (SELECT l_orderkey AS id, l_orderkey // 8 AS batch, list(l_partkey ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch) AS most FROM r)
SELECT id, array_to_string(x, ',') || repeat(',0', (most - len(x))::INT) AS ids FROM m""")
def padding(spark, sf_dir):
    """Rows of part keys filled up to the longest of their batch of orders."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    d = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(line, lambda r: r["l_partkey"]).alias("ids")).withColumn("batch", F.floor(F.col("id") / 8))
    return mx.padded(d, "ids", 0, "batch").select("id", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


_PIECE = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\x0b]"
_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PIECE}') AS x FROM documents), p AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM t),
g AS (SELECT *, CASE WHEN pos = 1 OR w IN ({_quoted([*lb._NONE_BEFORE, *lb._JOINERS])}) OR w LIKE '''%' OR lag(w) OVER (PARTITION BY doc_id ORDER BY pos) IN ({_quoted([*lb._NONE_AFTER, *lb._JOINERS])}) THEN '' ELSE ' ' END AS gap FROM p),
s AS (SELECT doc_id, string_agg(gap || w, '' ORDER BY pos) AS a, string_agg(gap || w || CASE WHEN regexp_full_match(w, '[0-9]+') THEN ' (B-NUM)' ELSE '' END, '' ORDER BY pos) AS b FROM g GROUP BY 1)
SELECT doc_id, md5(coalesce(a, '')) AS plain, md5(coalesce(b, '')) AS inline FROM documents LEFT JOIN s USING (doc_id)""")
def rendering(spark, sf_dir):
    """Readable texts of documents with and without labels of their numbers, as digests."""
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_PIECE), F.lit(0))
    d = fx.table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"))
    d = d.withColumn("labels", F.transform("tokens", lambda t: F.when(t.rlike("^[0-9]+$"), "B-NUM").otherwise("O")))
    digest = lambda x: F.md5(x.cast("binary"))
    return d.select("doc_id", digest(lb.spaced(F.col("tokens"))).alias("plain"), digest(lb.inline_labels(F.col("tokens"), F.col("labels"))).alias("inline"))


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 40 AS s, l_partkey % 40 + l_quantity::BIGINT AS e, l_partkey % 40 + least(l_suppkey % 50, l_quantity::BIGINT) AS focus FROM lineitem),
u AS (SELECT DISTINCT s, e, focus FROM b),
w AS (SELECT s AS s0, e AS e0, s, e, focus FROM u UNION ALL SELECT s0, e0, CASE WHEN e - focus > focus - s THEN s ELSE s + 1 END, CASE WHEN e - focus > focus - s THEN e - 1 ELSE e END, focus FROM w WHERE s < e AND e - s + 1 > 6)
SELECT b.id, b.line, w.s::INT AS s, w.e::INT AS e FROM w JOIN b ON b.s = w.s0 AND b.e = w.e0 AND b.focus = w.focus WHERE w.e - w.s + 1 <= 6""")
def window_fit(spark, sf_dir):
    """Windows made of lines of orders, trimmed around their focus in closed form."""
    start, width = F.col("l_partkey") % 40, F.col("l_quantity").cast("bigint")
    focus = start + F.least(F.col("l_suppkey") % 50, width)
    ints = [c.cast("int").alias(n) for c, n in ((start, "s"), (start + width, "e"), (focus, "focus"))]
    d = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), *ints)
    return d.select("id", "line", wn.fitted(F.col("s"), F.col("e"), F.col("focus"), 6).alias("w")).select("id", "line", "w.s", "w.e")


# ---------------------------------------------------------------- sentences, labels, phrases


_SMALL = "abcdefghijklmnopqrstuvwxyz"


@query(rf"""WITH art AS (SELECT conv_id || '-' || turn || '-' || role AS article_id, list_filter(string_split_regex(coalesce(upper(text), ''), '\s+'), lambda x: x <> '') AS tokens FROM conversations),
tok AS (SELECT article_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS pos FROM art), {SENT} SELECT article_id, s, e FROM sent""")
def sentence_bounds_edge(spark, sf_dir):
    """Sentences of the turns of conversations in capitals."""
    turns = fx.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn", "role").alias("article_id"), tx.words(F.translate("text", _SMALL, _SMALL.upper())).alias("tokens"))
    return turns.select("article_id", F.explode(wn.sentences(F.col("tokens"))).alias("x")).select("article_id", "x.s", "x.e")


_OVER = f"""{SPANS}, more AS (SELECT * FROM spans UNION ALL SELECT article_id, 2000000000 + start, 'STRA/over', 'STRA', start - 1, 2, start + 1 FROM spans WHERE label4 = 'SPEC' AND start > 0)""" + LAB[len(SPANS):].replace("FROM spans", "FROM more")


@query(f"""WITH {_OVER}, x AS (SELECT 'plain' AS name, article_id, pos, label FROM lab UNION ALL SELECT 'empty map', article_id, pos, 'O' FROM lab
  UNION ALL SELECT 'mapped', article_id, pos, coalesce(org.label, 'O') FROM lab LEFT JOIN (SELECT article_id, pos, arg_max(CASE WHEN pos = start THEN 'B-ORG' ELSE 'I-ORG' END, ord) AS label FROM cell WHERE label4 = 'SPEC' GROUP BY 1, 2) org USING (article_id, pos))
SELECT name, article_id, string_agg(label, ' ' ORDER BY pos) AS labels FROM x GROUP BY 1, 2""")
def bio_labels_overlap(spark, sf_dir):
    """Later spans overwrite those that they overlap, here one over the start of each name; spans whose type isn't mapped overwrite nothing."""
    own, a = fx.spans(spark, sf_dir), fx.articles(spark, sf_dir).where(F.size("tokens") > 0)
    over = own.where("label4 = 'SPEC' and start > 0").select(
        "article_id", (F.lit(2_000_000_000) + F.col("start")).cast("bigint").alias("ord"), F.lit("STRA/over").alias("source_key"), F.lit("STRA").alias("label4"),
        (F.col("start") - 1).alias("start"), F.lit(2).alias("length"), (F.col("start") + 1).alias("end_excl"),
    )
    both, out = materialise(own.unionByName(over), "spans"), None
    for name, mapping in (("plain", None), ("empty map", {}), ("mapped", {"SPEC": "ORG"})):
        r = sp.bio_labels(a, both, mapping).select(F.lit(name).alias("name"), "article_id", F.array_join("labels", " ").alias("labels"))
        out = r if out is None else out.unionByName(r)
    return out


_TYPE_OF = "CASE WHEN l_returnflag = 'A' THEN 'NEG' WHEN l_returnflag = 'R' THEN 'POS' WHEN l_linenumber = 5 THEN '' WHEN l_linenumber = 6 THEN 'RAW' END"
_KNOWN_TYPES = "['NEG', 'POS']"


@query(f"""WITH t AS (SELECT l_orderkey, list_sort(list_distinct(list_filter(list({_TYPE_OF}), lambda t: t IS NOT NULL))) AS ts FROM lineitem GROUP BY 1),
p AS (SELECT *, list_filter(ts, lambda t: list_contains({_KNOWN_TYPES}, t)) AS ps FROM t),
r AS (SELECT l_orderkey AS id, ts, ps, {classify_sql("ts", "ps", "['NEG']", "t = 'NEG'")} AS reason FROM p)
SELECT id, reason, CASE WHEN reason = 'no_non_negative_labels' THEN 'irrelevant' ELSE 'relevant' END AS category, reason LIKE 'negative_and%' AS forced_relevant FROM r""")
def classify_edge(spark, sf_dir):
    """Relevance of orders with negative, positive, unmapped and empty types; each of the five reasons."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    label = F.when(flag == "A", "B-NEG").when(flag == "R", "I-POS").when(line == 5, "B-").when(line == 6, "B-RAW").otherwise("O")
    d = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(label).alias("labels"))
    c = lb.classify(F.col("labels"), _map({"NEG": "NEG", "POS": "POS"}), F.array(F.lit("NEG")))
    return d.select("id", c.alias("c")).select("id", "c.category", "c.forced_relevant", "c.reason")


@query(f"""WITH men AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SPECIES}')) AS name FROM documents), own AS (SELECT doc_id, name FROM men WHERE name LIKE '% %'),
f AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN left(name, 1) || '. ' || split_part(name, ' ', 2) ELSE name END AS phrase FROM own WHERE doc_id % 5 > 0),
k AS (SELECT left(phrase, 1) AS initial, split_part(phrase, ' ', 2) AS epithet, phrase, split_part(phrase, ' ', 1) LIKE '%.' AS short FROM f)
SELECT initial, epithet, coalesce(string_agg(phrase, ',' ORDER BY phrase) FILTER (NOT short), '') AS full_forms, coalesce(string_agg(phrase, ',' ORDER BY phrase) FILTER (short), '') AS abbreviations,
  bool_and(short) AS orphan_abbreviation, coalesce(min(phrase) FILTER (NOT short), min(phrase)) AS representative FROM k GROUP BY 1, 2""")
def lexicon_key_index_edge(spark, sf_dir):
    """L1 L3: keys of names in documents, some of which are abbreviated and some in small letters, which isn't a name."""
    i = F.col("doc_id")
    m = fx.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.mentions(F.col("text"))).alias("pos", "name")).where("name like '% %'")
    said = F.when(i % 5 == 0, F.lower("name")).when(i % 3 == 0, tx.abbreviation(F.col("name"))).otherwise(F.col("name"))
    m = m.select(F.concat_ws(":", "doc_id", "pos").alias("article_id"), F.split(said, " ").alias("tokens"))
    spans = m.select("article_id", F.lit("SPEC").alias("label4"), F.lit(0).alias("start"), F.size("tokens").alias("length"))
    k = lx.lexicon_keys(lx.extract_lexicon(m, spans))
    return k.select("initial", "epithet", F.array_join("full_forms", ",").alias("full_forms"), F.array_join("abbreviations", ",").alias("abbreviations"), "orphan_abbreviation", "representative")


_SWAPS = {"the": "and", "and": "the", "th": "$1", ".": "; ", "a.": "(q)", "\\": "/"}


@query("""WITH kv AS (SELECT map(['the', 'and', 'th', '.', 'a.', '\\'], ['and', 'the', '$1', '; ', '(q)', '/']) AS m),
s AS (SELECT doc_id, string_split(regexp_replace(text, '(and|the|a\\.|th|\\.|\\\\)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents)
SELECT doc_id, array_to_string(list_transform(x, lambda q, i: CASE WHEN i % 2 = 0 THEN m[q] ELSE q END), '') AS out FROM s, kv""")
def replace_one_pass(spark, sf_dir):
    """Words and marks of documents swapped in one pass: no cascades, longest key first, keys and values with special characters."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.replace_all(F.col("text"), _map(_SWAPS)).alias("out"))


@query(f"""WITH {_STRA}, rv AS (SELECT DISTINCT w.w FROM w JOIN documents d USING (doc_id) WHERE d.lang = 'en'), tr AS (SELECT doc_id, w AS src, a.a AS attempt FROM w, range({va.TRIES}) a(a)),
made AS (SELECT doc_id, attempt, src, {_scrambled_sql("src", *_class_sql("doc_id::VARCHAR, attempt::VARCHAR"))} AS dst FROM tr),
ok AS (SELECT doc_id, attempt, string_agg(src || '>' || dst, ' ' ORDER BY length(src) DESC, src) AS pairs FROM made GROUP BY 1, 2 HAVING count(*) FILTER (dst IN (SELECT w FROM rv)) = 0),
best AS (SELECT doc_id, arg_min(pairs, attempt) AS pairs FROM ok GROUP BY 1)
SELECT d.doc_id, best.pairs IS NULL AND d.doc_id IN (SELECT doc_id FROM w) AS exhausted, coalesce(best.pairs, '') AS pairs FROM documents d LEFT JOIN best USING (doc_id)""")
def scramble_reserved(spark, sf_dir):
    """Identifiers of documents scrambled to forms that no English document has; where every permutation hits one, none."""
    own = _phrases(spark, sf_dir)
    reserved = own.join(fx.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select(F.explode("phrases").alias("phrase"))
    r = va.scramble(own, SEED, reserved=reserved, id_col="doc_id")
    return r.select("doc_id", "exhausted", F.array_join(F.transform("pairs", lambda p: F.concat(p["src"], F.lit(">"), p["dst"])), " ").alias("pairs"))


@query(f"""WITH {_STRA}, t AS (SELECT article_id AS doc_id, ' ' || array_to_string(tokens, ' ') || ' ' AS t FROM art), c AS (SELECT doc_id, w AS p FROM w UNION SELECT doc_id, left(w, 2) FROM w),
h AS (SELECT doc_id, string_agg(p, ' ' ORDER BY length(p) DESC, p) AS present FROM c JOIN t USING (doc_id) WHERE contains(t, ' ' || p || ' ') GROUP BY 1)
SELECT doc_id, coalesce(present, '') AS present FROM documents LEFT JOIN h USING (doc_id)""")
def phrases_present(spark, sf_dir):
    """Which identifiers of a document, and which heads of them, stand in it as whole words, long ones first."""
    asked = F.concat("phrases", F.transform("phrases", lambda p: F.left(p, F.lit(2))))
    text = F.array_join(tx.words(F.col("text")), " ")
    return _phrases(spark, sf_dir).select("doc_id", F.array_join(tx.phrases_present(text, asked), " ").alias("present"))


# ---------------------------------------------------------------- report sinks

_MEANS = f"{RUNS}, g AS (SELECT {_KEYS}, count(*) AS n_runs, avg(loss) AS loss, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM runs GROUP BY {_KEYS})"


def _means(spark, sf_dir):
    return rp.report(rp.strict_metrics(fx.run_metrics(spark, sf_dir)).withColumn("effective_epoch", F.col("epoch")))


@query(f"WITH {_MEANS} SELECT {_KEYS}, n_runs, round(loss, 6) AS loss, round(precision * 100, 4) AS precision, round(recall * 100, 4) AS recall, round(f1 * 100, 4) AS f1 FROM g")
def report_csv(spark, sf_dir):
    """IO16: means of runs by group as CSV and back, metrics but the loss in percent."""
    path = shared_dir(spark, "report")
    runs.write_csv(_means(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*_KEYS.split(", "), F.col("n_runs").cast("bigint").alias("n_runs"), F.round(F.col("loss").cast("double"), 6).alias("loss"), *(F.col(m).cast("double").alias(m) for m in ("precision", "recall", "f1")))


@query(f"WITH {_MEANS} SELECT rpad(model_id, 24, ' ') || rpad(train_variant, 24, ' ') || rpad(eval_set, 24, ' ') || rpad(n_runs::VARCHAR, 24, ' ') || printf('%.4f', f1) AS line FROM g")
def report_table(spark, sf_dir):
    """IO17: means of runs by group as lines of fixed columns."""
    return runs.table_text(_means(spark, sf_dir), ["model_id", "train_variant", "eval_set", "n_runs", "f1"])
