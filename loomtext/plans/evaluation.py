"""Queries over summaries, claims, metrics, reports and job matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext import fixtures as fx
from loomtext.functions import text as tx
from loomtext.operators import bootstrap as bs
from loomtext.operators import claims as cl
from loomtext.operators import matrix as mx
from loomtext.operators import metrics as me
from loomtext.operators import reports as rp
from loomtext.operators import summary as sm
from loomtext.plans.augmentation import _EX, _SPLIT, _assigned, _examples
from loomtext.plans.registry import PAIRS, RUNS, query
from loomtext.shared import shared_dir
from loomtext.sources import runs
from loomtext.sources.prepared import Cache

SEED = 7

# ---------------------------------------------------------------- example sets

_META = f"""{_EX}, m AS (SELECT 'category' AS field, category AS value FROM ex UNION ALL SELECT 'reason', 'unknown' FROM ex
  UNION ALL SELECT 'forced_relevant', 'false' FROM ex UNION ALL SELECT 'types_raw', unnest(types_raw) FROM ex)"""


def _meta(spark, sf_dir):
    none = F.lit(None)
    return _examples(spark, sf_dir).withColumns({"reason": none.cast("string"), "forced_relevant": none.cast("boolean"), "types_pooled": none.cast("array<string>")})


@query(f"WITH {_META} SELECT field, value, count(*) AS n FROM m GROUP BY 1, 2")
def meta_counts(spark, sf_dir):
    """A1: counts over metadata, unknown values among them."""
    return sm.meta_counts(_meta(spark, sf_dir))


_DIFF = "a AS (SELECT doc_id::VARCHAR AS id, text FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text, doc_id % 5 = 0 AS ch FROM documents WHERE doc_id % 10 <> 4)"


@query(f"""WITH {_DIFF} SELECT coalesce(a.id, b.id) AS example_id, CASE WHEN b.id IS NULL THEN 'left_only' WHEN a.id IS NULL THEN 'right_only' ELSE 'both' END AS side,
  coalesce(a.id IS NOT NULL AND b.id IS NOT NULL AND a.text <> b.text, false) AS changed_tokens, coalesce(a.id IS NOT NULL AND b.id IS NOT NULL AND (a.text <> b.text OR b.ch), false) AS changed_labels
FROM a FULL JOIN b ON a.id = b.id""")
def example_diff(spark, sf_dir):
    """Two example sets compared by id."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("example_id"), tx.words(F.col("text")).alias("tokens"))
    d = d.withColumn("labels", F.transform("tokens", lambda _: F.lit("O")))
    extra = F.col("doc_id") % 7 == 0
    b = d.where("doc_id % 10 <> 4").withColumn("tokens", F.when(extra, F.concat("tokens", F.array(F.lit("x")))).otherwise(F.col("tokens")))
    b = b.withColumn("labels", F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("B-Z"))).otherwise(F.transform("tokens", lambda _: F.lit("O"))))
    return sm.diff(d.where("doc_id % 10 <> 3"), b)


@query("""WITH a AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND lang <> 'es' GROUP BY 1), b AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND lang <> 'de' GROUP BY 1)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.lang = b.lang""")
def manifest_delta(spark, sf_dir):
    """Differences of counts over the union of keys."""
    d = fx.table(spark, sf_dir, "documents")
    n = lambda x: x.groupBy("lang").agg(F.count("*").alias("n"))
    return sm.delta(n(d.where("doc_id % 2 = 0 and lang <> 'es'")), n(d.where("doc_id % 2 = 1 and lang <> 'de'")), "lang")


# ---------------------------------------------------------------- claims

_MEM = f"{_SPLIT}, mem AS (SELECT 's1' AS lineage, split, article_id::VARCHAR AS article_id FROM asg UNION ALL SELECT 's2', split, article_id::VARCHAR FROM asg UNION ALL SELECT 's3', CASE WHEN article_id % 2 = 0 THEN 'train' ELSE 'eval' END, article_id::VARCHAR FROM asg UNION ALL SELECT 's3', 'eval', article_id::VARCHAR FROM asg WHERE article_id % 50 = 0)"
_DIG = f"{_MEM}, dig AS (SELECT lineage, split, count(*) AS n, sha256(string_agg(DISTINCT article_id, chr(10) ORDER BY article_id)) AS digest FROM mem GROUP BY 1, 2)"


def _members(spark, sf_dir):
    a = _assigned(spark, sf_dir).select("split", F.col("article_id"))
    s3 = a.select(F.lit("s3").alias("lineage"), F.when(F.col("article_id") % 2 == 0, "train").otherwise("eval").alias("split"), "article_id")
    more = a.where("article_id % 50 = 0").select(F.lit("s3").alias("lineage"), F.lit("eval").alias("split"), "article_id")
    out = a.select(F.lit("s1").alias("lineage"), "split", "article_id").unionByName(a.select(F.lit("s2").alias("lineage"), "split", "article_id")).unionByName(s3).unionByName(more)
    return out.withColumn("article_id", F.col("article_id").cast("string"))


@query(f"WITH {_DIG} SELECT lineage, split, n, digest FROM dig")
def claims_digest(spark, sf_dir):
    """Digest of each split."""
    return cl.split_digests(_members(spark, sf_dir))


@query(f"WITH {_DIG} SELECT 'split_hash' AS \"check\", lineage || '/' || split AS context, 'split hash differs from the manifest' AS message FROM dig WHERE lineage = 's1' AND split = 'test' UNION ALL SELECT 'split_hash', 's9/train', 'split hash differs from the manifest'")
def claims_split_hash(spark, sf_dir):
    """Splits that differ from their manifest, on either side."""
    m = _members(spark, sf_dir)
    wrong = F.when((F.col("lineage") == "s1") & (F.col("split") == "test"), "0").otherwise(F.col("digest"))
    manifest = cl.split_digests(m).select("lineage", "split", wrong.alias("digest")).unionByName(spark.createDataFrame([("s9", "train", "1")], "lineage string, split string, digest string"))
    return cl.digest_mismatches(m, manifest)


@query(f"WITH {_MEM}, o AS (SELECT lineage, count(DISTINCT article_id) AS n FROM mem t WHERE split = 'train' AND EXISTS (SELECT 1 FROM mem e WHERE e.lineage = t.lineage AND e.split = 'eval' AND e.article_id = t.article_id) GROUP BY 1) SELECT 'split_overlap' AS \"check\", lineage AS context, n || ' articles in train and eval' AS message FROM o")
def claims_overlap(spark, sf_dir):
    """Articles in train and eval of one lineage."""
    return cl.split_overlaps(_members(spark, sf_dir))


@query("SELECT 'equal_lineages' AS \"check\", 's1,s2' AS context, 'identical split signature' AS message")
def claims_equal_lineages(spark, sf_dir):
    """Lineages that are the same."""
    return cl.equal_lineages(_members(spark, sf_dir))


@query("WITH f AS (SELECT 'd' || (doc_id % 3) AS dataset, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1) SELECT 'foreign_articles' AS \"check\", dataset AS context, n || ' articles outside the source splits' AS message FROM f")
def claims_foreign(spark, sf_dir):
    """C4: articles outside the allowed ones."""
    d = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("dataset"), F.col("doc_id").alias("article_id"), "lang")
    return cl.foreign_articles(d, d.where("lang <> 'fr'"))


@query("""WITH b AS (SELECT DISTINCT unnest(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: length(x) > 9)) AS value FROM benchmark),
r AS (SELECT DISTINCT doc_id, lang, unnest(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: length(x) > 9)) AS value FROM documents)
SELECT 'phrase_leak' AS "check", lang AS context, count(DISTINCT doc_id) AS n_rows FROM r WHERE value IN (SELECT value FROM b) GROUP BY 2""")
def claims_leaked_rows(spark, sf_dir):
    """Rows, not values, that hold training phrases."""
    long = lambda c: F.filter(tx.words(F.col(c)), lambda x: F.length(x) > 9)
    values = fx.table(spark, sf_dir, "benchmark").select(F.explode(long("text")).alias("value"))
    rows = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("context"), F.col("doc_id").alias("example_id"), long("text").alias("values"))
    return cl.rows_with_values(rows, values, "phrase_leak")


@query(f"WITH {_MEM}, o AS (SELECT DISTINCT lineage FROM mem t WHERE split = 'train' AND EXISTS (SELECT 1 FROM mem e WHERE e.lineage = t.lineage AND e.split = 'eval' AND e.article_id = t.article_id)), v AS (SELECT 'split_overlap' AS c FROM o UNION ALL SELECT 'equal_lineages') SELECT c AS \"check\", count(*) AS n FROM v GROUP BY ROLLUP (c)")
def claims_rollup(spark, sf_dir):
    """Violations of all checks, with their total."""
    m = _members(spark, sf_dir)
    return cl.rollup(cl.all_violations(cl.split_overlaps(m), cl.equal_lineages(m)))


_CHECKED = f"""{RUNS}, l AS (SELECT * REPLACE (CASE WHEN ord % 7 = 0 THEN NULL ELSE f1 END AS f1, CASE WHEN model_id = 'view' AND seed = 4 THEN 5 ELSE seed END AS seed), model_id || '/' || "set" || '/seed_' || seed || '/' || train_variant AS run, seed AS own
  FROM runs WHERE NOT (eval_set = 'unaugmented' AND seed = 0 AND train_variant = 'all') QUALIFY row_number() OVER (PARTITION BY model_id, "set", seed, train_variant, eval_set ORDER BY ord DESC) = 1),
sp AS (SELECT DISTINCT model_id || '/' || "set" || '/seed_' || seed || '/' || train_variant AS run, "set", seed, model_id, train_variant FROM runs),
stt AS (SELECT run, CASE WHEN seed = 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN "set" = 'set2' AND seed = 1 THEN 'other' ELSE md5(run) END AS sig, CASE WHEN seed = 2 AND train_variant = 'all' THEN 'other' ELSE md5(run || 'm') END AS sha FROM sp WHERE NOT (seed = 1 AND train_variant = 'none')),
mt AS (SELECT run, max(seed) AS seed, list_sort(list(DISTINCT eval_set)) AS sets, coalesce(list_sort(list(DISTINCT eval_set) FILTER (f1 IS NULL)), []) AS part, coalesce(list_sort(list(DISTINCT eval_set) FILTER (f1 IS NOT NULL AND abs(f1) <= 0.2 AND abs(precision) <= 0.2 AND abs(recall) <= 0.2)), []) AS low FROM l WHERE NOT (model_id = 'error' AND own = 4) GROUP BY run)"""


_CHECKED_ERRORS = f"""WITH {_CHECKED}, e AS (SELECT sp.run, list_filter(list_concat(
  [CASE WHEN stt.run IS NULL THEN 'missing_state' END, CASE WHEN mt.run IS NULL THEN 'missing_metrics' END, CASE WHEN status <> 'completed' THEN 'status:' || status END, CASE WHEN sig <> md5(sp.run) THEN 'signature_mismatch' END,
    CASE WHEN mt.run IS NOT NULL AND sha <> md5(sp.run || 'm') THEN 'metrics_hash_mismatch' END, CASE WHEN mt.seed <> sp.seed THEN 'identity_mismatch:seed' END],
  list_transform(list_filter(['augmented_exclusive', 'unaugmented'], lambda x: NOT list_contains(coalesce(sets, []), x)), lambda x: 'missing_eval_set:' || x),
  list_transform(coalesce(part, []), lambda x: 'missing_metric:' || x), list_transform(coalesce(low, []), lambda x: 'collapsed:' || x)), lambda x: x IS NOT NULL) AS errors
FROM sp LEFT JOIN stt ON stt.run = sp.run LEFT JOIN mt ON mt.run = sp.run)
SELECT run, array_to_string(errors, ',') AS errors, len(errors) = 0 AS ok FROM e"""


def _faulty_runs(spark, sf_dir):
    """(specs, metrics, states) of the runs of the table, some with faults; ``metrics`` holds a struct ``m`` for each eval set."""
    r = fx.run_metrics(spark, sf_dir)
    run = F.concat_ws("/", "model_id", "set", F.concat(F.lit("seed_"), F.col("seed").cast("string")), "train_variant")
    r = r.withColumn("run", run)
    specs = r.select("run", F.md5(F.col("run").cast("binary")).alias("signature"), "task", "set", "seed", "model_id", "train_variant").distinct()
    # metrics of some runs lack an eval set, a value, or all; one names another seed
    f1 = F.when(F.col("ord") % 7 != 0, F.col("f1"))
    point = [F.col("precision"), F.col("recall"), f1.alias("f1"), F.col("loss")]
    held = r.where(~((F.col("eval_set") == "unaugmented") & (F.col("seed") == 0) & (F.col("train_variant") == "all")) & ~((F.col("model_id") == "error") & (F.col("seed") == 4)))
    last = held.groupBy("run", "task", "set", "seed", "model_id", "train_variant", "eval_split", "eval_set").agg(F.max_by(F.struct(*point), "ord").alias("m"))
    metrics = last.withColumn("seed", F.when((F.col("model_id") == "view") & (F.col("seed") == 4), 5).otherwise(F.col("seed")))
    state = specs.where(~((F.col("seed") == 1) & (F.col("train_variant") == "none"))).select(
        "run", F.when(F.col("seed") == 3, "failed").otherwise("completed").alias("status"), F.when((F.col("set") == "set2") & (F.col("seed") == 1), "other").otherwise(F.col("signature")).alias("signature"),
        F.when((F.col("seed") == 2) & (F.col("train_variant") == "all"), "other").otherwise(F.md5(F.concat("run", F.lit("m")).cast("binary"))).alias("metrics_sha256"),
    )
    return specs, metrics, state


@query(_CHECKED_ERRORS)
def run_validation_folders(spark, sf_dir):
    """C10 F7 IO15 IO16: every run of the table as a folder with its metrics and state, read back and checked; some have faults."""
    path = shared_dir(spark, "checked")
    specs, held, state = _faulty_runs(spark, sf_dir)
    documents = held.groupBy("run", "task", "set", "seed", "model_id", "train_variant", "eval_split").agg(F.map_from_entries(F.collect_list(F.struct("eval_set", "m"))).alias("metrics"))
    documents.select("run", F.to_json(F.struct("task", "set", "seed", "model_id", "train_variant", "eval_split", "metrics")).alias("value")).write.partitionBy("run").text(f"{path}/metrics")
    state.select("run", F.to_json(F.struct("status", "signature", "metrics_sha256")).alias("value")).write.partitionBy("run").text(f"{path}/states")
    name = lambda c: F.url_decode(F.url_decode(F.regexp_extract(c, r"/run=([^/]*)(?:/|$)", 1)))
    metrics = runs.read_metrics(spark, f"{path}/metrics", name="*.txt", complete=False).withColumn("run", name("run"))
    metrics = metrics.withColumn("metrics_sha256", F.md5(F.concat("run", F.lit("m")).cast("binary")))
    states = runs.read_states(spark, f"{path}/states", name="*.txt").withColumn("run", name("run"))
    out = cl.validate_runs(specs, states, metrics, eval_sets=("augmented_exclusive", "unaugmented"), epsilon=0.2)
    return out.withColumn("errors", F.array_join("errors", ","))


@query(f"""WITH {RUNS}, a AS (SELECT model_id, eval_set, avg(f1) AS value FROM runs WHERE model_id <> 'click' GROUP BY 1, 2), b AS (SELECT model_id, eval_set, avg(f1) + CASE WHEN eval_set = 'unaugmented' THEN 0.001 ELSE 0 END AS value FROM runs WHERE model_id <> 'view' GROUP BY 1, 2)
SELECT coalesce(a.model_id, b.model_id) AS model_id, coalesce(a.eval_set, b.eval_set) AS eval_set, CASE WHEN a.value IS NULL THEN 'missing_a' WHEN b.value IS NULL THEN 'missing_b' ELSE 'differs' END AS status
FROM a FULL JOIN b ON a.model_id = b.model_id AND a.eval_set = b.eval_set WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 1e-6""")
def parity_compare(spark, sf_dir):
    """C11: metrics of two backends within a tolerance."""
    r = fx.run_metrics(spark, sf_dir).groupBy("model_id", "eval_set").agg(F.avg("f1").alias("value"))
    b = r.where("model_id <> 'view'").withColumn("value", F.col("value") + F.when(F.col("eval_set") == "unaugmented", 0.001).otherwise(0.0))
    return cl.metric_parity(r.where("model_id <> 'click'"), b, "model_id", "eval_set").select("model_id", "eval_set", "status")


@query("""WITH f AS (SELECT 'f' || lpad(page_id::VARCHAR, 6, '0') AS path, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS h FROM pages)
SELECT count(*) AS n_files, sum(size)::BIGINT AS n_bytes, sha256(string_agg(path || chr(9) || size || chr(9) || h || chr(10), '' ORDER BY path)) AS digest FROM f""")
def tree_digest(spark, sf_dir):
    """A19 IO6: digest of a tree of files."""
    html = F.coalesce("html", F.lit(""))
    f = fx.table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.lpad(F.col("page_id").cast("string"), 6, "0")).alias("path"), F.octet_length(html).alias("size"), F.sha2(html.cast("binary"), 256).alias("sha256"))
    return cl.tree_digest(f)


# ---------------------------------------------------------------- metrics

_CELLS = f"{PAIRS}, c AS (SELECT count(*) AS n, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, avg(loss) AS loss, stddev_samp(loss) AS sd FROM pairs)"
_PRF = f"{_CELLS}, m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM c), k AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)"


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query(f"WITH {_PRF} SELECT n, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, round(loss, 9) AS loss FROM k")
def binary_metrics(spark, sf_dir):
    """A5: binary precision, recall, F1 and mean loss."""
    return _r(me.binary_metrics(fx.classified_pairs(spark, sf_dir)), "precision", "recall", "f1", "loss")


@query("""WITH t AS (SELECT l_returnflag <> 'N' AS t, coalesce(lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag), 'N') <> 'N' AS p FROM lineitem),
c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM t), m AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / (tp + fn)::DOUBLE AS re FROM c)
SELECT tp, fp, fn, round(pr, 9) AS precision, round(re, 9) AS recall, round(2 * pr * re / (pr + re), 9) AS f1 FROM m""")
def token_prf(spark, sf_dir):
    """Token metrics that ignore the type."""
    from pyspark.sql import Window

    label = F.when(F.col("l_returnflag") == "N", "O").otherwise(F.concat(F.lit("B-"), "l_returnflag"))
    rows = fx.table(spark, sf_dir, "lineitem").withColumn("y_true", label)
    pred = F.coalesce(F.lead("y_true").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")), F.lit("O"))
    return _r(me.token_metrics(rows.withColumn("y_pred", pred)), "precision", "recall", "f1")


_Z = repr(me.normal_quantile(0.95))
_CLIP = "greatest(0.0, least(1.0, {} {} " + _Z + " * {}))"


@query(f"""WITH {_PRF}, s AS (SELECT *, p * (1 - p) / (tp + fp) AS vp, r * (1 - r) / (tp + fn) AS vr, 2 * r * r / ((p + r) * (p + r)) AS dp, 2 * p * p / ((p + r) * (p + r)) AS dr FROM k),
e AS (SELECT *, sqrt(vp) AS sp, sqrt(vr) AS sr, sqrt(dp * dp * vp + dr * dr * vr) AS sf, sd / sqrt(n) AS sl FROM s)
SELECT {", ".join(f"round({_CLIP.format(c, o, s)}, 9) AS {name}_{e}" for c, s, name in (("p", "sp", "precision"), ("r", "sr", "recall"), ("f", "sf", "f1")) for o, e in (("-", "lo"), ("+", "hi")))},
  round(loss - {_Z} * sl, 9) AS loss_lo, round(loss + {_Z} * sl, 9) AS loss_hi FROM e""")
def ci_clt(spark, sf_dir):
    """Normal intervals by the delta method."""
    rows = fx.classified_pairs(spark, sf_dir)
    m = me.binary_metrics(rows).crossJoin(rows.agg(F.stddev_samp("loss").alias("loss_sd")))
    cols = [f"{a}_{b}" for a in ("precision", "recall", "f1", "loss") for b in ("lo", "hi")]
    return _r(me.clt_intervals(m).select(*cols), *cols)


@query(f"WITH {RUNS}, g AS (SELECT model_id, train_variant, count(*) AS n, avg(f1) AS mu, stddev_samp(f1) AS sd FROM runs GROUP BY 1, 2) SELECT model_id, train_variant, n, round(mu - {_Z} * sd / sqrt(n), 9) AS lo, round(mu + {_Z} * sd / sqrt(n), 9) AS hi FROM g")
def ci_scalar_clt(spark, sf_dir):
    """Normal intervals of run metrics, around the mean."""
    v = fx.run_metrics(spark, sf_dir).withColumn("value", F.col("f1"))
    return _r(me.clt_scalar(v, "model_id", "train_variant"), "lo", "hi")


_BOOT = me.CI["n_bootstrap"]
_VALS = f"{RUNS}, v AS (SELECT model_id, (seed * 2 + right(\"set\", 1)::INT - 1)::INT AS i, avg(f1) AS value FROM runs GROUP BY 1, 2), nn AS (SELECT model_id, count(*) AS n FROM v GROUP BY 1), vv AS (SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY i) - 1 AS i, value FROM v)"


def _values(spark, sf_dir):
    r = fx.run_metrics(spark, sf_dir)
    return r.groupBy("model_id", (F.col("seed") * 2 + F.right("set", F.lit(1)).cast("int") - 1).alias("i")).agg(F.avg("f1").alias("value"))


def _mixed_sql(x: str) -> str:
    """SQL of :func:`loomtext.operators.bootstrap.mix`."""
    first, second = bs.MULTIPLIERS
    x = f"list_transform([{x}], lambda x: (xor(x, x >> 16) * {first}) % 4294967296)"
    return f"list_transform(list_transform({x}, lambda x: (xor(x, x >> 15) * {second}) % 4294967296), lambda x: xor(x, x >> 15))[1]"


def _place_sql(groups: str, key: str, replicates: int, keep: str) -> str:
    """SQL of (keep, key, b, j, i): the places that replicates draw; ``groups`` is a table with n."""
    head = lambda at: f"('0x' || substr(md5(concat_ws(':', '{SEED}:boot', {key})), {at}, 8))::BIGINT"
    own = f"SELECT {keep}, {key} AS key, n, j.j, {_mixed_sql(f'(j.j + {head(1)}) % 4294967296')} AS v FROM {groups} g, (SELECT unnest(range((SELECT max(n) FROM {groups}))) AS j) j WHERE j.j < n"
    of = f"SELECT {key} AS key, b.b, {_mixed_sql(f'(b.b + {head(9)}) % 4294967296')} AS w FROM {groups} g, range({replicates}) b(b)"
    return f"SELECT x.*, y.b, ({_mixed_sql('(x.v + y.w) % 4294967296')} * x.n) >> 32 AS i FROM ({own}) x JOIN ({of}) y USING (key)"


def _boot_sql(stat: str, point: str, order: str) -> str:
    return f"""WITH {_VALS.replace("ORDER BY i)", f"ORDER BY {order})")}, ix AS ({_place_sql("nn", "model_id", _BOOT, "model_id")}),
s AS (SELECT ix.model_id, ix.b, {stat} AS m FROM ix JOIN vv ON vv.model_id = ix.model_id AND vv.i = ix.i GROUP BY 1, 2),
q AS (SELECT model_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM s GROUP BY 1), p AS (SELECT model_id, {point} AS point FROM v GROUP BY 1)
SELECT model_id, round(point, 9) AS point, round(lo, 9) AS percentile_lo, round(hi, 9) AS percentile_hi, round(2 * point - hi, 9) AS basic_lo, round(2 * point - lo, 9) AS basic_hi FROM p JOIN q USING (model_id)"""


_ENDS = ["point", "percentile_lo", "percentile_hi", "basic_lo", "basic_hi"]


@query(_boot_sql("avg(value)", "avg(value)", "i"))
def ci_bootstrap_mean(spark, sf_dir):
    """Percentile and basic bootstrap intervals of means."""
    return _r(me.bootstrap_intervals(_values(spark, sf_dir), "model_id", n_bootstrap=_BOOT, seed=SEED), *_ENDS)


@query(_boot_sql("median(value)", "median(value)", "value, i"))
def ci_bootstrap_median(spark, sf_dir):
    """Bootstrap intervals of medians."""
    return _r(me.bootstrap_intervals(_values(spark, sf_dir), "model_id", n_bootstrap=_BOOT, seed=SEED, point="median"), *_ENDS)


@query(f"""WITH {_PRF}, o AS (SELECT * EXCLUDE (i), row_number() OVER (ORDER BY CASE WHEN y_true = 1 AND y_pred = 1 THEN 0 WHEN y_pred = 1 THEN 1 WHEN y_true = 1 THEN 2 ELSE 3 END, loss) - 1 AS i FROM pairs),
nn AS (SELECT count(*) AS n FROM o), ix AS ({_place_sql("nn", "''", _BOOT, "0 AS z")}),
s AS (SELECT b, sum(y_true * y_pred) AS tp, sum((1 - y_true) * y_pred) AS fp, sum(y_true * (1 - y_pred)) AS fn, avg(loss) AS loss FROM ix JOIN o USING (i) GROUP BY b),
x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM s),
y AS (SELECT 'precision' AS metric, p AS v FROM x UNION ALL SELECT 'recall', r FROM x UNION ALL SELECT 'f1', CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END FROM x UNION ALL SELECT 'loss', loss FROM x),
q AS (SELECT metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM y GROUP BY 1),
pt AS (SELECT 'precision' AS metric, p AS point FROM k UNION ALL SELECT 'recall', r FROM k UNION ALL SELECT 'f1', f FROM k UNION ALL SELECT 'loss', loss FROM k)
SELECT metric, round(point, 9) AS point, round(lo, 9) AS percentile_lo, round(hi, 9) AS percentile_hi, round(2 * point - hi, 9) AS basic_lo, round(2 * point - lo, 9) AS basic_hi FROM pt JOIN q USING (metric)""")
def ci_bootstrap_binary(spark, sf_dir):
    """Percentile and basic bootstrap intervals of binary precision, recall, F1 and loss."""
    return _r(me.binary_intervals(fx.classified_pairs(spark, sf_dir), n_bootstrap=_BOOT, seed=SEED), *_ENDS)


@query(f"WITH {RUNS}, v AS (SELECT model_id, max(f1) AS hi, min(f1) AS lo FROM runs GROUP BY 1) SELECT model_id, 'range' AS method, round(lo, 9) AS lo, round(hi, 9) AS hi FROM v")
def ci_custom(spark, sf_dir):
    """A10: a user's interval function."""
    v = fx.run_metrics(spark, sf_dir).select("model_id", F.col("f1").alias("value"))
    return _r(me.custom_intervals(v, lambda point, values, config: {"range": [min(values), max(values)]}, {}, "model_id"), "lo", "hi")


# ---------------------------------------------------------------- reports

_KEYS = "task, model_id, train_variant, eval_split, eval_set"


@query(f"WITH {RUNS} SELECT {_KEYS}, count(*) AS n_runs, CASE WHEN count(DISTINCT epoch) = 1 THEN max(epoch) END AS effective_epoch, round(avg(loss), 6) AS loss, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM runs GROUP BY {_KEYS}")
def report_mean(spark, sf_dir):
    """Means of runs by group."""
    r = rp.report(rp.strict_metrics(fx.run_metrics(spark, sf_dir)).withColumn("effective_epoch", F.col("epoch")))
    return _r(r, "precision", "recall", "f1").withColumn("loss", F.round("loss", 6))


@query(f"""WITH {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY f1, precision, recall, loss, "set", seed) AS r, count(*) OVER (PARTITION BY {_KEYS}) AS n FROM runs)
SELECT {_KEYS}, max(n) AS n_runs, NULL::INT AS effective_epoch, round(avg(loss), 6) AS loss, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM o WHERE r IN ((n + 1) // 2, (n + 2) // 2) GROUP BY {_KEYS}""")
def report_median_run(spark, sf_dir):
    """The middle run, or the mean of the two middle ones."""
    return _r(rp.report(fx.run_metrics(spark, sf_dir), point="median"), "precision", "recall", "f1").withColumn("loss", F.round("loss", 6))


def _interval_sql(stat, extra: str) -> str:
    """SQL of :func:`loomtext.operators.reports.report_intervals`: the runs of a replicate in the order of middle runs."""
    key = "task || ':' || model_id || ':' || train_variant || ':' || eval_split || ':' || eval_set"
    long = " UNION ALL ".join(f"SELECT {_KEYS}, b, '{m}' AS metric, {stat(m)} AS v FROM d {extra} GROUP BY {_KEYS}, b" for m in rp.METRICS)
    points = " UNION ALL ".join(f"SELECT {_KEYS}, max(n) AS n_runs, '{m}' AS metric, avg({m}) AS point FROM o {'' if not extra else 'WHERE i IN ((n - 1) // 2, n // 2)'} GROUP BY {_KEYS}" for m in rp.METRICS)
    return f"""WITH {RUNS}, o AS (SELECT *, {key} AS key, row_number() OVER (PARTITION BY {_KEYS} ORDER BY f1, precision, recall, loss, "set", seed) - 1 AS i, count(*) OVER (PARTITION BY {_KEYS}) AS n FROM runs),
gs AS (SELECT DISTINCT key AS gk, n FROM o), ix AS ({_place_sql("gs", "gk", _REPORT_BOOT, "gk")}),
d AS (SELECT o.*, ix.b, row_number() OVER (PARTITION BY ix.key, ix.b ORDER BY ix.i) - 1 AS r FROM ix JOIN o ON o.key = ix.key AND o.i = ix.i),
l AS ({long}), q AS (SELECT {_KEYS}, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM l GROUP BY ALL), p AS ({points})
SELECT {_KEYS}, n_runs, metric, round(point, 9) AS point, round(lo, 9) AS percentile_lo, round(hi, 9) AS percentile_hi, round(2 * point - hi, 9) AS basic_lo, round(2 * point - lo, 9) AS basic_hi
FROM p JOIN q USING ({_KEYS}, metric)"""


#: Replicates of the queries that SQL is asked to repeat.
_REPORT_BOOT = 40


def _intervals(spark, sf_dir, point, n_bootstrap=_REPORT_BOOT):
    out = rp.report_intervals(rp.strict_metrics(fx.run_metrics(spark, sf_dir)), point=point, n_bootstrap=n_bootstrap, seed=SEED)
    return out.withColumns({c: F.round(c, 9) for c in _ENDS})


@query(_interval_sql(lambda m: f"avg({m})", ""))
def report_mean_intervals(spark, sf_dir):
    """Means of runs by group with percentile and basic bootstrap intervals."""
    return _intervals(spark, sf_dir, "mean")


@query(_interval_sql(lambda m: f"avg({m})", "WHERE r IN ((n - 1) // 2, n // 2)"))
def report_median_intervals(spark, sf_dir):
    """The middle run by group, intervals from the middle runs of replicates."""
    return _intervals(spark, sf_dir, "median")


@query(None)
def report_mean_intervals_default(spark, sf_dir):
    """The same with the default number of replicates, too many for SQL."""
    return _intervals(spark, sf_dir, "mean", _BOOT)


@query(None)
def report_median_intervals_default(spark, sf_dir):
    """The same with the default number of replicates, too many for SQL."""
    return _intervals(spark, sf_dir, "median", _BOOT)


@query(f"WITH {RUNS} SELECT {_KEYS}, epoch, count(*) AS n_runs, round(avg(f1), 9) AS f1 FROM runs WHERE model_id IN ('click', 'view') AND run_updated_at >= TIMESTAMP '2000-01-01' GROUP BY {_KEYS}, epoch")
def live_report(spark, sf_dir):
    """Means with the epoch in the key, filtered by members; empty filters keep all."""
    rows = rp.members(fx.run_metrics(spark, sf_dir), model_id=["click", "view"], eval_set=[])
    return _r(rp.live_report(rp.in_time_range(rows, since="2000-01-01")).select(*rp.GROUP, "epoch", "n_runs", "f1"), "f1")


_UNIT = "task, model_id, \"set\", seed, epoch, eval_split, eval_set"
_DELTA = f"""{RUNS}, l AS (SELECT {_UNIT}, train_variant, arg_max(loss, ord) AS loss, arg_max(precision, ord) AS precision, arg_max(recall, ord) AS recall, arg_max(f1, ord) AS f1 FROM runs WHERE epoch IN (1, 2, 3, 4) GROUP BY {_UNIT}, train_variant),
d AS (SELECT a.task, a.model_id, a."set", a.seed, a.eval_split, a.eval_set, a.loss - b.loss AS loss, a.precision - b.precision AS precision, a.recall - b.recall AS recall, a.f1 - b.f1 AS f1
  FROM (SELECT *, 0 AS z FROM l) a JOIN l b ON a.train_variant = 'all' AND b.train_variant = 'none' AND a.task = b.task AND a.model_id = b.model_id AND a."set" = b."set" AND a.seed = b.seed AND a.eval_split = b.eval_split AND a.eval_set = b.eval_set)"""
_DELTA = _DELTA.replace(_UNIT, _UNIT.replace(", epoch", "")).replace(" WHERE epoch IN (1, 2, 3, 4)", "")
_PAIR = ["task", "model_id", "set", "seed", "eval_split", "eval_set"]


@query(f'WITH {_DELTA} SELECT task, model_id, "set", seed, eval_split, eval_set, round(loss, 6) AS loss, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM d')
def paired_deltas(spark, sf_dir):
    """Differences of runs with and without augmentation."""
    d = rp.paired_deltas(fx.run_metrics(spark, sf_dir), "all", "none", unit=_PAIR)
    return _r(d, "precision", "recall", "f1").withColumn("loss", F.round("loss", 6))


@query(f"WITH {_DELTA} SELECT task, model_id, eval_split, eval_set, count(*) AS n_pairs, round(median(loss), 6) AS loss, round(median(precision), 9) AS precision, round(median(recall), 9) AS recall, round(median(f1), 9) AS f1 FROM d GROUP BY 1, 2, 3, 4")
def delta_report(spark, sf_dir):
    """Medians of the differences."""
    d = rp.paired_deltas(fx.run_metrics(spark, sf_dir), "all", "none", unit=_PAIR)
    return _r(rp.delta_report(d, point="median", keys=["task", "model_id", "eval_split", "eval_set"]), "precision", "recall", "f1").withColumn("loss", F.round("loss", 6))


def _calibration_sql(metric: str, order: str) -> str:
    return f"""WITH {RUNS}, u AS (SELECT model_id, epoch, task, "set", seed, train_variant, arg_max({metric}, ord) FILTER (eval_set = 'augmented_exclusive') AS a, arg_max({metric}, ord) FILTER (eval_set = 'unaugmented') AS b FROM runs GROUP BY 1, 2, 3, 4, 5, 6),
s AS (SELECT *, (a + b) / 2 AS score FROM u WHERE a IS NOT NULL AND b IS NOT NULL AND epoch >= 2), m AS (SELECT model_id, epoch, count(*) AS n_units_total, median(score) AS score_median FROM s GROUP BY 1, 2)
SELECT model_id, epoch, n_units_total, n_units_total AS n_units_used, 0::BIGINT AS n_collapsed, 0.0::DOUBLE AS collapse_rate, round(score_median, 6) AS score_median, row_number() OVER (PARTITION BY model_id ORDER BY score_median {order}, epoch) = 1 AS is_best FROM m"""


@query(_calibration_sql("f1", "DESC").replace("n_units_total AS n_units_used, 0::BIGINT AS n_collapsed, 0.0::DOUBLE AS collapse_rate", "n_units_total - c AS n_units_used, c AS n_collapsed, c / n_units_total::DOUBLE AS collapse_rate").replace("median(score) AS score_median", "median(score) FILTER (score > 0.2) AS score_median, count(*) FILTER (score <= 0.2) AS c"))
def calibrate_epochs(spark, sf_dir):
    """The best epoch by median balanced F1, collapsed units excluded."""
    c = rp.calibrate(fx.run_metrics(spark, sf_dir), min_epoch=2, exclude_collapsed=True, epsilon=0.2)
    return c.withColumn("score_median", F.round("score_median", 6))


@query(_calibration_sql("loss", "ASC"))
def calibrate_by_loss(spark, sf_dir):
    """The best epoch by median loss."""
    c = rp.calibrate(fx.run_metrics(spark, sf_dir), "balanced_loss", min_epoch=2)
    return c.withColumn("score_median", F.round("score_median", 6))


@query("SELECT event_type AS task, 'root' AS experiment_root, count(*) AS n_jobs, count(*) FILTER (event_id % 3 = 0) AS n_completed, count(*) FILTER (event_id % 3 = 1) AS n_failed, count(*) FILTER (event_id % 3 = 2) AS n_skipped FROM events GROUP BY 1")
def status_summary(spark, sf_dir):
    """Jobs by status."""
    status = F.element_at(F.array(F.lit("completed"), F.lit("failed"), F.lit("skipped")), (F.col("event_id") % 3 + 1).cast("int"))
    return rp.status_summary(fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.lit("root").alias("experiment_root"), status.alias("status")))


@query("WITH b AS (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY AS lo FROM events) SELECT event_id, strftime(ts, '%H:%M %d/%m/%y') AS shown FROM events, b WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04'")
def time_range_filter(spark, sf_dir):
    """A half-open range whose upper date counts as a whole day."""
    e = fx.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("run_updated_at"))
    return rp.in_time_range(e, "2024-01-02", "2024-01-03").select("event_id", tx.short_time(F.col("run_updated_at")).alias("shown"))


# ---------------------------------------------------------------- jobs and prepared rows


@query("SELECT lang AS train_variant FROM (SELECT DISTINCT source, lang FROM documents) d GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT source) FROM documents)")
def common_variants(spark, sf_dir):
    """Variants that every set has."""
    return mx.common_variants(fx.table(spark, sf_dir, "documents").select(F.lit("t").alias("task"), F.col("source").alias("set"), F.col("lang").alias("train_variant")))


@query("SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber IN (1, 2) AND l_returnflag IN ('R')")
def save_policy(spark, sf_dir):
    """A conjunction of memberships over jobs."""
    jobs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("model"))
    return jobs.where(mx.matches_policy({"seed": [1, 2], "model": ["R"], "task": []})).select("id")


_ROWS = "lb AS (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS t, CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'B-' || l_returnflag END AS label FROM lineitem)"


def _orders(spark, sf_dir):
    """Examples made of orders: tokens are part keys, labels return flags."""
    label = F.when(F.col("l_returnflag") == "N", "O").otherwise(F.concat(F.lit("B-"), "l_returnflag"))
    d = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("example_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("t"), label.alias("x")))).alias("r"))
    return d.select("example_id", F.transform("r", lambda r: r["t"]).alias("tokens"), F.transform("r", lambda r: r["x"]).alias("labels"))


@query(f"WITH {_ROWS}, d AS (SELECT DISTINCT label FROM lb UNION SELECT 'O') SELECT label, (row_number() OVER (ORDER BY label <> 'O', label) - 1)::INT AS id FROM d")
def label_map(spark, sf_dir):
    """Ids of labels, O first."""
    return mx.label_map(_orders(spark, sf_dir).select(F.explode("labels").alias("label")))


@query(f"WITH {_ROWS}, d AS (SELECT label, row_number() OVER (ORDER BY label <> 'O', label) - 1 AS id FROM (SELECT DISTINCT label FROM lb UNION SELECT 'O') x) SELECT l_orderkey::VARCHAR AS example_id, string_agg(id::VARCHAR, ',' ORDER BY rn) AS labels, count(*)::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, t, label) AS rn FROM lb) l JOIN d USING (label) GROUP BY 1")
def prepared_rows(spark, sf_dir):
    """Rows clipped to a length, labels as ids."""
    ex = _orders(spark, sf_dir)
    p = mx.prepared(ex, mx.label_map(ex.select(F.explode("labels").alias("label"))))
    return p.select("example_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), F.size("input_ids").alias("n"))


@query(f"WITH {_ROWS}, d AS (SELECT label, row_number() OVER (ORDER BY label <> 'O', label) - 1 AS id FROM (SELECT DISTINCT label FROM lb UNION SELECT 'O') x) SELECT l_orderkey::VARCHAR AS example_id, string_agg(id::VARCHAR, ',' ORDER BY rn) AS labels, count(*)::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, t, label) AS rn FROM lb) l JOIN d USING (label) GROUP BY 1")
def prepared_cache(spark, sf_dir):
    """Prepared rows from the cache, where a second call finds those of the first."""
    cache = Cache(spark, shared_dir(spark, "prepared"))
    key = {"table": f"{sf_dir}/orders.parquet", "max_length": 510}
    ex = _orders(spark, sf_dir)
    cache.prepare(key, lambda: mx.prepared(ex, mx.label_map(ex.select(F.explode("labels").alias("label")))))
    p = cache.prepare(key, lambda: ex.limit(0))
    return p.select("example_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), F.size("input_ids").alias("n"))


_PREPARED = f"""{_ROWS}, d AS (SELECT label, row_number() OVER (ORDER BY label <> 'O', label) - 1 AS id FROM (SELECT DISTINCT label FROM lb UNION SELECT 'O') x),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, t, label) AS rn FROM lb),
e AS (SELECT l_orderkey::VARCHAR AS id, string_agg('1', ',') AS m, string_agg(('0x' || left(md5(t::VARCHAR), 7))::INT::VARCHAR, ',' ORDER BY rn) AS i, string_agg(d.id::VARCHAR, ',' ORDER BY rn) AS l FROM n JOIN d USING (label) GROUP BY 1),
h AS (SELECT id, sha256('{{"attention_mask":[' || m || '],"example_id":"' || id || '","input_ids":[' || i || '],"labels":[' || l || ']}}') AS h FROM e),
g AS (SELECT left(md5(id), 3) AS g, count(*) AS n, sha256(string_agg(h, '' ORDER BY id)) AS h FROM h GROUP BY 1)"""


@query(f"WITH {_PREPARED} SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY g)) AS digest FROM g")
def prepared_fingerprint(spark, sf_dir):
    """O2: digest of prepared rows, whatever their partitions."""
    ex = _orders(spark, sf_dir)
    return mx.fingerprint(mx.prepared(ex, mx.label_map(ex.select(F.explode("labels").alias("label")))))
