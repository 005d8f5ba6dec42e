"""Queries over files: each writes what it reads to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext import fixtures as fx
from loomtext.operators import summary as sm
from loomtext.plans import commands
from loomtext.plans.augmentation import _SPLIT, _assigned
from loomtext.plans.evaluation import _ROWS, _orders
from loomtext.plans.registry import ART, LAB, LEX, RUNS, query
from loomtext.shared import shared_dir
from loomtext.sources import config, conll, jsonl, results, runs


@query(f"WITH {LAB} SELECT label, count(*) AS n_tokens, count(DISTINCT article_id) AS n_examples, CASE WHEN label = 'O' THEN 'O' ELSE split_part(label, '-', 1) END AS prefix FROM lab GROUP BY label")
def conll_round_trip(spark, sf_dir):
    """IO1 IO2 IO10: labelled documents as CoNLL files and back, counted by label."""
    path = shared_dir(spark, "conll")
    conll.write_conll(fx.labelled(spark, sf_dir).where(F.size("tokens") > 0), path, order_by="article_id")
    back = conll.read_conll(spark, path).withColumn("example_id", F.concat_ws(":", "path", "idx"))
    return sm.label_counts(sm.long_labels(back))


@query(f"WITH {ART} SELECT article_id::VARCHAR AS example_id, len(tokens)::BIGINT AS n, array_to_string(tokens, ' ') AS text, NULL::VARCHAR AS category FROM art")
def stable_jsonl(spark, sf_dir):
    """IO3 IO4 IO9: the stable columns as sorted JSON lines and back."""
    path = shared_dir(spark, "jsonl")
    rows = fx.articles(spark, sf_dir).select(F.col("article_id").cast("string").alias("example_id"), "tokens")
    jsonl.write_stable(rows, path)
    back = jsonl.read_jsonl(spark, path, "example_id string, tokens array<string>, labels string, checksum string, variant string, category string")
    return back.select("example_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("text"), "category")


@query(f"WITH {LEX} SELECT name FROM lex")
def lexicon_file(spark, sf_dir):
    """IO20: a lexicon of one name a line."""
    path = shared_dir(spark, "lexicon")
    fx.lexicon(spark, sf_dir).select(F.explode(F.array("name", F.lit(" "), F.lit("# remark"), "name")).alias("value")).write.text(path)
    return config.read_lexicon(spark, path)


def _write_splits(spark, sf_dir, path: str) -> None:
    """``splits.json`` of three lineages of one task: one of the old layout, one with an article too many, one equal to the first."""
    rows = _assigned(spark, sf_dir).select(F.col("article_id").cast("string").alias("id"), "split")
    per = rows.groupBy("split").agg(F.array_sort(F.collect_list("id")).alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("m"))
    ids = {split: F.coalesce(F.try_element_at("m", F.lit(split)), F.array().cast("array<string>")) for split in ("train", "test", "eval")}
    first, rest = lambda x: F.slice(x, 1, 1), lambda x: F.slice(x, F.lit(2), F.size(x))
    documents = {
        "set1": F.struct(F.col("m").alias("split_checksums")),
        "set2": F.struct(ids["train"].alias("train_checksums"), F.concat(ids["test"], first(ids["train"])).alias("test_checksums"), F.struct(rest(ids["eval"]).alias("eval")).alias("eval_checksums")),
        "set3": F.struct(F.struct(rest(ids["train"]).alias("train"), ids["test"].alias("test"), first(ids["eval"]).alias("eval")).alias("split_checksums")),
    }
    of = [F.struct(F.lit(f"profiles/p1/task1/{lineage}/splits.json").alias("name"), F.to_json(value).alias("value")) for lineage, value in documents.items()]
    jsonl.write_named(per.select(F.explode(F.array(*of)).alias("x")).select("x.*"), path)


@query(f"""WITH {_SPLIT}, a AS (SELECT article_id::VARCHAR AS id, split FROM asg), o AS (SELECT split, min(id) AS id FROM a GROUP BY 1),
m AS (SELECT 'set1' AS lineage, split, id FROM a UNION ALL SELECT 'set2', split, id FROM a WHERE split <> 'eval' OR id <> (SELECT id FROM o WHERE split = 'eval') UNION ALL SELECT 'set2', 'test', id FROM o WHERE split = 'train'
  UNION ALL SELECT 'set3', split, id FROM a WHERE split = 'test' OR split = 'train' AND id <> (SELECT id FROM o WHERE split = 'train') UNION ALL SELECT 'set3', split, id FROM o WHERE split = 'eval')
SELECT 'p1' AS profile, 'task1' AS task, lineage, split, id AS article_id FROM m""")
def split_files(spark, sf_dir):
    """IO14: the splits of all lineages under a results root, in either layout."""
    path = shared_dir(spark, "results")
    _write_splits(spark, sf_dir, path)
    return results.read_splits(spark, path)


@query("""SELECT * FROM (VALUES ('p1', 'task1', 'split_overlap', 'set2', '1 articles in train and test'), ('p1', 'task1', 'equal_splits', 'set1,set2', 'same articles in split train'),
('p1', 'task1', 'equal_splits', 'set1,set3', 'same articles in split test'), (NULL, NULL, 'requested_task_missing', 'task9', 'the results root has no such task')) v(profile, task, "check", context, message)""")
def claims_root(spark, sf_dir):
    """C8 IO14: the split claims of a results root, requested tasks included."""
    path = shared_dir(spark, "results")
    _write_splits(spark, sf_dir, path)
    return commands.verify_root(spark, path, tasks=("task1", "task9"))


_RULES = {"qa": {"rules": [{"name": "german", "pattern": "de/*", "require_categories": "de, en", "max_tokens": 900}, {"pattern": "*/s[0-4]*", "require_raw_types": ["even", "odd"]}]}}


def _sets(spark, sf_dir):
    d = fx.articles(spark, sf_dir).join(fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "lang"), "article_id")
    path = F.concat("lang", F.lit("/s"), (F.col("article_id") % 7).cast("string"), F.lit(".set"))
    types = F.when(F.col("article_id") % 7 == 3, F.array(F.lit("odd"))).otherwise(F.array(F.when(F.col("article_id") % 2 == 0, "even").otherwise("odd")))
    labels = F.when(F.col("article_id") % 101 == 0, F.slice("tokens", 2, 100_000)).otherwise(F.col("tokens"))
    return d.select(path.alias("path"), "tokens", labels.alias("labels"), F.col("lang").alias("category"), types.alias("types_raw"))


_QA = f"""{ART}, s AS (SELECT lang || '/s' || (article_id % 7) || '.set' AS path, lang, article_id, len(tokens) AS n, CASE WHEN article_id % 101 = 0 THEN greatest(len(tokens) - 1, 0) ELSE len(tokens) END AS m,
  CASE WHEN article_id % 7 <> 3 AND article_id % 2 = 0 THEN 'even' ELSE 'odd' END AS t FROM art JOIN documents d ON d.doc_id = art.article_id),
p AS (SELECT path, lang, CASE WHEN lang = 'de' THEN 'german' WHEN regexp_matches(path, '/s[0-4]') THEN 'rule_2' ELSE 'default' END AS rule, count(*) AS n_examples, sum(m)::BIGINT AS n_tokens, max(n) AS most, count(*) FILTER (n <> m) AS bad, list(DISTINCT t) AS types FROM s GROUP BY 1, 2),
r AS (SELECT path, rule, n_examples, n_tokens, array_to_string(list_filter([CASE WHEN bad > 0 THEN 'token_label_length_mismatch:' || bad END,
  CASE WHEN rule = 'german' AND most > 900 THEN 'max_tokens_exceeded:' || most || '>900' WHEN rule = 'default' AND most > 1500 THEN 'max_tokens_exceeded:' || most || '>1500' END,
  CASE WHEN rule = 'german' THEN 'missing_required_category:en' END, CASE WHEN rule = 'rule_2' AND NOT list_contains(types, 'even') THEN 'missing_required_raw_type:even' END,
  CASE WHEN rule = 'rule_2' AND NOT list_contains(types, 'odd') THEN 'missing_required_raw_type:odd' END], lambda x: x IS NOT NULL), ',') AS errors FROM p)"""


def _qa(spark, sf_dir):
    return sm.qa_report(_sets(spark, sf_dir), config.qa_rules(spark, _RULES), {"max_tokens": 1500})


@query(f"WITH {_QA} SELECT *, errors = '' AS ok FROM r")
def qa_report(spark, sf_dir):
    """A3 IO19: every set under its first matching rule, with its failed checks."""
    return _qa(spark, sf_dir).withColumn("errors", F.array_join("errors", ","))


@query(f"WITH {_QA} SELECT count(*) AS n_sets, count(*) FILTER (errors = '') AS n_ok, count(*) FILTER (errors <> '') AS n_failed, sum(n_examples)::BIGINT AS n_examples, sum(n_tokens)::BIGINT AS n_tokens, coalesce(string_agg(path, ',' ORDER BY path) FILTER (errors <> ''), '') AS failed_sets FROM r")
def qa_totals(spark, sf_dir):
    """A3: totals of a QA report and its failed sets."""
    return sm.qa_totals(_qa(spark, sf_dir)).withColumn("failed_sets", F.array_join("failed_sets", ","))


@query(f"""WITH {RUNS} SELECT 'runs/' || model_id || '/' || "set" || '/seed_' || ord || '/' || train_variant AS run, "set", seed, model_id, train_variant, eval_set, (epoch + 1)::INT AS effective_epoch,
  round(loss, 9) AS loss, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM runs""")
def run_files(spark, sf_dir):
    """IO15: the ``metrics.json`` documents of all runs, one a row of the table: final values, the effective epoch from the epoch entries.

    The documents are lines that name their run, since a folder for each of millions of
    rows would be listed by the driver; ``run_validation_folders`` writes and reads folders.
    """
    path = shared_dir(spark, "runs")
    point = [F.col(m) for m in ("precision", "recall", "f1", "loss")]
    epochs = F.transform(F.sequence(F.lit(1), F.col("epoch") + 1), lambda e: F.struct((e + F.lit(0.0)).alias("epoch"), *point))
    metrics = F.create_map("eval_set", F.struct(*point, epochs.alias("per_epoch")))
    run = F.concat_ws("/", F.lit("runs"), "model_id", "set", F.concat(F.lit("seed_"), F.col("ord").cast("string")), "train_variant")
    document = F.to_json(F.struct(run.alias("run"), "task", "set", "seed", "model_id", "train_variant", "eval_split", metrics.alias("metrics")))
    fx.run_metrics(spark, sf_dir).select(document.alias("value")).write.text(path)
    back = runs.read_metrics(spark, path, name="*.txt", lines=True)
    return back.select("run", "set", "seed", "model_id", "train_variant", "eval_set", "effective_epoch", *(F.round(m, 9).alias(m) for m in ("loss", "precision", "recall", "f1")))


@query(f"""WITH {_ROWS}, o AS (SELECT l_orderkey, string_agg(t, ' ' ORDER BY l_linenumber, t, label) AS text, string_agg(label, ' ' ORDER BY l_linenumber, t, label) AS labels, max(label) AS category FROM lb GROUP BY 1),
n AS (SELECT *, l_orderkey % 4 AS k, (row_number() OVER (PARTITION BY l_orderkey % 4 ORDER BY l_orderkey) - 1)::INT AS idx FROM o)
SELECT 'task1' AS task, 'set' || k AS "set", 'train' AS split, 'all' AS variant, idx, CASE WHEN k = 3 THEN printf('ex_%08d', idx) ELSE l_orderkey::VARCHAR END AS example_id, text, labels, CASE WHEN k < 3 THEN category END AS category FROM n""")
def sets_with_metadata(spark, sf_dir):
    """IO2 IO7 IO8 IO13: orders as four example sets, three of them with metadata, found and read back with it."""
    path = shared_dir(spark, "sets")
    o = _orders(spark, sf_dir).withColumn("at", F.col("example_id").cast("bigint"))
    name = lambda end: F.concat(F.lit("task1/set"), (F.col("at") % 4).cast("string"), F.lit(f"/train/all{end}")).alias("name")
    jsonl.write_named(o.select(name(".set"), F.concat(conll.conll_text(F.col("tokens"), F.col("labels")), F.lit("\n")).alias("value"), "at"), path, "at")
    meta = F.to_json(F.struct("example_id", F.array_max("labels").alias("category")))
    jsonl.write_named(o.where("at % 4 < 3").select(name(".meta.jsonl"), meta.alias("value"), "at"), path, "at")
    key = lambda stem: F.substring_index(stem, "/", -4).alias("key")
    found = jsonl.discover_sets(spark, path).withColumn("key", key(F.regexp_replace("path", r"\.set$", ""))).drop("path")
    back = jsonl.with_metadata(spark, path).drop("variant").withColumn("key", key(F.col("stem")))
    return back.join(jsonl.few(found), "key").select("task", "set", "split", "variant", "idx", "example_id", F.array_join("tokens", " ").alias("text"), F.array_join("labels", " ").alias("labels"), "category")
