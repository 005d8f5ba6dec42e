"""Operators on literal rows that show their edge cases, against the rows that SQL or the case states."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

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
from loomtext.plans.augmentation import _BARRED, _PERMITTED, _RAW, _SPECS, SEED, _license_sql
from loomtext.plans.registry import SENT
from loomtext.sources import jsonl
from loomtext.sources.attribution import parse_attribution

EDGES = {}


def edge(sql):
    def add(f):
        EDGES[f.__name__] = (f, sql)
        return f

    return add


_FIT = [(i, s, e, f) for i, (s, e, f) in enumerate([(0, 9, 0), (0, 9, 9), (0, 9, 4), (0, 9, 5), (0, 20, 7), (5, 6, 5), (3, 3, 3), (0, 30, 29), (10, 50, 30)])]


_RAWS = ", ".join(f"({i}, '{r}')" for i, r in enumerate(_RAW))


@edge(f"""WITH RECURSIVE w AS (
  SELECT * FROM (VALUES {", ".join(map(str, _FIT))}) v(id, s, e, focus)
  UNION ALL SELECT id, CASE WHEN e - focus > focus - s THEN s ELSE s + 1 END, CASE WHEN e - focus > focus - s THEN e - 1 ELSE e END, focus FROM w WHERE s < e AND e - s + 1 > 6)
SELECT id, s, e FROM w WHERE e - s + 1 <= 6""")
def window_fit(spark, sf_dir):
    """Windows trimmed around their focus, in closed form."""
    d = spark.createDataFrame(_FIT, "id int, s int, e int, focus int")
    return d.select("id", wn.fitted(F.col("s"), F.col("e"), F.col("focus"), 6).alias("w")).select("id", "w.s", "w.e")


@edge("""SELECT * FROM (VALUES (1, 'A (b) c-d, 50% x.', 'A (b (B-X)) c-d, 50% x.'), (2, 'it''s "$5', 'it (B-Y)''s "$5'), (3, 'a/b [c]', 'a/b [c (I-Z)]')) v(id, plain, inline)""")
def rendering(spark, sf_dir):
    """Readable text with and without labels."""
    rows = [
        (1, ["A", "(", "b", ")", "c", "-", "d", ",", "50", "%", "x", "."], ["O", "O", "B-X", *["O"] * 9]),
        (2, ["it", "'s", '"$5'], ["B-Y", "O", "O"]),
        (3, ["a", "/", "b", "[", "c", "]"], ["O", "O", "O", "O", "I-Z", "O"]),
    ]
    d = spark.createDataFrame(rows, "id int, tokens array<string>, labels array<string>")
    return d.select("id", lb.spaced(F.col("tokens")).alias("plain"), lb.inline_labels(F.col("tokens"), F.col("labels")).alias("inline"))


@edge(f"SELECT id, {_license_sql('raw')} AS license_id FROM (VALUES {_RAWS}) v(id, raw)")
def licence_normalise(spark, sf_dir):
    """L4: licence ids of free texts."""
    d = spark.createDataFrame(list(enumerate(_RAW)), "id int, raw string")
    return d.select("id", tx.license_id(F.col("raw")).alias("license_id"))


@edge(f"""WITH n AS (SELECT id, {_license_sql('raw')} AS license_id FROM (VALUES {_RAWS}) v(id, raw)), u AS (SELECT *, upper(trim(license_id)) AS lid FROM n)
SELECT id, lid LIKE '%-ND%' OR ({_PERMITTED} AND lid NOT IN ('MIT', 'CC0-1.0')) AS attribution_required, {_PERMITTED} AS redistribution_allowed, {_PERMITTED} AS derivative_allowed,
  CASE WHEN {_BARRED} THEN 'disallowed' WHEN {_PERMITTED} THEN 'allowed' ELSE 'unknown' END AS policy_status FROM u""")
def licence_flags(spark, sf_dir):
    """Policy flags of licence ids."""
    d = spark.createDataFrame(list(enumerate(_RAW)), "id int, raw string")
    return d.select("id", tx.license_flags(tx.license_id(F.col("raw"))).alias("f")).select("id", "f.*")


@edge("""SELECT * FROM (VALUES ('aabbccdd11', 'CC-BY-4.0'), ('aabbccdd22', 'MIT'), ('aabbccdd33', 'CC0-1.0'), ('aabbccdd44', 'UNKNOWN'), ('aabbccdd55', 'CC-BY-NC-4.0'), ('aabbccdd66', 'CC-BY-SA-4.0')) v(checksum, license_id)""")
def attribution_parse(spark, sf_dir):
    """IO18: block and tabular attribution lines."""
    text = "\n".join([
        "checksum: aabbccdd11", "licence: CC BY 4.0", "", "aabbccdd22,mit", "aabbccdd33  cc0 dedication", "", "sha256 = aabbccdd44", "checksum: aabbccdd55",
        "is obtained by the following licence: Creative Commons non-commercial", "", "just words here", "aabbccdd66;CC BY-SA 4.0",
    ])
    return parse_attribution(spark.createDataFrame([("a", text)], "path string, value string")).select("checksum", "license_id")


@edge("SELECT * FROM (VALUES ('train', 8), ('test', 2), ('eval', 1)) v(split, n)")
def split_apportion(spark, sf_dir):
    """Largest remainders."""
    return spark.createDataFrame(list(st.apportion(11, _SPECS).items()), "split string, n int")


@edge("""SELECT id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug, left(sha1(t), 8) AS profile, xor(42::BIGINT, ('0x' || left(sha1(t), 8))::BIGINT) AS seed
FROM (SELECT id, t, left(regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS s FROM (VALUES (1, ' Hello, World! '), (2, '---'), (3, 'Model/Name_v1.0')) v(id, t)) x""")
def identifiers(spark, sf_dir):
    """Slugs, stable seeds, short labels."""
    d = spark.createDataFrame([(1, " Hello, World! "), (2, "---"), (3, "Model/Name_v1.0")], "id int, t string")
    return d.select("id", tx.slug(F.col("t")).alias("slug"), tx.profile_label(F.col("t")).alias("profile"), tx.stable_seed(42, F.col("t")).alias("seed"))


@edge("""SELECT * FROM (VALUES ('a', 'token_label_length_mismatch:2'), ('a', 'max_tokens_exceeded:4>3'), ('a', 'missing_required_category:irrelevant'), ('a', 'missing_required_raw_type:ZZ'),
  ('a', 'example_meta_length_mismatch:2!=1'), ('b', 'token_label_length_mismatch:2'), ('b', 'missing_required_raw_type:ZZ')) v(name, error)""")
def validate_sets(spark, sf_dir):
    """A2: failed checks with and without metadata."""
    ex = spark.createDataFrame([("1", ["a", "b", "c", "d"], ["O", "B-X", "O", "O"]), ("2", ["a"], ["O", "O"])], "example_id string, tokens array<string>, labels array<string>")
    meta = spark.createDataFrame([("relevant", None, None, ["X"], [])], "category string, reason string, forced_relevant boolean, types_raw array<string>, types_pooled array<string>")
    a = sm.validate(ex, meta, max_tokens=3, required_categories=("relevant", "irrelevant"), required_raw_types=("X", "ZZ"))
    b = sm.validate(ex, required_categories=("O-only",), required_raw_types=("X", "ZZ"))
    return a.select(F.lit("a").alias("name"), "error").unionByName(b.select(F.lit("b").alias("name"), "error"))


@edge("""SELECT * FROM (VALUES ('t1/set1/train/all.set', 'train'), ('t1/set1/test/none.set', 'tests'), ('t2/x.conll', NULL), ('t1/set2/train/none.set', 'train'), ('q.set', 'one')) v(path, rule)""")
def qa_rules(spark, sf_dir):
    """A3: the first rule whose glob matches; a star crosses slashes."""
    sets = spark.createDataFrame([("t1/set1/train/all.set",), ("t1/set1/test/none.set",), ("t2/x.conll",), ("t1/set2/train/none.set",), ("q.set",)], "path string")
    rules = spark.createDataFrame([(0, "train", "*/train/*.set"), (1, "tests", "t?/*[!x].set"), (2, "one", "[pq].set"), (3, "late", "*.set")], "ord int, name string, pattern string")
    return sm.first_rule(sets, rules)


@edge("SELECT * FROM (VALUES ('exclusion', 'e1', '1 values claimed only'), ('exclusion', 'e1', '2 values missing'), ('calibration_test', 's/test', '1 values missing'), ('calibration_train', 's/train', '1 values claimed only')) v(\"check\", context, message)")
def claims_sets(spark, sf_dir):
    """Exclusion lists and calibration splits as sets."""
    a = spark.createDataFrame([("e1", "x"), ("e1", "y"), ("e2", "z")], "context string, value string")
    b = spark.createDataFrame([("e1", "y"), ("e1", "u"), ("e1", "v"), ("e2", "z"), ("e2", "z")], "context string, value string")
    main = spark.createDataFrame([("s", "train", "1"), ("s", "train", "2"), ("s", "train", "9"), ("s", "test", "3")], "lineage string, split string, article_id string")
    cal = spark.createDataFrame([("s", "train", "1"), ("s", "eval", "2"), ("s", "test", "3"), ("s", "test", "4")], "lineage string, split string, article_id string")
    return cl.set_differences(a, b, "exclusion").unionByName(cl.calibration_relation(main, cal))


@edge("""SELECT * FROM (VALUES ('r1', '', true), ('r2', 'missing_state,missing_metrics,missing_eval_set:a,missing_eval_set:u', false), ('r3', 'status:failed,signature_mismatch,metrics_hash_mismatch,identity_mismatch:seed,missing_eval_set:u,collapsed:a', false), ('r4', 'missing_metric:u', false)) v(run, errors, ok)""")
def run_validation(spark, sf_dir):
    """Failed checks of run directories."""
    ident = "task string, `set` string, seed int, model_id string, train_variant string"
    specs = spark.createDataFrame([(f"r{i}", f"g{i}", "t", "s", 1, "m", "all") for i in (1, 2, 3, 4)], f"run string, signature string, {ident}")
    states = spark.createDataFrame([("r1", "completed", "g1", "h1"), ("r3", "failed", "zz", "h9"), ("r4", "completed", "g4", "h4")], "run string, status string, signature string, metrics_sha256 string")
    rows = [("r1", "h1", 1, "a", 0.5), ("r1", "h1", 1, "u", 0.5), ("r3", "h3", 2, "a", 0.0), ("r4", "h4", 1, "a", 0.4), ("r4", "h4", 1, "u", None)]
    m = spark.createDataFrame([(r, h, "t", "s", s, "m", "all", e, v, v, v, 1.0) for r, h, s, e, v in rows], f"run string, metrics_sha256 string, {ident}, eval_set string, precision double, recall double, f1 double, loss double")
    return cl.validate_runs(specs, states, m, eval_sets=("a", "u")).withColumn("errors", F.array_join("errors", ","))


@edge("SELECT * FROM (VALUES ('asset', 'y', 'differs'), ('asset', 'z', 'missing'), ('signature', 'lr', NULL), ('signature', 'seed', NULL)) v(kind, key, status)")
def signature_and_assets(spark, sf_dir):
    """Signatures compared key by key; asset hashes against a manifest."""
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    s = cl.signature_mismatches(kv([("lr", "1"), ("seed", "2"), ("model", "m")]), kv([("lr", "2"), ("model", "m")]))
    h = lambda rows: spark.createDataFrame(rows, "asset string, sha256 string")
    a = cl.manifest_mismatches(h([("x", "1"), ("y", "2"), ("z", "3")]), h([("x", "1"), ("y", "9")]))
    return s.select(F.lit("signature").alias("kind"), "key", F.lit(None).cast("string").alias("status")).unionByName(a.select(F.lit("asset").alias("kind"), F.col("asset").alias("key"), "status"))


@edge("SELECT * FROM (VALUES ('t1', 's1', 'all', 't1/test/b.set'), ('t1', 's1', 'none', 't1/s1/train/none.set'), ('t1', 's1', 'none', 't1/test/b.set')) v(task, \"set\", train_variant, path)")
def missing_artifacts(spark, sf_dir):
    """Files that jobs need and a listing lacks."""
    jobs = spark.createDataFrame([("t1", "s1", v, "test", ["a", "b"], seed) for v in ("all", "none") for seed in (1, 2)], "task string, `set` string, train_variant string, eval_split string, eval_sets array<string>, seed int")
    return cl.missing_artifacts(jobs, spark.createDataFrame([("t1/s1/train/all.set",), ("t1/test/a.set",)], "path string"))


@edge("SELECT * FROM (VALUES ('O', 'B-X'), ('B-X', 'O')) v(y_true, y_pred)")
def argmax_labels(spark, sf_dir):
    """Labels of the highest scores, ignored positions skipped, the first of ties."""
    d = spark.createDataFrame([([[0.1, 0.9], [0.5, 0.5], [0.3, 0.2]], [0, 1, -100], ["O", "B-X"])], "s array<array<double>>, y array<int>, names array<string>")
    return d.select(F.explode(me.argmax_labels(F.col("s"), F.col("y"), F.col("names"))).alias("x")).select("x.y_true", "x.y_pred")


@edge("SELECT * FROM (VALUES (1, 2, true), (2, 4, true), (3, NULL, true), (4, NULL, false), (5, 7, false)) v(id, epoch, kept)")
def epoch_parse(spark, sf_dir):
    """Epochs rounded half to even, lenient metrics."""
    d = spark.createDataFrame([(1, "1.5", "0.5"), (2, "3.5", "1"), (3, "0", "0.1"), (4, "x", "nan"), (5, "7", "bad")], "id int, e string, m string")
    for c in rp.METRICS:
        d = d.withColumn(c, F.col("m"))
    kept = rp.lenient_metrics(d).select("id", F.lit(True).alias("kept"))
    return d.select("id", rp.parse_epoch(F.col("e")).alias("epoch")).join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@edge("SELECT metric, CASE WHEN metric = 'loss' THEN 0.5 ELSE 50.0 END::DOUBLE AS value FROM (VALUES ('precision'), ('recall'), ('f1'), ('loss')) v(metric)")
def metric_scale(spark, sf_dir):
    """Percent for all metrics but the loss."""
    return spark.createDataFrame([(m, 0.5) for m in ("precision", "recall", "f1", "loss")], "metric string, value double").select("metric", tx.percent(F.col("metric"), F.col("value")).alias("value"))


@edge("SELECT t AS task, s AS \"set\", m AS model, 'tok' AS tokenizer, 510 AS max_length, d AS seed, v AS train_variant, 'test' AS eval_split, 'a,u' AS eval_sets, 'runs/' || m || '/' || s || '/seed_' || d || '/' || v AS run_dir FROM (VALUES ('t1'), ('t2')) a(t), (VALUES ('set1'), ('set2')) b(s), (VALUES ('m1'), ('m2')) c(m), (VALUES (1), (2), (3)) e(d), (VALUES ('none'), ('all')) f(v)")
def job_matrix(spark, sf_dir):
    """Cross product of tasks, sets, models, seeds and variants."""
    models = spark.createDataFrame([("m1", "tok", 510), ("m2", "tok", 510)], "model string, tokenizer string, max_length int")
    j = mx.run_dir(mx.job_matrix(["t1", "t2"], ["set1", "set2"], models, [1, 2, 3], ["none", "all"], eval_sets=["a", "u"]))
    return j.withColumn("eval_sets", F.array_join("eval_sets", ","))


@edge("SELECT * FROM (VALUES (1, 'lr', '3e-5'), (1, 'epochs', '4'), (1, 'batch', '8'), (2, 'lr', '2e-5'), (2, 'epochs', '6'), (2, 'batch', '8')) v(job_id, name, value)")
def hparam_precedence(spark, sf_dir):
    """The most specific level that states a parameter wins."""
    t = lambda rows: spark.createDataFrame(rows, "job_id int, name string, value string")
    jobs = spark.createDataFrame([(1,), (2,)], "job_id int")
    return mx.resolve_hparams(jobs, [t([(1, "lr", "3e-5")]), t([(1, "lr", "9e-5"), (1, "epochs", "4")]), t([(1, "epochs", "6"), (2, "epochs", "6")])], {"lr": "2e-5", "epochs": "8", "batch": "8"})


@edge("SELECT * FROM (VALUES ('all', 'a*', 'x'), ('species', 'speci??', 'y'), ('none', '*', 'z')) v(train_variant, pattern, params)")
def variant_pattern(spark, sf_dir):
    """The longest matching glob wins."""
    jobs = spark.createDataFrame([("all",), ("species",), ("none",)], "train_variant string")
    return mx.variant_pattern(jobs, spark.createDataFrame([("*", "z"), ("a*", "x"), ("speci??", "y"), ("s*", "w")], "pattern string, params string"))


@edge("SELECT * FROM (VALUES (1, '-100,0,-100,1,-100'), (2, '1')) v(id, labels)")
def subword_alignment(spark, sf_dir):
    """Labels of subwords."""
    d = spark.createDataFrame([(1, [None, 0, 0, 1, None], ["O", "B-X"]), (2, [0], ["B-X"])], "id int, w array<int>, x array<string>")
    ids = F.create_map(F.lit("O"), F.lit(0), F.lit("B-X"), F.lit(1))
    return d.select("id", F.array_join(F.transform(lb.align_subwords(F.col("w"), F.col("x"), ids), lambda v: v.cast("string")), ",").alias("labels"))


@edge("SELECT * FROM (VALUES (1, '1,2,0'), (2, '1,2,3'), (3, '5')) v(id, ids)")
def padding(spark, sf_dir):
    """Arrays filled up to the longest of their batch."""
    d = spark.createDataFrame([(1, 0, [1, 2]), (2, 0, [1, 2, 3]), (3, 1, [5])], "id int, batch int, ids array<int>")
    return mx.padded(d, "ids", 0, "batch").select("id", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


_EDGE = [(1, "a b. Fig. c ]. d"), (2, "x. yy. al. Sp. z"), (3, "no end"), (4, "."), (5, "]."), (6, "E.G. is no end. but this is")]


_CLASSES = [
    (1, "B-NEG B-POS", "relevant", True, "negative_and_other"), (2, "B-POS O", "relevant", False, "has_non_negative_label"), (3, "B-NEG B-RAW", "relevant", True, "negative_and_raw_other"),
    (4, "B-RAW", "relevant", False, "has_raw_label_only"), (5, "O B-NEG", "irrelevant", False, "no_non_negative_labels"), (6, "O X B-", "relevant", False, "has_raw_label_only"),
]


@edge(rf"""WITH art AS (SELECT a AS article_id, string_split(t, ' ') AS tokens FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in _EDGE)}) v(a, t)),
tok AS (SELECT article_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS pos FROM art), {SENT} SELECT article_id, s, e FROM sent""")
def sentence_bounds_edge(spark, sf_dir):
    """Short tokens, brackets, abbreviations in any case, a text without end."""
    a = spark.createDataFrame(_EDGE, "article_id int, t string").select("article_id", F.split("t", " ").alias("tokens"))
    return a.select("article_id", F.explode(wn.sentences(F.col("tokens"))).alias("x")).select("article_id", "x.s", "x.e")


@edge("""SELECT * FROM (VALUES ('plain', 'O B-SPEC B-STRA O O'), ('null map', 'O B-SPEC B-STRA O O'), ('empty map', 'O O O O O'), ('mapped', 'O B-ORG I-ORG O O')) v(name, labels)""")
def bio_labels_overlap(spark, sf_dir):
    """Later spans overwrite; an empty map turns all to O, a null map nothing."""
    a = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"])], "article_id int, tokens array<string>")
    m = a.select("article_id", F.expr("map('species/x', array('1+2'), 'strain', array('2+1'))").alias("curation"))
    own = sp.spans_from_map(m)
    out = None
    for name, mapping in (("plain", None), ("null map", None), ("empty map", {}), ("mapped", {"SPEC": "ORG"})):
        r = sp.bio_labels(a, own, mapping).select(F.lit(name).alias("name"), F.array_join("labels", " ").alias("labels"))
        out = r if out is None else out.unionByName(r)
    return out


@edge(f"SELECT * FROM (VALUES {', '.join(f'({i}, {c!r}, {f}, {r!r})' for i, _, c, f, r in _CLASSES)}) v(id, category, forced_relevant, reason)")
def classify_edge(spark, sf_dir):
    """Each of the five reasons, and the empty type."""
    d = spark.createDataFrame([(i, x.split(" ")) for i, x, *_ in _CLASSES], "id int, labels array<string>")
    c = lb.classify(F.col("labels"), _map({"NEG": "NEG", "POS": "POS"}), F.array(F.lit("NEG")))
    return d.select("id", c.alias("c")).select("id", "c.category", "c.forced_relevant", "c.reason")


@edge("SELECT * FROM (VALUES ('E', 'coli', 'Escherichia coli', 'E. coli', false, 'Escherichia coli'), ('B', 'cereus', '', 'B. cereus', true, 'B. cereus'), ('S', 'aureus', 'Staph aureus,Staphylococcus aureus', '', false, 'Staph aureus')) v(initial, epithet, full_forms, abbreviations, orphan_abbreviation, representative)")
def lexicon_key_index_edge(spark, sf_dir):
    """L1 L3: orphan abbreviations, several full forms, phrases that don't match."""
    rows = [(1, "Escherichia coli"), (2, "E. coli"), (3, "B. cereus"), (4, "Staphylococcus aureus"), (5, "Staph aureus"), (6, "not a name")]
    a = spark.createDataFrame([(i, t.split(" ")) for i, t in rows], "article_id int, tokens array<string>")
    s = spark.createDataFrame([(i, i, "SPEC/x", "SPEC", 0, len(t.split(" "))) for i, t in rows], "article_id int, ord int, source_key string, label4 string, start int, length int")
    k = lx.lexicon_keys(lx.extract_lexicon(a, s))
    return k.select("initial", "epithet", F.array_join("full_forms", ",").alias("full_forms"), F.array_join("abbreviations", ",").alias("abbreviations"), "orphan_abbreviation", "representative")


@edge("SELECT * FROM (VALUES (1, 'b a'), (2, 'y-x'), (3, '$1 q')) v(id, out)")
def replace_one_pass(spark, sf_dir):
    """No cascades, longest key first, keys with special characters."""
    d = spark.sql("SELECT * FROM VALUES (1, 'a b', map('a', 'b', 'b', 'a')), (2, 'ab-a', map('a', 'x', 'ab', 'y')), (3, 'a.c q', map('a.c', '$1', 'a', 'z')) v(id, t, m)")
    return d.select("id", tx.replace_all(F.col("t"), F.col("m")).alias("out"))


@edge("SELECT * FROM (VALUES (1, true, 'a1'), (2, false, NULL)) v(id, exhausted, scrambled)")
def scramble_reserved(spark, sf_dir):
    """When every permutation hits a reserved phrase the text stays; else the first free one is taken."""
    d = spark.createDataFrame([(1, "a1", ["strain"]), (2, "b7", ["b7"])], "id int, text string, phrases array<string>")
    reserved = spark.createDataFrame([("strain",)], "phrase string")
    r = va.scramble(d, SEED, reserved=reserved, id_col="id")
    return r.select("id", "exhausted", F.when(F.col("id") == 1, F.col("scrambled")).alias("scrambled"))


@edge("SELECT * FROM (VALUES (1, 'K12 b,B7'), (2, '')) v(id, present)")
def phrases_present(spark, sf_dir):
    """Phrases that stand in a text as whole words, long ones first."""
    d = spark.createDataFrame([(1, "x K12 b B7", ["B7", "K12 b", "K1", ""]), (2, "none", ["B7"])], "id int, t string, p array<string>")
    return d.select("id", F.array_join(tx.phrases_present(F.col("t"), F.col("p")), ",").alias("present"))


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(EDGES))
def test_edge(spark, name):
    run, sql = EDGES[name]
    got = run(spark, None)
    cols = sorted(got.columns)
    cursor = duckdb.connect().execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = [[plain(row[names.index(c)]) for c in cols] for row in cursor.fetchall()]
    assert sorted(map(repr, ([plain(r[c]) for c in cols] for r in got.collect()))) == sorted(map(repr, want))


def test_apportioned_equals_apportion(spark):
    sizes = spark.createDataFrame([(n,) for n in range(60)], "n bigint")
    got = {(r["n_total"], r["split"]): r["n_articles"] for r in st.apportioned(sizes.withColumn("n_total", F.col("n")), _SPECS, "n_total").collect()}
    assert got == {(n, s): c for n in range(60) for s, c in st.apportion(n, _SPECS).items()}


def test_long_derived_rows(spark):
    """Arrays that are computed from a text are bound once, so long rows take linear time."""
    words = ["(", "ab", ")", "x", "7", ","] * 20_000
    d = spark.createDataFrame([(" ".join(words),)], "text string").select(F.split("text", " ").alias("t"))
    d = d.withColumn("l", F.transform("t", lambda x: F.when(x == "7", "B-N").otherwise("O")))
    ids = F.create_map(F.lit("O"), F.lit(0), F.lit("B-N"), F.lit(1))
    row = d.select(lb.spaced(F.col("t")).alias("a"), lb.inline_labels(F.col("t"), F.col("l")).alias("b"), lb.align_subwords(F.transform("t", lambda x, i: (i / 2).cast("int")), F.col("l"), ids).alias("c")).first()
    assert row["a"] == " ".join(["(ab) x 7,"] * 20_000)
    assert row["b"] == " ".join(["(ab) x 7 (B-N),"] * 20_000)
    assert row["c"] == [v for i in range(60_000) for v in (int(words[i] == "7"), -100)]


def test_numbered_lines_over_byte_ranges(spark, tmp_path):
    """Numbers don't depend on the byte ranges; blank lines have none; a name with special characters is written as it is."""
    rows = [(f"a b/x={k}.meta.jsonl", f'{{"k": {k}, "i": {i}}}' + ("\n  " if i % 3 == 0 else ""), i) for k in range(2) for i in range(300)]
    jsonl.write_named(spark.createDataFrame(rows, "name string, value string, i int"), str(tmp_path), "i")
    assert sorted(p.name for p in (tmp_path / "a b").iterdir() if not p.name.startswith(".")) == ["x=0.meta.jsonl", "x=1.meta.jsonl"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        lines = jsonl.numbered_lines(spark, str(tmp_path), "*.meta.jsonl")
        ranges = spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct()
        assert ranges.count() > 10
        got = lines.select("idx", F.get_json_object("value", "$.i").cast("int").alias("i"), F.get_json_object("value", "$.k").alias("k")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 600 and all(r.idx == r.i for r in got) and {r.k for r in got} == {"0", "1"}
