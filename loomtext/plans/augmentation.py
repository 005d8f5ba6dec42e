"""Queries over substitution, scrambling, variants, licences, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext import fixtures as fx
from loomtext.functions import text as tx
from loomtext.operators import lexicon as lx
from loomtext.operators import licences as lc
from loomtext.operators import sampling as sa
from loomtext.operators import spans as sp
from loomtext.operators import splits as st
from loomtext.operators import variants as va
from loomtext.operators import windows as wn
from loomtext.plans.annotation import COUNTERS, examples_sql
from loomtext.plans.registry import LEX, SPANS, SPECIES, classify_sql, md5, md5_int, query
from loomtext.shared import materialise

SEED = 7


def _class_sql(key: str, force: bool = False) -> tuple[str, str]:
    sources, targets = [], []
    for chars in tx.CLASSES:
        own = sorted(set(chars) - set(tx.SKIPPED))
        arr = "[" + ", ".join(f"'{c}'" for c in own) + "]"
        mixed = f"list_transform(list_sort(list_transform({arr}, lambda c: md5(concat_ws(':', '{SEED}:perm', {key}, c)) || c)), lambda c: substr(c, 33))"
        targets.append(f"array_to_string({mixed}, '')")
        sources.append(f"array_to_string(list_concat(list_slice({mixed}, 2, {len(own)}), list_slice({mixed}, 1, 1)), '')" if force else f"'{''.join(own)}'")
    return " || ".join(sources), " || ".join(targets)


_CONSERVED = "(" + ", ".join(f"'{c}'" for c in tx.CONSERVED) + ")"


def _scrambled_sql(phrase: str, source: str, target: str) -> str:
    """SQL of a scrambled phrase of words."""
    one = f"CASE WHEN regexp_replace(lower(q), '[^a-z0-9]', '', 'g') IN {_CONSERVED} THEN q ELSE translate(q, {source}, {target}) END"
    return f"trim(array_to_string(list_transform(string_split({phrase}, ' '), lambda q: {one}), ' '))"


_SWITCH = f"""{LEX}, pool AS (SELECT name, row_number() OVER (ORDER BY {md5(SEED, "pool", "name")}, name) - 1 AS k FROM lex), np AS (SELECT count(*) AS n FROM pool),
m AS (SELECT doc_id, regexp_extract_all(text, '{SPECIES}') AS x FROM documents), p AS (SELECT doc_id, unnest(x) AS name, generate_subscripts(x, 1) AS ord FROM m),
f AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) - 1 AS j FROM p WHERE name IN (SELECT name FROM lex) GROUP BY doc_id, name),
r AS (SELECT f.doc_id, f.name, f.j, pool.name AS new FROM f, np JOIN pool ON true WHERE pool.k = ({md5_int(SEED, "row", "f.doc_id")} + f.j) % np.n)"""


@query(f"WITH {_SWITCH} SELECT doc_id, name, new AS replacement FROM r")
def sampled_names(spark, sf_dir):
    """A replacement for each distinct name of a document."""
    lex = materialise(fx.lexicon(spark, sf_dir), "lexicon")
    known = lx.known_mentions(fx.table(spark, sf_dir, "documents"), lex)
    return sa.sampled_names(known, lex, SEED)


@query(f"""WITH {_SWITCH},
a AS (SELECT doc_id, name AS key, new AS value FROM r UNION ALL
  SELECT doc_id, left(name, 1) || '. ' || split_part(name, ' ', 2), arg_max(left(new, 1) || '. ' || split_part(new, ' ', 2), j) FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, '(' || string_agg(replace(key, '.', '\\.'), '|' ORDER BY length(key) DESC, key) || ')' AS pat, list({{'k': key, 'v': value}}) AS kv FROM a GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN k.pat IS NULL THEN d.text ELSE array_to_string(list_transform(string_split(regexp_replace(d.text, k.pat, chr(1) || '\\1' || chr(1), 'g'), chr(1)),
  lambda q, i: CASE WHEN i % 2 = 0 THEN list_filter(k.kv, lambda e: e.k = q)[1].v ELSE q END), '') END AS switched FROM documents d LEFT JOIN k USING (doc_id)""")
def switch_species(spark, sf_dir):
    """Species names of all documents replaced in one pass."""
    lex = materialise(fx.lexicon(spark, sf_dir), "lexicon")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return va.switch_species(docs, lx.known_mentions(docs, lex), lx.full_pool(lex), SEED, id_col="doc_id").select("doc_id", "switched")


_SWITCH_EDGE = [
    (1, "E. coli and E. coli.", "Z. ze and Z. ze."),
    (2, "Escherichia coli, E. coli, Escherichia coli", "Zeta ze, Z. ze, Zeta ze"),
    (3, "Escherichia coli Entamoeba coli E. coli", "Zeta ze Yota yo Y. yo"),
    (4, "Bacillus unknown E. colix", "Bacillus unknown E. colix"),
    (5, "nothing", "nothing"),
    (6, "E. coli then Bacillus cereus", "Y. yo then Zeta ze"),
]


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {s!r})' for i, _, s in _SWITCH_EDGE)}) v(id, switched)")
def switch_species_edge(spark, sf_dir):
    """Lone abbreviations, full and abbreviated forms, a shared abbreviation (the last full name wins), unknown names."""
    known = F.array(*(F.lit(x) for x in ("E. coli", "Escherichia coli", "Entamoeba coli", "Bacillus cereus")))
    d = spark.createDataFrame([(i, t) for i, t, _ in _SWITCH_EDGE], "id int, text string")
    m = va.switch_map(va.known_in_order(F.col("text"), known), F.array(F.lit("Zeta ze"), F.lit("Yota yo"), F.lit("Xi xi")), F.lit(0))
    return d.select("id", tx.replace_all(F.col("text"), m).alias("switched"))


_STRA = f"{SPANS}, w AS (SELECT DISTINCT article_id AS doc_id, w FROM tok WHERE regexp_matches(w, '[0-9]'))"


def _phrases(spark, sf_dir):
    """(doc_id, text, phrases): tokens with a digit of each document."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("phrases", tx.phrase_order(F.filter(tx.words(F.col("text")), lambda w: w.rlike("[0-9]"))))


def _perm(force: bool = False) -> tuple[str, str]:
    return _class_sql("w.doc_id::VARCHAR, '0'", force)


@query(f"WITH {_STRA} SELECT doc_id, w AS src, {_scrambled_sql('w', *_perm())} AS dst FROM w")
def scramble_map(spark, sf_dir):
    """Scrambled forms of identifier tokens."""
    rows = va.scramble(_phrases(spark, sf_dir), SEED, id_col="doc_id")
    return rows.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.src", "p.dst")


@query(f"WITH {_STRA} SELECT doc_id, w AS src, {_scrambled_sql('w', *_perm(True))} AS dst FROM w")
def scramble_force_diff(spark, sf_dir):
    """Scrambled forms without fixed points."""
    rows = va.scramble(_phrases(spark, sf_dir), SEED, force_diff=True, id_col="doc_id")
    return rows.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.src", "p.dst")


@query(f"""WITH RECURSIVE {_STRA}, pr AS (SELECT doc_id, w AS src, {_scrambled_sql('w', *_perm())} AS dst, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS i FROM w),
fold AS (SELECT doc_id, text, 0 AS i FROM documents UNION ALL SELECT f.doc_id, replace(f.text, pr.src, pr.dst), f.i + 1 FROM fold f JOIN pr ON pr.doc_id = f.doc_id AND pr.i = f.i + 1)
SELECT doc_id, arg_max(text, i) AS scrambled FROM fold GROUP BY doc_id""")
def scramble_text(spark, sf_dir):
    """Texts with their identifiers scrambled in turn."""
    return va.scramble(_phrases(spark, sf_dir), SEED, id_col="doc_id").select("doc_id", "scrambled")


_N = "len(list_filter(string_split_regex(coalesce({}, ''), '\\s+'), lambda q: q <> ''))"


#: The larger of the words and the code points by four.
_COUNT = f"greatest({_N}, ceil(length(coalesce({{}}, '')) / 4.0))::INT"


def _counted(text: str, counted: bool) -> str:
    return _COUNT.format(text, text) if counted else _N.format(text)


def _variants_sql(most: int, fit: int, final: int, extra: str = "", counted: bool = False) -> str:
    """SQL of the variants of all examples: one row each with its text and the reason of its drop."""
    types = "list_sort(list_distinct(list_transform(list_filter(labels, lambda l: l <> 'O'), lambda l: split_part(l, '-', 2))))"
    size = "len(labels)"
    budget = f"CASE WHEN {_counted('{0}', counted)} > {final} THEN 'scramble_budget_exceeded' END"
    mismatch = f"CASE WHEN {_N.format('{0}')} <> {size} THEN 'token_label_length_mismatch' END"
    return f"""{examples_sql(most, fit, counted)},
pool AS (SELECT name, row_number() OVER (ORDER BY {md5(SEED, "pool", "name")}, name) - 1 AS k FROM lex), np AS (SELECT count(*) AS n FROM pool),
xm AS (SELECT example_id, regexp_extract_all(text, '{SPECIES}') AS x FROM exs), xp AS (SELECT example_id, unnest(x) AS name, generate_subscripts(x, 1) AS ord FROM xm),
xf AS (SELECT example_id, name, row_number() OVER (PARTITION BY example_id ORDER BY min(ord)) - 1 AS j FROM xp WHERE name IN (SELECT name FROM lex) GROUP BY example_id, name),
xr AS (SELECT xf.example_id, xf.name, xf.j, pool.name AS new FROM xf, np JOIN pool ON true WHERE pool.k = ({md5_int(SEED, "row", "xf.example_id")} + xf.j) % np.n),
xa AS (SELECT example_id, name AS key, new AS value FROM xr UNION ALL
  SELECT example_id, left(name, 1) || '. ' || split_part(name, ' ', 2), arg_max(left(new, 1) || '. ' || split_part(new, ' ', 2), j) FROM xr GROUP BY 1, 2),
xk AS (SELECT example_id, '(' || string_agg(replace(key, '.', '\\.'), '|' ORDER BY length(key) DESC, key) || ')' AS pat, list({{'k': key, 'v': value}}) AS kv FROM xa GROUP BY example_id),
sw AS (SELECT exs.*, CASE WHEN xk.pat IS NULL THEN exs.text ELSE array_to_string(list_transform(string_split(regexp_replace(exs.text, xk.pat, chr(1) || '\\1' || chr(1), 'g'), chr(1)),
  lambda q, i: CASE WHEN i % 2 = 0 THEN list_filter(xk.kv, lambda e: e.k = q)[1].v ELSE q END), '') END AS switched FROM exs LEFT JOIN xk USING (example_id)),
xw AS (SELECT example_id, unnest(phrases) AS w, generate_subscripts(phrases, 1) AS i FROM exs),
pr AS (SELECT example_id, i, w AS src, {_scrambled_sql("w", *_class_sql("xw.example_id, '0'"))} AS dst FROM xw),
dl AS (SELECT example_id, list(dst ORDER BY length(dst) DESC, dst) AS dsts FROM (SELECT DISTINCT example_id, dst FROM pr) x GROUP BY 1),
fold AS (SELECT example_id, text AS t, switched AS u, 0 AS i FROM sw UNION ALL SELECT f.example_id, replace(f.t, pr.src, pr.dst), replace(f.u, pr.src, pr.dst), f.i + 1 FROM fold f JOIN pr ON pr.example_id = f.example_id AND pr.i = f.i + 1),
fin AS (SELECT example_id, arg_max(t, i) AS t, arg_max(u, i) AS u FROM fold GROUP BY 1),
vt AS (SELECT sw.example_id, sw.text, sw.labels, sw.phrases, coalesce(dl.dsts, []::VARCHAR[]) AS dsts, CASE WHEN {_counted("switched", counted)} > {final} THEN 'switch_budget_or_error' END AS sr, switched, fin.t, fin.u, {types} AS types
  FROM sw JOIN fin USING (example_id) LEFT JOIN dl USING (example_id)),
vr AS (SELECT *, CASE WHEN sr IS NULL THEN switched END AS t_species, CASE WHEN sr IS NULL THEN t END AS t_strains, CASE WHEN sr IS NULL THEN u END AS t_all FROM vt),
vb AS (SELECT *, {mismatch.format("text")} AS r_none, coalesce(sr, {mismatch.format("t_species")}) AS r_species, coalesce(sr, {budget.format("t_strains")}, {mismatch.format("t_strains")}) AS r_strains,
  coalesce(sr, {budget.format("t_all")}, {mismatch.format("t_all")}) AS r_all FROM vr),
vc AS (SELECT * REPLACE ({", ".join(f"coalesce(r_{v}, CASE WHEN NOT (r_species IS NULL AND r_strains IS NULL AND r_all IS NULL) THEN 'transform_alignment_dropped' END) AS r_{v}" for v in ("species", "strains", "all"))}) FROM vb),
vd AS (SELECT * {extra} FROM vc),
va AS ({" UNION ALL ".join(f"SELECT example_id, '{v}' AS variant, {t} AS text, r_{v} AS drop_reason, labels, phrases, {d} AS dsts, types FROM vd" for v, t, d in (("none", "text", "[]::VARCHAR[]"), ("species", "t_species", "[]::VARCHAR[]"), ("strains", "t_strains", "dsts"), ("all", "t_all", "dsts")))})"""


def _bundle_sql(most: int, fit: int, final: int, counted: bool = False) -> str:
    reason = classify_sql("types", "types", "['SPEC']", "t = 'SPEC'")
    here = "coalesce(array_to_string(list_filter({}, lambda p: contains(' ' || text || ' ', ' ' || p || ' ')), ' '), '')"
    return f"""WITH RECURSIVE {_variants_sql(most, fit, final, counted=counted)}, vo AS (SELECT *, {reason} AS reason FROM va)
SELECT example_id, variant, text, drop_reason, CASE WHEN reason = 'no_non_negative_labels' THEN 'irrelevant' ELSE 'relevant' END AS category, reason, array_to_string(labels, ' ') AS labels,
  CASE WHEN drop_reason IS NULL THEN {_counted("text", counted)} END AS token_count, {here.format("phrases")} AS original, {here.format("dsts")} AS scrambled FROM vo"""


def _bundle(spark, sf_dir, maxlen: int = wn.MAX_LEN, fit: int = wn.MAX_FINAL_LEN, max_final: int = wn.MAX_FINAL_LEN, **options):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    own, lex = materialise(fx.spans(spark, sf_dir), "spans"), materialise(fx.lexicon(spark, sf_dir), "lexicon")
    labelled = sp.bio_labels(docs, own, split=tx.words(F.col("text")))
    # windows meet the mentions of their articles and what these draw before they get their texts, which are made once and not shuffled
    grouped = wn.example_windows(labelled, own, maxlen=maxlen, final=fit, counters=options.get("counters"))
    pool = lx.full_pool(lex)
    picks = va.switch_picks(lx.window_mentions(grouped, lx.mentions_at(docs), lex), pool, SEED)
    # a number of partitions that is given isn't coalesced: windows are few bytes, but their texts are most of the work
    dealt = grouped.join(picks, "example_id", "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "article_id")
    index = wn.example_index(labelled, own, grouped=dealt)
    return va.materialise_variants(index, None, pool, seed=SEED, negative=F.array(F.lit("SPEC")), max_final=max_final, **options)


def _shown(b):
    return b.select("example_id", "variant", "text", "drop_reason", "category", "reason", F.array_join("labels", " ").alias("labels"), "token_count", F.array_join("phrases_original", " ").alias("original"), F.array_join("phrases_scrambled", " ").alias("scrambled"))


@query(_bundle_sql(wn.MAX_LEN, wn.MAX_FINAL_LEN, wn.MAX_FINAL_LEN))
def variant_bundle(spark, sf_dir):
    """M1-M9: coupled variants of all examples, kept or dropped with a reason."""
    return _shown(_bundle(spark, sf_dir))


#: Growth, fit and final budget.
_TIGHT = (60, wn.MAX_FINAL_LEN, 58)


@query(_bundle_sql(*_TIGHT))
def variant_bundle_tight(spark, sf_dir):
    """M1-M9: the same under a budget that many examples exceed."""
    return _shown(_bundle(spark, sf_dir, *_TIGHT))


#: The same in tokens of two counters.
_TIGHT_COUNTED = (120, 110, 109)


@query(_bundle_sql(*_TIGHT_COUNTED, counted=True))
def variant_bundle_counted(spark, sf_dir):
    """Variants under a tight budget of two counters."""
    return _shown(_bundle(spark, sf_dir, *_TIGHT_COUNTED, counters=COUNTERS))


@query(f"""WITH RECURSIVE {_variants_sql(*_TIGHT, "REPLACE (coalesce(r_none, CASE WHEN r_all IS NOT NULL THEN 'dropped_without_all_pair' END) AS r_none)")}
SELECT variant, drop_reason AS reason, count(*) AS n FROM va GROUP BY 1, 2""")
def variant_stats(spark, sf_dir):
    """M1: kept and dropped examples by variant and reason."""
    return va.variant_stats(_bundle(spark, sf_dir, *_TIGHT, keep_none_without_all=False))


_UNIQUE = f"""{_STRA}, tr AS (SELECT doc_id, w AS src, a.a AS attempt FROM w, range({va.UNIQUE_TRIES}) a(a)),
made AS MATERIALIZED (SELECT doc_id::VARCHAR AS id, attempt, src, {_scrambled_sql("src", *_class_sql("doc_id::VARCHAR, attempt::VARCHAR"))} AS dst FROM tr),
ids AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT id FROM made) x),
forms AS MATERIALIZED (SELECT id, list({{'attempt': attempt, 'dsts': dsts}} ORDER BY attempt) AS f FROM (SELECT id, attempt, list(dst) AS dsts FROM made GROUP BY 1, 2) y GROUP BY 1),
seq AS (
  SELECT 0::BIGINT AS k, NULL::VARCHAR AS id, NULL::BIGINT AS attempt, (SELECT list(DISTINCT w) FROM w) AS taken
  UNION ALL
  SELECT k, id, c.attempt, CASE WHEN c.attempt IS NULL THEN taken ELSE list_concat(taken, c.dsts) END
  FROM (SELECT ids.k, ids.id, seq.taken, list_filter(forms.f, lambda x: NOT list_has_any(seq.taken, x.dsts))[1] AS c FROM seq JOIN ids ON ids.k = seq.k + 1 JOIN forms ON forms.id = ids.id) z
)"""


@query(f"""WITH RECURSIVE {_UNIQUE} SELECT seq.id AS example_id, src, dst, attempt::INT AS attempt, NULL::VARCHAR AS reason FROM seq JOIN made USING (id, attempt)
UNION ALL SELECT id, NULL, NULL, NULL::INT, '{va.EXHAUSTED}' FROM seq WHERE id IS NOT NULL AND attempt IS NULL""")
def unique_scramble(spark, sf_dir):
    """Scrambled forms that no two documents share, in the order of ids; documents without a free form with the reason."""
    p = _phrases(spark, sf_dir).where(F.size("phrases") > 0).select(F.col("doc_id").cast("string").alias("example_id"), "phrases")
    return va.unique_outputs(p, SEED)


_ATTR = r"att AS (SELECT doc_id AS article_id, nullif(regexp_extract(text, '[^\n]*[Ll]icen[sc]e[^\n]*'), '') AS license FROM documents)"


def _license_sql(raw: str) -> str:
    s = f"replace(lower(trim(coalesce({raw}, ''))), '_', '-')"
    has = lambda *xs: "(" + " OR ".join(f"contains({s}, '{x}')" for x in xs) + ")"
    cc, nc = has("creative commons"), has("noncommercial", "non-commercial")
    nd, sa_ = has("noderivatives", "no derivatives", "no-derivatives"), has("sharealike", "share alike", "share-alike")
    cases = [
        (f"{s} = ''", "UNKNOWN"), (has("all rights reserved"), "ALL-RIGHTS-RESERVED"), (has("creativecommons.org/publicdomain/zero", "cc0"), "CC0-1.0"),
        (f"{cc} AND {nc} AND {nd}", "CC-BY-NC-ND-4.0"), (f"{cc} AND {nc} AND {sa_}", "CC-BY-NC-SA-4.0"), (f"{cc} AND {nd}", "CC-BY-ND-4.0"), (f"{cc} AND {sa_}", "CC-BY-SA-4.0"),
        (f"{cc} AND {nc}", "CC-BY-NC-4.0"), (f"{cc} AND {has('attribution')}", "CC-BY-4.0"),
        *((has(f"creativecommons.org/licenses/{m}/4.0", f"cc {m}", f"cc-{m}"), f"CC-{m.upper()}-4.0") for m in ("by-nc-nd", "by-nc-sa", "by-nd", "by-sa", "by-nc")),
        (has("creativecommons.org/licenses/by/4.0", "cc by 4.0", "cc-by-4.0"), "CC-BY-4.0"), (f"{s} = 'mit' OR starts_with({s}, 'mit ')", "MIT"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in cases) + f" ELSE trim({raw}) END"


_RAW = [
    "", "All Rights Reserved.", "CC0 1.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution-NonCommercial-NoDerivatives", "Creative Commons Attribution Share Alike non-commercial", "CC BY-NC 4.0",
    "cc_by-sa", "http://creativecommons.org/licenses/by/4.0/", "MIT", "mit license", "Released under the MIT License.", "Apache-2.0", "CC BY 3.0", "creative commons",
]
_BARRED = "(lid = 'ALL-RIGHTS-RESERVED' OR lid LIKE '%-ND%')"
_PERMITTED = "(NOT " + _BARRED + " AND lid IN (" + ", ".join(f"'{x}'" for x in tx.PERMISSIVE) + "))"


def _licensed(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    line = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike("[Ll]icen[sc]e")), F.lit(0))
    return lc.with_licenses(docs, docs.select("article_id", line.alias("license")).where("license is not null"))


_FILTER = f"""{_ATTR}, l AS (SELECT article_id, coalesce({_license_sql('license')}, 'UNKNOWN') AS license_id FROM att), u AS (SELECT *, upper(trim(license_id)) AS lid FROM l),
ok AS (SELECT list(DISTINCT lid) AS ids FROM u WHERE lid LIKE 'CC-%' OR lid = 'CC0-1.0'),
r AS (SELECT article_id, license_id, CASE WHEN lid = 'UNKNOWN' THEN ['unknown_license'] ELSE list_filter([
  CASE WHEN lid = 'ALL-RIGHTS-RESERVED' THEN 'all_rights_reserved_disallowed' END, CASE WHEN NOT coalesce(list_contains(ok.ids, lid), false) THEN 'license_not_in_allowed_set' END,
  CASE WHEN lid LIKE '%-ND%' THEN 'no_derivatives_disallowed' END, CASE WHEN lid LIKE '%-NC%' THEN 'noncommercial_disallowed' END], lambda x: x IS NOT NULL) END AS reasons FROM u, ok)"""
_POLICY = {"unknown": "exclude", "allow_noncommercial": False}


@query(f"WITH {_FILTER} SELECT article_id, license_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS kept, false AS would_exclude FROM r")
def licence_filter(spark, sf_dir):
    """Articles kept under a policy, the allowed set observed."""
    return lc.filter_by_license(_licensed(spark, sf_dir), _POLICY).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {_FILTER} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) x GROUP BY 1")
def licence_reason_counts(spark, sf_dir):
    """Rejected articles by reason."""
    return lc.reason_counts(lc.filter_by_license(_licensed(spark, sf_dir), _POLICY))


@query(f"WITH {_FILTER} SELECT license_id, CASE WHEN lid IN ('CC-BY-NC-4.0') THEN 'allowed' ELSE 'unknown' END AS policy_status, count(*) AS n FROM u GROUP BY 1, 2")
def licence_summary(spark, sf_dir):
    """Articles by licence."""
    return lc.summary(_licensed(spark, sf_dir))


_SPECS = st.split_specs({"splits": {"train": {"fraction": 0.7}, "test": {"fraction": 0.2, "coverage": {"min_articles_per_category": 1}}, "eval": {"fraction": 0.1}}})
_SPLIT = f"""c AS (SELECT count(*) AS n FROM documents), sp AS (SELECT * FROM (VALUES ('train', 0, 0.7::DOUBLE), ('test', 1, 0.2::DOUBLE), ('eval', 2, 0.1::DOUBLE)) v(split, ord, f)),
fl AS (SELECT split, ord, floor(n * f) AS k, n * f - floor(n * f) AS rem, n FROM sp, c),
cn AS (SELECT split, ord, (k + CASE WHEN row_number() OVER (ORDER BY rem DESC, ord) <= n - sum(k) OVER () THEN 1 ELSE 0 END)::BIGINT AS n_articles FROM fl),
cu AS (SELECT *, coalesce(sum(n_articles) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM cn),
rk AS (SELECT doc_id AS article_id, row_number() OVER (ORDER BY {md5(SEED, "split", "doc_id")}, doc_id) - 1 AS r FROM documents),
asg AS (SELECT article_id, split FROM rk JOIN cu ON r >= lo AND r < lo + n_articles)"""


def _assigned(spark, sf_dir):
    return st.assign(fx.articles(spark, sf_dir), _SPECS, SEED)


@query(f"WITH {_SPLIT} SELECT article_id, split FROM asg")
def split_assign(spark, sf_dir):
    """T5: shuffled contiguous cut."""
    return _assigned(spark, sf_dir)


def _categories(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("article_id"), F.col("source").alias("category"))


@query("SELECT source AS category, count(DISTINCT doc_id) AS n_articles FROM documents WHERE lang <> 'es' GROUP BY 1")
def category_counts(spark, sf_dir):
    """Articles of each category."""
    return st.category_counts(_categories(spark, sf_dir))


@query(f"""WITH {_SPLIT}, ca AS (SELECT a.article_id, a.split, d.source AS category FROM asg a LEFT JOIN documents d ON d.doc_id = a.article_id AND d.lang <> 'es'),
n AS (SELECT *, count(*) OVER (PARTITION BY split, category) AS n FROM ca)
SELECT article_id, split, (CASE WHEN category IS NULL THEN 0 ELSE n - 1 END)::BIGINT AS redundancy FROM n WHERE category IS NULL OR n > 1""")
def split_removable(spark, sf_dir):
    """Articles that a split can give away."""
    return st.removable(_assigned(spark, sf_dir), _categories(spark, sf_dir))


@query("SELECT source AS category, true AS covered FROM documents WHERE lang <> 'es' GROUP BY 1")
def split_coverage(spark, sf_dir):
    """After repair every category stands in the test split."""
    rows = _assigned(spark, sf_dir).withColumn("lineage", F.lit("set1"))
    moved, _ = st.repair_coverage(rows, _categories(spark, sf_dir), ["test"])
    cats = _categories(spark, sf_dir).withColumn("id", F.col("article_id").cast("string"))
    return moved.where("split = 'test'").join(cats, "id").select("category", F.lit(True).alias("covered")).distinct()


@query("""SELECT * FROM (VALUES (0, 'swap', 'x,y,z', 'train', 'a', 2, 'e', 0, true), (1, 'add', 'z', 'eval', 'd', 1, NULL, NULL, NULL)) v(step, action, missing, donor_split, donor, donor_cover, swapped_out, redundancy, irrelevant)""")
def split_repair_trace(spark, sf_dir):
    """The decisions of a small repair."""
    members = [("a", "train"), ("b", "train"), ("d", "eval"), ("e", "test"), ("f", "test")]
    cats = [("a", "x"), ("a", "y"), ("b", "x"), ("d", "z"), ("f", "w")]
    rows = spark.createDataFrame([("s", *m) for m in members], "lineage string, article_id string, split string")
    _, trace = st.repair_coverage(rows, spark.createDataFrame(cats, "article_id string, category string"), ["test"])
    return trace.drop("lineage", "target")


_EX = "ex AS (SELECT doc_id::VARCHAR AS example_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS category, CASE WHEN toxic = 1 THEN ['TOX', 'Q' || quality] ELSE list_filter([CASE WHEN doc_id % 5 > 0 THEN 'Q' || quality END], lambda x: x IS NOT NULL) END AS types_raw FROM labels)"


def _examples(spark, sf_dir):
    d = fx.table(spark, sf_dir, "labels")
    q = F.concat(F.lit("Q"), F.col("quality").cast("string"))
    none = F.array().cast("array<string>")
    return d.select(F.col("doc_id").cast("string").alias("example_id"), F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("category"), F.when(F.col("toxic") == 1, F.array(F.lit("TOX"), q)).when(F.col("doc_id") % 5 > 0, F.array(q)).otherwise(none).alias("types_raw"))


_MIX = f"""{_EX}, o AS (SELECT example_id, category, row_number() OVER (ORDER BY {md5(SEED, "mix", "example_id")}, example_id) AS r, count(*) OVER () AS n FROM ex WHERE category <> 'relevant'),
mix AS (SELECT example_id, category FROM ex WHERE category = 'relevant' UNION ALL SELECT example_id, category FROM o WHERE r <= trunc(n * (1.0::DOUBLE - 43.0::DOUBLE / 100.0::DOUBLE)))"""


@query(f"WITH {_MIX} SELECT example_id, category FROM mix")
def ablation_mix(spark, sf_dir):
    """Relevant examples and 57 % of the others."""
    return sa.ablation_mix(_examples(spark, sf_dir), 43, SEED).select("example_id", "category")


@query(f"""WITH {_MIX}, c AS (SELECT count(*) FILTER (category = 'relevant') AS n_relevant, count(*) AS n_total_rows, count(DISTINCT example_id) AS n_unique_example_ids FROM mix)
SELECT 'none' AS source_variant, 43.0::DOUBLE AS irrelevant_reduction_percent, n_total_rows - n_relevant AS kept_irrelevant, n_relevant, n_total_rows - n_relevant AS n_irrelevant, n_total_rows, n_unique_example_ids,
  (SELECT count(*) FROM ex WHERE category <> 'relevant') - (n_total_rows - n_relevant) AS n_removed_irrelevant FROM c""")
def mix_stats(spark, sf_dir):
    """Counts of a mix."""
    ex = _examples(spark, sf_dir).select("example_id", "category")
    return sa.mix_stats(ex, sa.ablation_mix(ex, 43, SEED), 43, "none")


@query(f"""WITH {_EX}, k AS (SELECT example_id, unnest(CASE WHEN len(types_raw) = 0 THEN ['O-only'] ELSE types_raw END) AS group_key FROM ex)
SELECT group_key, example_id FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY {md5(SEED, "group", "group_key", "example_id")}, example_id) AS r FROM k) x WHERE r <= 3""")
def group_sample(spark, sf_dir):
    """Three examples of each raw type, O-only among them."""
    return sa.group_sample(_examples(spark, sf_dir), 3, SEED)


@query(f"""WITH {_EX}, d AS (SELECT *, 'set' || (example_id::BIGINT % 2) AS dataset FROM ex), s AS (SELECT *, xor({SEED}::BIGINT, ('0x' || left(sha1(dataset), 8))::BIGINT) AS seed FROM d)
SELECT dataset, category, example_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, category ORDER BY md5(concat_ws(':', '{SEED}:category', seed::VARCHAR, category, example_id)), example_id) AS r FROM s) x WHERE r <= 2""")
def category_sample(spark, sf_dir):
    """Two examples of each category with each data set's stable seed."""
    d = _examples(spark, sf_dir).withColumn("dataset", F.concat(F.lit("set"), (F.col("example_id").cast("bigint") % 2).cast("string")))
    return sa.category_sample(d, 2, SEED)
