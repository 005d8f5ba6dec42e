"""Example-set summaries, validation, differences, QA rules and manifest deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.labels import label_types


def long_labels(examples: DataFrame, *, id_col: str = "example_id", labels_col: str = "labels") -> DataFrame:
    """(id, pos, label)."""
    return examples.select(id_col, F.posexplode(labels_col).alias("pos", "label"))


def label_counts(rows: DataFrame, *keys: str, id_col: str = "example_id") -> DataFrame:
    """(keys, label, prefix, n_tokens, n_examples) of long label rows; partial sums come before the shuffle."""
    per = rows.groupBy(*keys, id_col, "label").agg(F.count("*").alias("n"))
    out = per.groupBy(*keys, "label").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_examples"))
    prefix = F.when(F.col("label") == "O", "O").when(F.col("label").contains("-"), F.split_part("label", F.lit("-"), F.lit(1))).otherwise("UNKNOWN")
    return out.withColumn("prefix", prefix)


def type_counts(rows: DataFrame, *keys: str, id_col: str = "example_id") -> DataFrame:
    """(keys, typ, n_tokens, n_examples): tokens of a type, and distinct examples that hold it."""
    typ = F.expr("substr(label, instr(label, '-') + 1)")
    own = rows.where("label like '%-%'").withColumn("typ", typ).where("typ <> ''")
    per = own.groupBy(*keys, id_col, "typ").agg(F.count("*").alias("n"))
    return per.groupBy(*keys, "typ").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_examples"))


def length_stats(examples: DataFrame, *keys: str, labels_col: str = "labels") -> DataFrame:
    """(keys, n_examples, n_tokens, min, max, median): the median is cut to an integer; zeros without examples."""
    n = F.size(labels_col)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = examples.groupBy(*keys) if keys else examples
    return out.agg(F.count("*").alias("n_examples"), zero(F.sum(n)).alias("n_tokens"), zero(F.min(n)).alias("min_tokens"), zero(F.max(n)).alias("max_tokens"), zero(F.percentile(n, 0.5).cast("int")).alias("median_tokens"))


def meta_counts(meta: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, value, n) over category, reason, forced_relevant, types_raw, types_pooled."""
    one = lambda c, d: F.array(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d)))
    none = F.array().cast("array<string>")
    fields = {
        "category": one("category", "unknown"), "reason": one("reason", "unknown"),
        "forced_relevant": F.array(F.when(F.coalesce("forced_relevant", F.lit(False)), "true").otherwise("false")),
        "types_raw": F.coalesce("types_raw", none), "types_pooled": F.coalesce("types_pooled", none),
    }
    pair = lambda k: lambda x: F.struct(F.lit(k).alias("field"), x.alias("value"))
    pairs = F.flatten(F.array(*(F.transform(v, pair(k)) for k, v in fields.items())))
    return meta.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.field", "p.value").agg(F.count("*").alias("n"))


def validate(examples: DataFrame, meta: DataFrame | None = None, *, max_tokens: int | None = None, required_categories: tuple[str, ...] = (), required_raw_types: tuple[str, ...] = ()) -> DataFrame:
    """One column ``error``: the failed checks of an example set; no rows means ok.

    ``examples``: example_id, tokens, labels. Without metadata, categories and
    types are read off the labels (``O-only`` for examples without types).
    """
    spark = examples.sparkSession
    n, m = F.size("tokens"), F.size("labels")
    errors = examples.where(n != m).select(F.concat(F.lit("token_label_length_mismatch:"), "example_id").alias("error"))
    stats = examples.agg(F.count("*").alias("n"), F.coalesce(F.max(F.greatest(n, m)), F.lit(0)).alias("most"))
    if meta is not None:
        both = stats.crossJoin(meta.agg(F.count("*").alias("k")))
        errors = errors.unionByName(both.where("n <> k").select(F.concat(F.lit("example_meta_length_mismatch:"), "n", F.lit("!="), "k").alias("error")))
        found = meta_counts(meta)
        seen_cats, seen_types = found.where("field = 'category'").select("value"), found.where("field = 'types_raw'").select("value")
    else:
        types = examples.select(label_types(F.col("labels")).alias("t"))
        seen_types = types.select(F.explode("t").alias("value")).distinct()
        seen_cats = types.where(F.size("t") == 0).select(F.lit("O-only").alias("value")).distinct()
    if max_tokens is not None:
        errors = errors.unionByName(stats.where(F.col("most") > max_tokens).select(F.concat(F.lit("max_tokens_exceeded:"), F.col("most").cast("string"), F.lit(f">{max_tokens}")).alias("error")))
    for kind, values, seen in (("category", required_categories, seen_cats), ("raw_type", required_raw_types, seen_types)):
        wanted = sorted({v for v in values if v})
        if wanted:
            want = spark.createDataFrame([(v,) for v in wanted], "value string")
            errors = errors.unionByName(want.join(seen, "value", "left_anti").select(F.concat(F.lit(f"missing_required_{kind}:"), "value").alias("error")))
    return errors


def diff(a: DataFrame, b: DataFrame, *, id_col: str = "example_id") -> DataFrame:
    """(id, side, changed_tokens, changed_labels): one full outer join. Empty and repeated ids are errors."""
    for df in (a, b):
        bad = df.groupBy(id_col).count().where((F.col("count") > 1) | (F.coalesce(F.col(id_col), F.lit("")) == ""))
        if row := bad.first():
            raise ValueError(f"empty or repeated example id: {row[0]!r}")
    left = a.select(id_col, F.col("tokens").alias("ta"), F.col("labels").alias("la"), F.lit(1).alias("in_a"))
    right = b.select(id_col, F.col("tokens").alias("tb"), F.col("labels").alias("lb"), F.lit(1).alias("in_b"))
    both = left.join(right, id_col, "full")
    side = F.when(F.col("in_b").isNull(), "left_only").when(F.col("in_a").isNull(), "right_only").otherwise("both")
    changed = lambda x, y: (side == "both") & ~F.col(x).eqNullSafe(F.col(y))
    return both.select(id_col, side.alias("side"), changed("ta", "tb").alias("changed_tokens"), changed("la", "lb").alias("changed_labels"))


def glob_to_regex(pattern: Column) -> Column:
    """A shell pattern as an anchored regular expression; ``*`` matches slashes too."""
    out = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(out, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("$"))


def first_rule(sets: DataFrame, rules: DataFrame, *, key: str = "path") -> DataFrame:
    """``sets`` with the name of the first rule (by ``ord``) whose glob matches, else null. Rules are a few rows."""
    hits = sets.select(key).distinct().join(F.broadcast(rules.select("ord", "name", glob_to_regex(F.col("pattern")).alias("re"))), F.expr(f"rlike({key}, re)"))
    first = hits.groupBy(key).agg(F.min_by("name", "ord").alias("rule"))
    return sets.join(first, key, "left")


RULES = "ord int, name string, pattern string, require_categories array<string>, require_raw_types array<string>, max_tokens int"


def qa_report(examples: DataFrame, rules: DataFrame, default: dict | None = None, *, key: str = "path") -> DataFrame:
    """(path, rule, n_examples, n_tokens, errors, ok) of every example set under the first rule that matches its path.

    ``examples``: path, tokens, labels, category, types_raw; ``rules`` as in
    ``RULES``, a few rows, requirements may be left out; ``default`` holds those of
    sets without a rule.
    """
    none, default = F.array().cast("array<string>"), default or {}
    asks = {"require_categories": none, "require_raw_types": none, "max_tokens": F.lit(None).cast("int")}
    rules = rules.withColumns({c: v for c, v in asks.items() if c not in rules.columns})
    n, m = F.size("tokens"), F.size("labels")
    cats = F.collect_set(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("unknown")))
    per = examples.groupBy(key).agg(
        F.count("*").alias("n_examples"), F.sum(m).alias("n_tokens"), F.max(F.greatest(n, m)).alias("most"), F.count_if(n != m).alias("n_bad"),
        cats.alias("cats"), F.array_distinct(F.flatten(F.collect_set(F.coalesce("types_raw", none)))).alias("types"),
    )
    own = first_rule(per, rules, key=key).join(F.broadcast(rules.select(F.col("name").alias("rule"), "require_categories", "require_raw_types", "max_tokens")), "rule", "left")
    asked = lambda c: F.when(F.col("rule").isNotNull(), F.coalesce(c, none)).otherwise(F.array(*(F.lit(x) for x in default.get(c, ()))).cast("array<string>"))
    most = F.when(F.col("rule").isNotNull(), F.col("max_tokens")).otherwise(F.lit(default.get("max_tokens")).cast("int"))
    missing = lambda c, seen, kind: F.transform(F.array_sort(F.array_except(asked(c), F.col(seen))), lambda x: F.concat(F.lit(f"missing_required_{kind}:"), x))
    errors = F.flatten(F.array(
        F.array(F.when(F.col("n_bad") > 0, F.concat(F.lit("token_label_length_mismatch:"), F.col("n_bad").cast("string")))),
        F.array(F.when(F.col("most") > most, F.concat(F.lit("max_tokens_exceeded:"), F.col("most").cast("string"), F.lit(">"), most.cast("string")))),
        missing("require_categories", "cats", "category"), missing("require_raw_types", "types", "raw_type"),
    ))
    out = own.withColumn("errors", F.filter(errors, lambda e: e.isNotNull())).withColumn("rule", F.coalesce("rule", F.lit("default")))
    return out.select(key, "rule", "n_examples", "n_tokens", "errors", (F.size("errors") == 0).alias("ok"))


def qa_totals(report: DataFrame, *, key: str = "path") -> DataFrame:
    """(n_sets, n_ok, n_failed, n_examples, n_tokens, failed_sets): one row for all sets."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col(key))))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return report.agg(F.count("*").alias("n_sets"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), zero("n_examples"), zero("n_tokens"), failed.alias("failed_sets"))


def delta(before: DataFrame, after: DataFrame, *keys: str, value: str = "n") -> DataFrame:
    """(keys, before, after, delta) over the union of keys; missing counts are 0."""
    both = before.select(*keys, F.col(value).alias("before")).join(after.select(*keys, F.col(value).alias("after")), list(keys), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.select(*keys, zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("delta"))


def representative(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the middle rank or ranks of each group, for medians of whole rows."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    return ranked.where((F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.floor((F.col("n") + 2) / 2)))
