"""Integrity claims over data sets and runs. Every check gives violation rows; no row means the claim holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.digests import ordered_digests

VIOLATION = ["check", "context", "message"]


def _violations(df: DataFrame, check: str, context, message) -> DataFrame:
    return df.select(F.lit(check).alias("check"), context.cast("string").alias("context"), message.cast("string").alias("message"))


def split_digests(members: DataFrame) -> DataFrame:
    """(lineage, split, n, digest) of (lineage, split, article_id); the digest is of the sorted distinct ids."""
    rows = members.withColumn("group", F.to_json(F.struct("lineage", "split")))
    ids = rows.select("group", F.col("article_id").cast("string").alias("line")).where("line IS NOT NULL").distinct()
    sizes = rows.groupBy("group", "lineage", "split").agg(F.count("*").alias("n"))
    of_none = F.sha2(F.lit("").cast("binary"), 256)
    return sizes.join(ordered_digests(ids, "line"), "group", "left").select("lineage", "split", "n", F.coalesce("digest", of_none).alias("digest"))


def digest_mismatches(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Splits whose digest differs from (lineage, split, digest) of the manifest, or that one side lacks."""
    both = split_digests(members).select("lineage", "split", F.col("digest").alias("found")).join(manifest.select("lineage", "split", F.col("digest").alias("claimed")), ["lineage", "split"], "full")
    bad = both.where(~F.col("found").eqNullSafe(F.col("claimed")))
    return _violations(bad, "split_hash", F.concat_ws("/", "lineage", "split"), F.lit("split hash differs from the manifest"))


def split_overlaps(members: DataFrame, a: str = "train", b: str = "eval") -> DataFrame:
    """Lineages in which articles stand in both splits, with their number."""
    left, right = (members.where(F.col("split") == s).select("lineage", "article_id").distinct() for s in (a, b))
    n = left.join(right, ["lineage", "article_id"], "left_semi").groupBy("lineage").agg(F.count("*").alias("n"))
    return _violations(n, "split_overlap", F.col("lineage"), F.concat(F.col("n").cast("string"), F.lit(f" articles in {a} and {b}")))


def equal_lineages(members: DataFrame) -> DataFrame:
    """Lineages whose splits are all the same, as a list of names."""
    signature = split_digests(members).groupBy("lineage").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "split", "digest"))), ";").alias("signature"))
    same = signature.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list(F.col("lineage").cast("string"))), ",").alias("lineages"), F.count("*").alias("n")).where("n > 1")
    return _violations(same, "equal_lineages", F.col("lineages"), F.lit("identical split signature"))


def equal_splits(members: DataFrame) -> DataFrame:
    """Groups of lineages of one task whose split of one name has the same articles; a lineage is ``profile<TAB>task<TAB>name``."""
    digests = split_digests(members).withColumn("place", F.regexp_replace("lineage", r"[^\t]*$", ""))
    same = digests.groupBy("place", "split", "digest").agg(F.array_sort(F.collect_list("lineage")).alias("l")).where(F.size("l") > 1)
    names = F.array_join(F.transform("l", lambda x: F.regexp_extract(x, r"([^\t]*)$", 1)), ",")
    return _violations(same, "equal_splits", F.concat("place", names), F.concat(F.lit("same articles in split "), "split"))


def foreign_articles(meta: DataFrame, allowed: DataFrame) -> DataFrame:
    """Data sets (``dataset``) that hold articles outside the allowed (dataset, article_id), with their number."""
    out = meta.select("dataset", "article_id").distinct().join(allowed.select("dataset", "article_id"), ["dataset", "article_id"], "left_anti").groupBy("dataset").agg(F.count("*").alias("n"))
    return _violations(out, "foreign_articles", F.col("dataset"), F.concat(F.col("n").cast("string"), F.lit(" articles outside the source splits")))


def set_differences(claimed: DataFrame, actual: DataFrame, check: str) -> DataFrame:
    """Values that only one of two sets has; both have columns (context, value)."""
    a, b = claimed.select("context", "value").distinct(), actual.select("context", "value").distinct()
    only = a.exceptAll(b).groupBy("context").agg(F.count("*").alias("n")).select("context", F.concat(F.col("n").cast("string"), F.lit(" values claimed only")).alias("m"))
    lack = b.exceptAll(a).groupBy("context").agg(F.count("*").alias("n")).select("context", F.concat(F.col("n").cast("string"), F.lit(" values missing")).alias("m"))
    return _violations(only.unionByName(lack), check, F.col("context"), F.col("m"))


def rows_with_values(rows: DataFrame, values: DataFrame, check: str, *, id_col: str = "example_id", array_col: str = "values") -> DataFrame:
    """(check, context, n_rows): eval rows, not values, that hold any of the training (value)s."""
    hit = rows.select("context", id_col, F.explode(array_col).alias("value")).join(values.select("value").distinct(), "value", "left_semi")
    return hit.groupBy("context").agg(F.countDistinct(id_col).alias("n_rows")).select(F.lit(check).alias("check"), "context", "n_rows")


def calibration_relation(main: DataFrame, calibration: DataFrame) -> DataFrame:
    """Test articles must be those of the calibration set; train must be its train and eval together."""
    def values(df: DataFrame, splits: tuple[str, ...], name: str) -> DataFrame:
        return df.where(F.col("split").isin(*splits)).select(F.concat_ws("/", "lineage", F.lit(name)).alias("context"), F.col("article_id").cast("string").alias("value"))

    test = set_differences(values(main, ("test",), "test"), values(calibration, ("test",), "test"), "calibration_test")
    train = set_differences(values(main, ("train",), "train"), values(calibration, ("train", "eval"), "train"), "calibration_train")
    return test.unionByName(train)


def all_violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (c.select(*VIOLATION) for c in checks))


def rollup(violations: DataFrame) -> DataFrame:
    """(check, n) with a total row whose check is null."""
    return violations.rollup("check").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- runs


def validate_runs(specs: DataFrame, states: DataFrame, metrics: DataFrame, *, eval_sets: tuple[str, ...] = (), epsilon: float = 0.0, fail_on_collapse: bool = True) -> DataFrame:
    """(run, errors, ok): the failed checks of each run directory.

    ``specs``: run, signature, task, set, seed, model_id, train_variant;
    ``states``: run, status, signature, metrics_sha256;
    ``metrics``: run, metrics_sha256, task, ..., eval_set, precision, recall, f1, loss.
    """
    identity = ("task", "set", "seed", "model_id", "train_variant")
    number = lambda m: F.col(m).isNotNull() & ~F.isnan(m)
    complete = number("precision") & number("recall") & number("f1") & number("loss")
    collapsed = complete & (F.abs("precision") <= epsilon) & (F.abs("recall") <= epsilon) & (F.abs("f1") <= epsilon)
    per = metrics.groupBy("run").agg(
        F.max("metrics_sha256").alias("found_sha"), F.array_sort(F.collect_set("eval_set")).alias("sets"), F.array_sort(F.collect_set(F.when(~complete, F.col("eval_set")))).alias("partial"),
        F.array_sort(F.collect_set(F.when(collapsed, F.col("eval_set")))).alias("collapsed"), *(F.max(c).alias(f"m_{c}") for c in identity),
    )
    state = states.select("run", "status", F.col("signature").alias("state_signature"), F.col("metrics_sha256").alias("claimed_sha"))
    rows = specs.join(state, "run", "left").join(per, "run", "left")
    none = F.array().cast("array<string>")
    wanted = F.array(*(F.lit(s) for s in eval_sets)) if eval_sets else none
    missing = F.array_except(wanted, F.coalesce("sets", none))
    errors = [
        F.array(F.when(F.col("status").isNull(), "missing_state")), F.array(F.when(F.col("found_sha").isNull(), "missing_metrics")),
        F.array(F.when(F.col("status") != "completed", F.concat(F.lit("status:"), "status"))),
        F.array(F.when(F.col("state_signature") != F.col("signature"), "signature_mismatch")),
        F.array(F.when(F.col("claimed_sha") != F.col("found_sha"), "metrics_hash_mismatch")),
        *(F.array(F.when(F.col(c).cast("string") != F.col(f"m_{c}").cast("string"), f"identity_mismatch:{c}")) for c in identity),
        F.transform(missing, lambda s: F.concat(F.lit("missing_eval_set:"), s)),
        F.transform(F.coalesce("partial", none), lambda s: F.concat(F.lit("missing_metric:"), s)),
        F.transform(F.coalesce("collapsed", none) if fail_on_collapse else none, lambda s: F.concat(F.lit("collapsed:"), s)),
    ]
    out = rows.withColumn("errors", F.filter(F.flatten(F.array(*errors)), lambda e: e.isNotNull()))
    return out.select("run", "errors", (F.size("errors") == 0).alias("ok"))


def signature_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sorted keys whose values differ between two (key, value) signatures; a key that one side lacks differs."""
    both = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("key")


def metric_parity(a: DataFrame, b: DataFrame, *keys: str, tolerance: float = 1e-6) -> DataFrame:
    """(keys, value_a, value_b, abs_diff, status) of metrics that differ by more than the tolerance or that one side lacks."""
    both = a.select(*keys, F.col("value").alias("value_a")).join(b.select(*keys, F.col("value").alias("value_b")), list(keys), "full")
    gap = F.abs(F.col("value_a") - F.col("value_b"))
    status = F.when(F.col("value_a").isNull(), "missing_a").when(F.col("value_b").isNull(), "missing_b").when(gap > tolerance, "differs")
    return both.withColumn("abs_diff", gap).withColumn("status", status).where("status is not null")


def manifest_mismatches(claimed: DataFrame, found: DataFrame, key: str = "asset") -> DataFrame:
    """(key, status) of assets whose hash is missing or other than claimed."""
    both = claimed.select(key, F.col("sha256").alias("claimed")).join(found.select(key, F.col("sha256").alias("found")), key, "left")
    return both.where(~F.col("claimed").eqNullSafe(F.col("found"))).select(key, F.when(F.col("found").isNull(), "missing").otherwise("differs").alias("status"))


def missing_artifacts(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (task, set, train_variant, path) that jobs need and the listing lacks. ``files``: path."""
    need = jobs.select("task", "set", "train_variant", F.concat_ws("/", "task", "set", F.lit("train"), F.concat("train_variant", F.lit(".set"))).alias("path"))
    evals = jobs.select("task", "set", "train_variant", F.explode("eval_sets").alias("e"), "eval_split")
    evals = evals.select("task", "set", "train_variant", F.concat_ws("/", "task", "eval_split", F.concat("e", F.lit(".set"))).alias("path"))
    return need.unionByName(evals).distinct().join(files.select("path"), "path", "left_anti").select("task", "set", "train_variant", "path")


def tree_digest(files: DataFrame) -> DataFrame:
    """(n_files, n_bytes, digest) of (path, size, sha256): SHA-256 over ordered ``path<TAB>size<TAB>sha256`` lines."""
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), "sha256")
    digest = ordered_digests(files.select(F.lit("").alias("group"), "path", line.alias("line")), "path", "line", end=True)
    of_none = F.sha2(F.lit("").cast("binary"), 256)
    sums = files.agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes")).withColumn("group", F.lit(""))
    return sums.join(digest, "group", "left").select("n_files", "n_bytes", F.coalesce("digest", of_none).alias("digest"))
