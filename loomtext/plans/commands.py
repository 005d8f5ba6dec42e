"""The command surface as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.labels import inline_labels, spaced
from loomtext.operators import claims, reports, sampling, summary
from loomtext.plans import runner
from loomtext.sources import jsonl, results, runs


def inspect(spark: SparkSession, a: str, b: str, *, changed_only: bool = False) -> DataFrame:
    """Differences of two example sets by id."""
    out = summary.diff(*(jsonl.with_metadata(spark, p).select("example_id", "tokens", "labels") for p in (a, b)))
    return out.where("side <> 'both' or changed_tokens or changed_labels") if changed_only else out


def sample(spark: SparkSession, path: str, n: int, seed: int, *, group_by: str = "types_raw", inline: bool = True) -> DataFrame:
    """(group_key, example_id, shown): a readable sample of each group."""
    rows = jsonl.with_metadata(spark, path)
    picked = sampling.group_sample(rows, n, seed, group_by=group_by)
    text = inline_labels(F.col("tokens"), F.col("labels")) if inline else spaced(F.col("tokens"))
    return picked.join(rows, "example_id").select("group_key", "example_id", text.alias("shown"))


def validate(spark: SparkSession, path: str, **checks) -> DataFrame:
    """Failed checks of an example set."""
    rows = jsonl.with_metadata(spark, path)
    return summary.validate(rows.select("example_id", "tokens", "labels"), rows, **checks)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(label, prefix, n_tokens, n_examples) of an example set."""
    return summary.label_counts(summary.long_labels(jsonl.with_metadata(spark, path)))


def qa(spark: SparkSession, root: str, rules: DataFrame, default: dict | None = None) -> DataFrame:
    """The QA report of all sets under a root, each under its first matching rule; its totals are :func:`loomtext.operators.summary.qa_totals`."""
    sets = jsonl.with_metadata(spark, root).withColumn("path", F.concat(F.regexp_replace("stem", f"^.*?{_quoted(root)}/*", ""), F.lit(".set")))
    return summary.qa_report(sets, rules, default)


def _quoted(root: str) -> str:
    return r"\Q" + root.rstrip("/") + r"\E"


def report(spark: SparkSession, root: str, *, epoch: str | int = "final", point: str = "mean", since: str | None = None, until: str | None = None, **members) -> DataFrame:
    """Aggregated metrics of the runs under a root, with membership and time filters (times come from run states)."""
    rows = reports.members(runs.read_metrics(spark, root, epoch), **members)
    if since or until:
        times = runs.read_states(spark, root).select("run", F.col("updated_at").alias("run_updated_at"))
        rows = rows.withColumn("run", F.regexp_replace("run", "/[^/]*$", "")).join(times, "run")
        rows = reports.in_time_range(rows, since, until)
    return reports.report(rows, point=point, keys=None if epoch != "all" else [*reports.GROUP, "epoch"])


def calibrate(spark: SparkSession, root: str, **options) -> DataFrame:
    """Epoch calibration of the runs under a root."""
    rows = runs.read_metrics(spark, root, "all").withColumn("epoch", F.col("effective_epoch")).withColumn("ord", F.col("run"))
    return reports.calibrate(rows, **options)


def verify(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations of the split claims: digests, overlaps, equal lineages."""
    return claims.all_violations(claims.digest_mismatches(members, manifest), claims.split_overlaps(members), claims.equal_lineages(members))


def verify_root(spark: SparkSession, root: str, *, tasks: tuple[str, ...] = (), profiles: tuple[str, ...] = ()) -> DataFrame:
    """(profile, task, check, context, message) of the split claims of all lineages under a results root; requested tasks and profiles must be there."""
    members, manifest = results.read_splits(spark, root), results.read_manifests(spark, root)
    if tasks:
        members, manifest = (df.where(F.col("task").isin(*tasks)) for df in (members, manifest))
    place = F.concat_ws("\t", "profile", "task", "lineage").alias("lineage")
    rows, claimed = members.select(place, "split", "article_id"), manifest.select(place, "split", "digest")
    of_manifest = rows.join(claimed.select("lineage").distinct(), "lineage", "left_semi")
    found = claims.all_violations(
        claims.digest_mismatches(of_manifest, claimed), *(claims.split_overlaps(rows, "train", s) for s in ("test", "eval", "dev")), claims.equal_splits(rows)
    )
    part = lambda i: F.regexp_extract("context", r"^([^\t]*)\t([^\t]*)\t(.*)$", i)
    out = found.select(part(1).alias("profile"), part(2).alias("task"), "check", part(3).alias("context"), "message")
    none = F.lit(None).cast("string")
    for column, names in (("task", tasks), ("profile", profiles)):
        if names:
            lack = results.missing(members, column, names)
            out = out.unionByName(lack.select(none.alias("profile"), none.alias("task"), "check", "context", "message"))
    return out


def claims_summary(violations: DataFrame) -> DataFrame:
    """(profile, task, check, n) with totals of each task, of each profile and of all."""
    return violations.rollup("profile", "task", "check").agg(F.count("*").alias("n"))


COUNTS = ("category_counts", "label_counts", "label_type_example_counts", "label_type_token_counts", "types_raw_counts")


def manifest_compare(spark: SparkSession, path: str, a: str = "none", b: str = "all", *, train_set: str | None = None) -> DataFrame:
    """(field, value, before, after, delta) of two train variants of a manifest; ``delta`` is the first minus the second."""
    manifest = jsonl.read_document(spark, path)

    def rows(variant: str) -> DataFrame:
        stats = runner.variant_stats(manifest, variant, train_set)
        flat = [(f, "", int(stats.get(f) or 0)) for f in ("n_examples", "n_tokens_total")]
        flat += [(f, str(k), int(n)) for f in COUNTS for k, n in (stats.get(f) or {}).items()]
        return spark.createDataFrame(flat, "field string, value string, n bigint")

    return summary.delta(rows(b), rows(a), "field", "value")
