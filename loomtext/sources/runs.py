"""Run directories: metrics, states and specs; report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.reports import METRICS, parse_epoch

POINT = "precision:double,recall:double,f1:double,loss:double"
SCHEMA = f"task string, `set` string, seed int, model_id string, train_variant string, eval_split string, metrics map<string, struct<{POINT},per_epoch:array<struct<epoch:double,{POINT}>>>>"


def read_metrics(spark: SparkSession, root: str, epoch: str | int = "final", *, name: str = "metrics.json", complete: bool = True, lines: bool = False) -> DataFrame:
    """Metric rows of ``runs/*/*/seed_*/*/metrics.json`` under a root, or of files of another ``name``.

    ``epoch``: ``final`` (the last values), ``all`` (a row for each epoch), or a
    number (the last matching epoch entry). Rows without finite numbers are
    skipped, unless not only ``complete`` ones are asked for. A file is one document and
    its path the run; with ``lines`` each line is one, and names its run.
    """
    files = spark.read.schema(f"run string, {SCHEMA}").option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    rows = files.select("task", "set", "seed", "model_id", "train_variant", "eval_split", F.col("run" if lines else "_metadata.file_path").alias("run"), F.explode("metrics").alias("eval_set", "m"))
    keys = ["run", "task", "set", "seed", "model_id", "train_variant", F.coalesce("eval_split", F.lit("test")).alias("eval_split"), "eval_set"]
    last = F.array_max(F.transform("m.per_epoch", lambda e: parse_epoch(e["epoch"])))
    if epoch == "final":
        out = rows.select(*keys, F.lit("final").alias("epoch"), last.alias("effective_epoch"), *(F.col(f"m.{m}") for m in METRICS))
    else:
        each = rows.select(*keys, F.posexplode("m.per_epoch").alias("pos", "e")).withColumn("n", parse_epoch(F.col("e.epoch")))
        if epoch != "all":
            each = each.where(F.col("n") == int(epoch)).groupBy(*each.columns[:8], "n").agg(F.max_by("e", "pos").alias("e"))
        out = each.select(*each.columns[:8], F.col("n").cast("string").alias("epoch"), F.col("n").alias("effective_epoch"), *(F.col(f"e.{m}") for m in METRICS))
    keep = F.lit(True)
    for m in METRICS:
        keep = keep & F.col(m).isNotNull() & ~F.isnan(m)
    return out.where(keep) if complete else out


def read_states(spark: SparkSession, root: str, *, name: str = "run_state.json") -> DataFrame:
    """(run, status, signature, updated_at, metrics_sha256) of run_state.json files, or of files of another ``name``."""
    schema = "status string, signature string, updated_at string, metrics_sha256 string"
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return files.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("run"), "*")


def write_csv(rows: DataFrame, path: str) -> None:
    """Report rows as CSV with a header; metrics but the loss in percent."""
    scaled = [F.round(F.col(c) * 100, 4).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in rows.columns]
    rows.select(*scaled).write.option("header", True).csv(path)


def table_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One column ``line``: values of a row in fixed columns, numbers with four digits."""
    cells = [F.format_string("%-24s", F.format_number(c, 4) if dict(rows.dtypes)[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns]
    return rows.select(F.rtrim(F.concat(*cells)).alias("line"))


def write_interval_csv(intervals: DataFrame, path: str, keys: list[str]) -> None:
    """One CSV row a group of :func:`loomtext.operators.reports.report_intervals`: point and interval columns of each metric, in percent but for the loss."""
    ends = ["point", "percentile_lo", "percentile_hi", "basic_lo", "basic_hi"]
    value = lambda m, e: F.max(F.when(F.col("metric") == m, F.col(e) if m == "loss" else F.round(F.col(e) * 100, 4)))
    columns = [value(m, e).alias(m if e == "point" else f"{m}_{e}") for m in METRICS for e in ends]
    intervals.groupBy(*keys, "n_runs").agg(*columns).write.option("header", True).csv(path)
