"""Run reports: aggregation, paired deltas, epoch calibration, time and membership filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators import bootstrap as bs
from loomtext.operators.summary import representative

GROUP = ["task", "model_id", "train_variant", "eval_split", "eval_set"]
METRICS = ["loss", "precision", "recall", "f1"]
OBJECTIVES = ("balanced_f1", "augmented_exclusive_f1", "unaugmented_f1", "balanced_loss")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def strict_metrics(rows: DataFrame) -> DataFrame:
    """``rows`` unless a metric is missing, not finite, or (but for loss) outside [0, 1]; then an error."""
    bad = F.lit(False)
    for m in METRICS:
        c = F.col(m)
        bad = bad | ~F.coalesce(finite(c) & (F.lit(m == "loss") | c.between(0.0, 1.0)), F.lit(False))
    bad = bad | F.coalesce(F.trim(F.col("set")) == "", F.lit(True)) | F.col("seed").isNull()
    guard = F.when(bad, F.raise_error(F.lit("invalid metric row")).cast("double")).otherwise(F.col("f1"))
    return rows.withColumn("f1", guard)


def lenient_metrics(rows: DataFrame) -> DataFrame:
    """Rows whose metrics parse as finite numbers; others are skipped."""
    out = rows
    for m in METRICS:
        out = out.withColumn(m, F.col(m).try_cast("double"))
    keep = F.lit(True)
    for m in METRICS:
        keep = keep & finite(F.col(m))
    return out.where(keep)


def parse_epoch(c: Column) -> Column:
    """Epoch number: halves go to the even neighbour; null if not positive or not a number."""
    e = F.bround(c.try_cast("double")).cast("int")
    return F.when(e > 0, e)


def members(rows: DataFrame, **allowed) -> DataFrame:
    """Rows whose columns are among the given values; an empty or null list keeps all."""
    for name, values in allowed.items():
        if values:
            rows = rows.where(F.col(name).isin(*values))
    return rows


def in_time_range(rows: DataFrame, since: str | None = None, until: str | None = None, *, col: str = "run_updated_at") -> DataFrame:
    """Rows with ``since`` <= time < ``until``; a date as the upper bound includes that day; rows without a time go."""
    ts = F.try_to_timestamp(F.col(col).cast("string"))
    rows = rows.withColumn("_t", ts).where("_t is not null")
    if since:
        rows = rows.where(F.col("_t") >= F.try_to_timestamp(F.lit(since)))
    if until:
        end = F.try_to_timestamp(F.lit(until))
        if len(until.strip()) == 10:
            end = end + F.expr("interval 1 day")
        rows = rows.where(F.col("_t") < end)
    return rows.drop("_t")


def _effective() -> Column:
    return F.when(F.countDistinct("effective_epoch") == 1, F.max("effective_epoch"))


def report(rows: DataFrame, *, point: str = "mean", keys: list[str] | None = None) -> DataFrame:
    """(keys, n_runs, effective_epoch, loss, precision, recall, f1).

    ``mean`` takes means of metrics; ``median`` the row in the middle by f1,
    precision, recall, loss, set, seed, or the mean of the two middle rows.
    The effective epoch is given only if all runs of the group share it.
    """
    keys = GROUP if keys is None else keys
    if "effective_epoch" not in rows.columns:
        rows = rows.withColumn("effective_epoch", F.lit(None).cast("int"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_runs"), _effective().alias("effective_epoch"))
    chosen = rows if point == "mean" else representative(rows, keys, ["f1", "precision", "recall", "loss", "set", "seed"])
    points = chosen.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in METRICS))
    return counts.join(points, keys)


def report_intervals(rows: DataFrame, *, point: str = "mean", keys: list[str] | None = None, n_bootstrap: int = 50_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(keys, n_runs, metric, point, percentile_lo, percentile_hi, basic_lo, basic_hi) of :func:`report`.

    A replicate draws as many runs of its group, the same ones for all metrics;
    its value is their mean, or that of the middle run or runs. A group may have
    any number of runs.
    """
    keys = GROUP if keys is None else keys
    order = ["f1", "precision", "recall", "loss", "set", "seed"]
    drawn = (bs.resampled_sums if point == "mean" else bs.resampled_middles)(rows, tuple(keys), order, METRICS, n_bootstrap, seed)
    ends = bs.bounds(drawn, {m: F.col(m) / F.col("n") if point == "mean" else F.col(m) for m in METRICS}, level)
    points = report(rows, point=point, keys=keys).withColumn("group", bs._group(tuple(keys)))
    points = points.select("group", *keys, "n_runs", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in METRICS))).alias("x")).select("group", *keys, "n_runs", "x.*")
    return bs.with_basic(points.join(ends, ["group", "metric"]).drop("group"))


def live_report(rows: DataFrame, *, point: str = "mean") -> DataFrame:
    """:func:`report` with the epoch in the key."""
    return report(rows, point=point, keys=[*GROUP, "epoch"])


def paired_deltas(rows: DataFrame, a: str, b: str, *, unit: list[str] | None = None) -> DataFrame:
    """(unit, loss, precision, recall, f1): a minus b of runs that differ in the train variant only.

    Of repeated runs the last by ``ord`` counts. One conditional aggregation
    replaces the self-join.
    """
    unit = unit or ["profile_id", "task", "seed", "set", "model_id", "epoch", "eval_split", "eval_set"]
    value = F.struct(*(F.col(m).try_cast("double").alias(m) for m in METRICS))
    last = lambda v: F.max_by(F.when(F.col("train_variant") == v, value), F.when(F.col("train_variant") == v, F.col("ord")))
    pairs = rows.where(F.col("train_variant").isin(a, b) & F.col("seed").isNotNull()).groupBy(*unit).agg(last(a).alias("a"), last(b).alias("b")).where("a is not null and b is not null")
    out = pairs.select(*unit, *((F.col(f"a.{m}") - F.col(f"b.{m}")).alias(m) for m in METRICS))
    keep = F.lit(True)
    for m in METRICS:
        keep = keep & F.col(m).isNotNull()
    return out.where(keep)


def delta_report(pairs: DataFrame, *, point: str = "mean", keys: list[str] | None = None) -> DataFrame:
    """(keys, n_pairs, point of each delta)."""
    keys = keys or ["profile_id", "task", "model_id", "epoch", "eval_split", "eval_set"]
    f = (lambda c: F.avg(c)) if point == "mean" else (lambda c: F.percentile(c, 0.5))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), *(f(m).alias(m) for m in METRICS))


def unit_scores(rows: DataFrame, objective: str, *, keys: list[str] | None = None) -> DataFrame:
    """(keys, epoch, task, set, seed, train_variant, score) of units that have the eval sets an objective needs."""
    keys = keys or ["model_id"]
    unit = [*keys, "epoch", "task", "set", "seed", "train_variant"]
    metric = "loss" if objective == "balanced_loss" else "f1"
    of = lambda s: F.max_by(F.when(F.col("eval_set") == s, F.col(metric)), F.when(F.col("eval_set") == s, F.col("ord")))
    both = rows.groupBy(*unit).agg(of("augmented_exclusive").alias("a"), of("unaugmented").alias("u"))
    score = {"augmented_exclusive_f1": F.col("a"), "unaugmented_f1": F.col("u")}.get(objective, (F.col("a") + F.col("u")) / 2.0)
    return both.select(*unit, score.alias("score")).where("score is not null")


def calibrate(rows: DataFrame, objective: str = "balanced_f1", *, min_epoch: int = 1, max_epoch: int | None = None, exclude_collapsed: bool = False, epsilon: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, epoch, n_units_total, n_units_used, n_collapsed, collapse_rate, score_median, is_best).

    The best epoch has the best median score, the smallest epoch if several do.
    """
    keys = keys or ["model_id"]
    largest = objective != "balanced_loss"
    s = unit_scores(rows, objective, keys=keys).where(F.col("epoch") >= min_epoch)
    if max_epoch is not None:
        s = s.where(F.col("epoch") <= max_epoch)
    s = s.withColumn("collapsed", (F.col("score") <= epsilon) & F.lit(largest))
    used = ~F.col("collapsed") | F.lit(not exclude_collapsed)
    by = s.groupBy(*keys, "epoch").agg(
        F.count("*").alias("n_units_total"), F.count_if(used).alias("n_units_used"), F.count_if("collapsed").alias("n_collapsed"), F.percentile(F.when(used, F.col("score")), 0.5).alias("score_median")
    )
    by = by.withColumn("collapse_rate", F.col("n_collapsed") / F.col("n_units_total"))
    order = F.struct(F.col("score_median") if largest else -F.col("score_median"), -F.col("epoch"))
    best = F.max_by("epoch", F.when(F.col("score_median").isNotNull(), order)).over(Window.partitionBy(*keys))
    return by.withColumn("is_best", F.coalesce(F.col("epoch") == best, F.lit(False)))


def status_summary(runs: DataFrame) -> DataFrame:
    """(task, experiment_root, n_jobs, n_complete, n_failed, n_skipped)."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy("task", "experiment_root").agg(F.count("*").alias("n_jobs"), is_("completed").alias("n_completed"), is_("failed").alias("n_failed"), is_("skipped").alias("n_skipped"))
