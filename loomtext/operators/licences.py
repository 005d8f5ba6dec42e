"""Licence policy over articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import license_flags, license_id, license_reasons

DEFAULTS = {"mode": "exclude", "unknown": "allow", "disallow_all_rights_reserved": True, "disallow_no_derivatives": True, "allow_noncommercial": True, "allow_share_alike": True}


def policy_of(config: dict | None) -> dict:
    """Validated policy with defaults; ``unknown: fail`` acts as ``exclude``."""
    policy = DEFAULTS | (config or {})
    if str(policy["mode"]).lower() not in ("exclude", "fail", "warn"):
        raise ValueError(f"licence policy mode: {policy['mode']}")
    if str(policy["unknown"]).lower() not in ("allow", "exclude", "fail"):
        raise ValueError(f"licence policy for unknown licences: {policy['unknown']}")
    allowed = policy.get("allowed_license_ids") or []
    policy["allowed_license_ids"] = sorted({str(x).strip().upper() for x in ([allowed] if isinstance(allowed, str) else allowed) if str(x).strip()})
    return policy


def with_licenses(articles: DataFrame, attribution: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    """Articles with license_id (``UNKNOWN`` without attribution) and its flags."""
    known = attribution.select(id_col, license_id(F.col("license")).alias("license_id"))
    rows = articles.select(id_col).join(known, id_col, "left").withColumn("license_id", F.coalesce("license_id", F.lit("UNKNOWN")))
    return rows.withColumn("flags", license_flags(F.col("license_id"))).select(id_col, "license_id", "flags.*")


def summary(licensed: DataFrame) -> DataFrame:
    """(license_id, policy_status, n)."""
    return licensed.groupBy("license_id", "policy_status").agg(F.count("*").alias("n"))


def filter_by_license(licensed: DataFrame, config: dict | None = None, *, id_col: str = "article_id") -> DataFrame:
    """(id, license_id, reasons, kept, would_exclude).

    Without a configured allowed set the Creative Commons ids seen are allowed;
    they are one small aggregated row. Mode ``fail`` raises on a rejected article.
    """
    policy = policy_of(config)
    if policy["allowed_license_ids"]:
        rows = licensed.withColumn("allowed", F.array(*(F.lit(x) for x in policy["allowed_license_ids"])))
    else:
        cc = F.upper("license_id")
        seen = licensed.agg(F.collect_set(F.when(cc.startswith("CC-") | (cc == "CC0-1.0"), cc)).alias("allowed"))
        rows = licensed.crossJoin(F.broadcast(seen))
    rows = rows.withColumn("reasons", license_reasons(F.col("license_id"), policy, F.col("allowed")))
    bad = F.size("reasons") > 0
    if policy["mode"] == "fail":
        rows = rows.withColumn("reasons", F.when(bad, F.raise_error(F.concat(F.lit("licence policy rejects "), F.col(id_col).cast("string"))).cast("array<string>")).otherwise(F.col("reasons")))
    warn = F.lit(policy["mode"] == "warn")
    return rows.select(id_col, "license_id", "reasons", (~bad | warn).alias("kept"), (bad & warn).alias("would_exclude"))


def reason_counts(filtered: DataFrame) -> DataFrame:
    return filtered.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
