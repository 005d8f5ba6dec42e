"""A results root: profiles, tasks, lineages and their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLITS = "split_checksums map<string,array<string>>, train_checksums array<string>, test_checksums array<string>, eval_checksums map<string,array<string>>"
_MANIFEST = "splits struct<train_checksums_sha256:string,test_checksums_sha256:string,eval_checksums_sha256:map<string,string>>"


def _json(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return reader.json(root).withColumn("path", F.col("_metadata.file_path"))


def _place(rows: DataFrame) -> DataFrame:
    """``rows`` with profile (``flat`` outside of ``profiles``), task and lineage of ``[profiles/<profile>/]<task>/set*/<file>``."""
    part = lambda i: F.regexp_extract("path", r"(?:/profiles/([^/]+))?/([^/]+)/(set[^/]*)/[^/]+$", i)
    profile = F.regexp_extract("path", r"/profiles/([^/]+)/[^/]+/[^/]+/[^/]+$", 1)
    return rows.withColumns({"profile": F.coalesce(F.nullif(profile, F.lit("")), F.lit("flat")), "task": part(2), "lineage": part(3)}).where("lineage <> ''")


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    """(profile, task, lineage, split, article_id) of all ``splits.json`` of lineages; the older layout of three fields is read too."""
    files = _place(_json(spark, root, "splits.json", _SPLITS))
    old = F.map_concat(
        F.create_map(F.lit("train"), F.coalesce("train_checksums", F.array().cast("array<string>")), F.lit("test"), F.coalesce("test_checksums", F.array().cast("array<string>"))),
        F.map_filter(F.coalesce("eval_checksums", F.create_map().cast("map<string,array<string>>")), lambda k, v: ~k.isin("train", "test")),
    )
    splits = F.when(F.size(F.coalesce("split_checksums", F.create_map().cast("map<string,array<string>>"))) > 0, F.col("split_checksums")).otherwise(old)
    each = files.select("profile", "task", "lineage", F.explode(splits).alias("split", "ids"))
    return each.select("profile", "task", "lineage", "split", F.explode("ids").alias("article_id"))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(profile, task, lineage, split, digest) that the ``manifest.json`` of lineages claim."""
    files = _place(_json(spark, root, "manifest.json", _MANIFEST))
    claimed = F.map_concat(
        F.create_map(F.lit("train"), F.col("splits.train_checksums_sha256"), F.lit("test"), F.col("splits.test_checksums_sha256")),
        F.map_filter(F.coalesce("splits.eval_checksums_sha256", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("train", "test")),
    )
    return files.select("profile", "task", "lineage", F.explode(claimed).alias("split", "digest")).where("digest is not null")


def missing(found: DataFrame, column: str, requested: tuple[str, ...]) -> DataFrame:
    """(check, context, message) of requested names that the root lacks."""
    names = found.sparkSession.createDataFrame([(x,) for x in requested], f"{column} string")
    lack = names.join(found.select(column).distinct(), column, "left_anti")
    return lack.select(F.lit(f"requested_{column}_missing").alias("check"), F.col(column).alias("context"), F.lit(f"the results root has no such {column}").alias("message"))
