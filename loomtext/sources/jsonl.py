"""JSON lines, examples with their metadata, files and their digests."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.shared import materialise
from loomtext.sources.conll import read_conll

#: Ids of lines that are numbered together; rows that are broadcast at most.
_PART, _FEW = 4096, 10_000

STABLE = ("example_id", "tokens", "labels", "checksum", "variant", "category")
META = ("checksum", "variant", "category", "reason", "forced_relevant", "types_raw", "types_pooled", "token_count")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are ignored."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(rows: DataFrame, path: str, *, order_by: str | None = None) -> None:
    """JSON lines with sorted keys; nulls are written."""
    names = sorted(rows.columns)
    if order_by:
        rows = rows.repartitionByRange(order_by).sortWithinPartitions(order_by)
    rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def dump_document(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document: written beside its place and renamed, so that no reader sees half of it."""
    target, draft = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.draft"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(draft)
    stream.write(bytearray(dump_document(value).encode()))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"cannot write {path}")


def write_named(rows: DataFrame, root: str, *order_by: str) -> None:
    """Text files ``<root>/<name>`` of rows (name, value): the values of a name, in order, are the lines of its file.

    Spark writes each file in a task of its own, as a part of a draft folder; the
    driver renames the parts, so it sees names and no values.
    """
    draft = f"{root}/_draft"
    rows.repartition("name").sortWithinPartitions("name", *order_by).select("name", "value").write.partitionBy("name").text(draft)
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(at(draft)):
        kind, _, name = folder.getPath().getName().partition("=")
        if kind == "name":
            target = at(f"{root}/{unquote(name)}")
            fs.mkdirs(target.getParent())
            (part,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if not fs.rename(part, target):
                raise OSError(f"cannot write {target}")
    fs.delete(at(draft), True)


def few(rows: DataFrame) -> DataFrame:
    """``rows``, counted first and broadcast if they are few: a key of many rows on the other side stays where it is."""
    return F.broadcast(rows) if rows.count() <= _FEW else rows


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, idx, value): the lines of each file that aren't blank, with their numbers.

    Byte ranges of a file are read by several tasks, each once, and its lines are
    written as they come: a range's own lines have consecutive ids, so it takes
    the first one and the lines of the ranges before to number them.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").cast("bigint").alias("block")]
    lines = lines.select(*place, "value").where(F.trim("value") != "").coalesce(8 * spark.sparkContext.defaultParallelism)
    lines = materialise(lines.select("*", F.monotonically_increasing_id().alias("at")), "lines")
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = lambda at: F.floor(at / F.lit(_PART))
    ranges = sizes.withColumn("by", before - F.col("first")).select("path", "block", "by", F.explode(F.sequence(part(F.col("first")), part(F.col("first") + F.col("n") - 1))).alias("part"))
    numbered = lines.withColumn("part", part(F.col("at"))).join(few(ranges), ["path", "block", "part"])
    return numbered.select("path", (F.col("at") + F.col("by")).cast("int").alias("idx"), "value")


def stable_rows(rows: DataFrame) -> DataFrame:
    """Projection to the stable columns, those it lacks as nulls."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in STABLE))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def discover_sets(spark: SparkSession, root: str, *, tasks: tuple[str, ...] = (), variants: tuple[str, ...] = ()) -> DataFrame:
    """(path, task, set, split, variant) of ``<task>/set*/<split>/<variant>.set`` and ``<task>/<split>/<variant>.set``; a listing without contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.set").load(root).select("path")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(?:(set[^/]*)/)?([^/]+)/([^/]+)\.set$", i)
    out = files.select("path", part(1).alias("task"), F.nullif(part(2), F.lit("")).alias("set"), part(3).alias("split"), part(4).alias("variant")).where("task <> 'profiles'")
    if tasks:
        out = out.where(F.col("task").isin(*tasks))
    return out.where(F.col("variant").isin(*variants)) if variants else out


def with_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows: examples and the rows of the ``.meta.jsonl`` beside each ``.set``, zipped by position.

    A set whose metadata has another number of rows is an error; a set without
    metadata gets ids ``ex_%08d`` and null metadata.
    """
    examples = read_conll(spark, path, glob="*.set").withColumn("stem", F.regexp_replace("path", r"\.set$", ""))
    kept = "struct<example_id:string,checksum:string,variant:string,category:string,reason:string,forced_relevant:boolean,types_raw:array<string>,types_pooled:array<string>,token_count:int>"
    meta = numbered_lines(spark, path, "*.meta.jsonl").select(F.regexp_replace("path", r"\.meta\.jsonl$", "").alias("stem"), "idx", F.from_json("value", kept).alias("m"))
    # a set's rows don't meet in a task for this
    has = few(meta.select("stem").distinct().withColumn("has_meta", F.lit(True)))
    both = examples.join(meta, ["stem", "idx"], "full").join(has, "stem", "left")
    bad = F.col("tokens").isNull() | (F.col("has_meta").isNotNull() & F.col("m").isNull())
    checked = F.when(bad, F.raise_error(F.concat(F.lit("examples and metadata differ in number: "), "stem")).cast("string")).otherwise(F.coalesce("m.example_id", F.format_string("ex_%08d", "idx")))
    return both.select("stem", "idx", checked.alias("example_id"), "tokens", "labels", *(F.col(f"m.{c}").alias(c) for c in META))


def write_stable(rows: DataFrame, path: str) -> None:
    """The stable columns as JSON lines in the order of their ids."""
    write_jsonl(stable_rows(rows), path, order_by="example_id")


def to_arrow(rows: DataFrame):
    """The stable columns in the order of their ids as one Arrow table on the driver, for libraries that read Arrow; for sets that fit there."""
    return stable_rows(rows).orderBy("example_id").toArrow()
