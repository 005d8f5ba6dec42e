"""Views that give the operators data from the plain tables (documents, labels, events, lineitem)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import SPECIES, mentions, words
from loomtext.shared import bounded_batches, materialise

LEXICON_MIN = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, tokens) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), words(F.col("text")).alias("tokens"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): candidate mentions with a plain space that occur at least ``LEXICON_MIN`` times."""
    found = table(spark, sf_dir, "documents").select(F.explode(mentions(F.col("text"))).alias("name"))
    return found.where("name like '% %'").groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= LEXICON_MIN).select("name")


# the look behind comes after the capital, by which places are found fast
_PAIR = re.compile(rf"{SPECIES[:5]}(?<!\S{SPECIES[:5]}){SPECIES[5:]}(?!\S)".encode())
_MENTION = re.compile(SPECIES.encode())


def _pairs(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Places and texts of adjacent tokens of a mention's form; tokens are a space apart."""
    found = [(m.start(), m.group()) for m in _PAIR.finditer(text)]
    return np.array([at for at, _ in found], np.int64), [name for _, name in found]


def _found(docs: DataFrame) -> DataFrame:
    """(article_id, start, name, n), in one pass over whole texts: adjacent tokens of a mention's form, tokens with a digit (without name), and how often each mention occurs (without article and start)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows, starts, names, counts = [], [], [], Counter()
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                counts.update(_MENTION.findall(text or b""))
                # bytes split at the same white space as tokens do
                text = b" ".join((text or b"").split())
                places, own = _pairs(text)
                plain = np.frombuffer(text, np.uint8)
                digits = np.flatnonzero((plain >= 48) & (plain <= 57))
                if len(places) or len(digits):
                    spaces = np.flatnonzero(plain == 32)
                    digits = np.unique(np.searchsorted(spaces, digits))
                    rows.append(np.full(len(places) + len(digits), i))
                    starts += [np.searchsorted(spaces, places), digits]
                    names += [*own, *[None] * len(digits)]
            rows, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts))
            counts = {name: n for name, n in counts.items() if b" " in name}
            none = lambda n, kind: pa.nulls(n, kind)
            columns = [
                pa.concat_arrays([b.column(0).take(pa.array(rows)), none(len(counts), b.column(0).type)]),
                pa.concat_arrays([pa.array(starts.astype(np.int32)), none(len(counts), pa.int32())]),
                pa.array([*names, *counts], pa.binary()).cast(pa.string()),
                pa.concat_arrays([none(len(rows), pa.int64()), pa.array(list(counts.values()), pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["article_id", "start", "name", "n"])

    return docs.mapInArrow(run, f"article_id {docs.schema['article_id'].dataType.simpleString()}, start int, name string, n bigint")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, ord, source_key, label4, start, length, end_excl).

    Adjacent tokens that spell a lexicon name are species spans, tokens with a
    digit strain spans; strains come later in ``ord``.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    # written, as it is read for mentions, pairs and digits
    found = materialise(_found(docs), "found")
    names = found.where("start is null").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= LEXICON_MIN)
    found = found.where("start is not null")
    # names are mentions, so pairs of another form than a mention's needn't meet them
    species = found.where("name is not null").join(names, "name", "left_semi").select("article_id", F.lit("SPEC/name").alias("source_key"), F.lit("SPEC").alias("label4"), "start", F.lit(2).alias("length"))
    strain = found.where("name is null").select("article_id", F.lit("STRA/digit").alias("source_key"), F.lit("STRA").alias("label4"), "start", F.lit(1).alias("length"))
    both = species.unionByName(strain)
    order = F.when(F.col("label4") == "SPEC", 0).otherwise(1).cast("bigint") * 1_000_000_000 + F.col("start")
    return both.select("article_id", order.alias("ord"), "source_key", "label4", "start", "length", (F.col("start") + F.col("length")).alias("end_excl"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, tokens, labels)."""
    from loomtext.operators.spans import bio_labels

    return bio_labels(articles(spark, sf_dir), spans(spark, sf_dir))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows made of events."""
    e = table(spark, sf_dir, "events")
    p, r = (F.col("event_id") % 97) / 96.0, (F.col("event_id") % 89) / 88.0
    rows = e.select(
        F.col("event_id").alias("ord"), F.lit("task1").alias("task"), F.concat(F.lit("set"), (F.col("user_id") % 2 + 1).cast("string")).alias("set"), (F.col("user_id") % 5).cast("int").alias("seed"),
        F.col("event_type").alias("model_id"), F.when(F.col("event_id") % 2 == 0, "all").otherwise("none").alias("train_variant"), F.lit("test").alias("eval_split"),
        F.when(F.col("event_id") % 3 == 0, "augmented_exclusive").otherwise("unaugmented").alias("eval_set"), (F.col("event_id") % 4 + 1).cast("int").alias("epoch"),
        p.alias("precision"), r.alias("recall"), F.col("value").alias("loss"), F.col("ts").alias("run_updated_at"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rows.withColumn("f1", f1)


def classified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, y_true, y_pred, loss) of labels."""
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))
    return d.withColumn("loss", F.abs(F.col("y_true") - F.col("y_pred")) + 0.1)
