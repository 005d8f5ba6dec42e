"""From raw documents to packed token ids, stage by stage.

Every stage judges each row by itself: rows that repeat an id, and rows of null
id, stay or go by their own text. Null and empty texts are rejected or kept like
any other by the classifier, are no copies of each other and contaminated by
nothing, and have no tokens. Columns of other names than those of ``documents``
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import materialise, table
from loomtext.llm.decontaminate import drop_contaminated
from loomtext.llm.minhash import drop_near_duplicates
from loomtext.llm.mixing import sample_mix
from loomtext.llm.packing import pack
from loomtext.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id (a null id comes last); word shingles link from a similarity of 0.8 on."""
    return drop_near_duplicates(docs, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages above the rule's share go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked weights of source, language and topic; rows of one id are sampled alike."""
    return sample_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids; a null id is carried as null."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each stage's rows are written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
