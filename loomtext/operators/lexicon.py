"""Species lexicons, keys, switch pools and the coverage plan."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import SPECIES, abbreviation, is_abbreviated, mentions, species_key
from loomtext.operators.spans import overlapping, phrase
from loomtext.shared import bounded_batches, materialise

DEFAULT_SCORE = 10**12


def with_abbreviations(names: DataFrame, *, col: str = "name") -> DataFrame:
    """Distinct names and the ``G. epithet`` forms of those of two words or more."""
    short = names.where(F.size(F.split(col, " ")) > 1).select(abbreviation(F.col(col)).alias(col))
    return names.select(col).unionByName(short).distinct()


def resolve_codes(config: dict | None, task: str, default: tuple[str, ...]) -> tuple[str, ...]:
    """Codes of a task: its own entry, else ``default``, else ``*``, else the built-in ones; upper-cased, sorted."""
    config = config or {}
    for key in (task, "default", "*"):
        if value := config.get(key):
            values = [value] if isinstance(value, str) else list(value)
            return tuple(sorted({str(v).strip().upper() for v in values if str(v).strip()}))
    return default


def known_mentions(docs: DataFrame, lexicon: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, name) of mentions that the lexicon has. The lexicon may be of any size; Spark picks the join."""
    found = docs.select(id_col, F.posexplode(mentions(F.col(text_col))).alias("ord", "name"))
    return found.join(lexicon.select("name"), "name", "left_semi").select(id_col, "ord", "name")


_MENTION = re.compile(SPECIES.encode())


def mentions_at(docs: DataFrame, *, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, at, name) of the mentions in texts whose tokens are a space apart; ``at`` is the number of the first of a mention's two tokens."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows, at, names = [], [], []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                text = b" ".join((text or b"").split())
                if found := [(m.start(), m.group()) for m in _MENTION.finditer(text)]:
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                    rows += [i] * len(found)
                    at += np.searchsorted(spaces, [x for x, _ in found]).tolist()
                    names += [name for _, name in found]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(at, pa.int32()), pa.array(names, pa.binary()).cast(pa.string())], names=[id_col, "at", "name"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, at int, name string")


def window_mentions(windows: DataFrame, found: DataFrame, lexicon: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    """(example_id, ord, name): :func:`known_mentions` of the texts of windows, from those of their articles (:func:`mentions_at`).

    A mention reaches over the end of one token and the beginning of the next, and no
    two share a character, so a window has those of its article whose tokens it holds.
    """
    known = found.join(lexicon.select("name"), "name", "left_semi").select(id_col, F.col("at").alias("start"), (F.col("at") + 2).alias("end_excl"), "name")
    met = overlapping(windows.select("example_id", id_col, "s", "e"), known, id_col=id_col)
    return met.where((F.col("start") >= F.col("s")) & (F.col("end_excl") <= F.col("e") + 1)).select("example_id", F.col("start").alias("ord"), "name")


def species_keys(docs: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """Distinct (id, initial, epithet) of the known mentions."""
    key = species_key(F.col("name"))
    known = known_mentions(docs, lexicon, **options)
    return known.select(known.columns[0], key.alias("k")).where("k is not null").select(known.columns[0], "k.initial", "k.epithet").distinct()


def extract_lexicon(tokens: DataFrame, spans: DataFrame, *, species_codes: tuple[str, ...] = ("SPEC",), strain_codes: tuple[str, ...] = ("STRA",), id_col: str = "article_id") -> DataFrame:
    """(source, code, phrase, species_pattern_match, n_occurrences, in_extra_species, in_reserved_strains).

    Membership flags come from the grouped rows themselves by a window over the
    phrase, after occurrences were pre-aggregated.
    """
    own = spans.join(tokens, id_col).select("label4", phrase(F.col("tokens"), F.col("start"), F.col("length")).alias("phrase"))
    source = F.array(F.when(F.col("label4").isin(*species_codes), "species"), F.when(F.col("label4").isin(*strain_codes), "strain"))
    rows = own.select(F.explode(F.filter(source, lambda x: x.isNotNull())).alias("source"), F.col("label4").alias("code"), "phrase")
    match = F.col("phrase").rlike(f"^(?:{SPECIES})$")
    counted = rows.groupBy("source", "code", "phrase").agg(F.count("*").alias("n_occurrences")).withColumn("species_pattern_match", match)
    same = Window.partitionBy("phrase")
    return counted.withColumn("in_extra_species", F.max((F.col("source") == "species") & F.col("species_pattern_match")).over(same)).withColumn("in_reserved_strains", F.max(F.col("source") == "strain").over(same))


def lexicon_keys(extracted: DataFrame) -> DataFrame:
    """(initial, epithet, full_forms, abbreviations, orphan_abbreviation, representative) of the extra species."""
    names = extracted.where("source = 'species' and species_pattern_match").select("phrase").distinct()
    keyed = names.select("phrase", species_key(F.col("phrase")).alias("k"), is_abbreviated(F.col("phrase")).alias("short")).where("k is not null")
    forms = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("phrase"))))
    out = keyed.groupBy("k.initial", "k.epithet").agg(forms(~F.col("short")).alias("full_forms"), forms(F.col("short")).alias("abbreviations"))
    return out.withColumn("orphan_abbreviation", F.size("full_forms") == 0).withColumn("representative", F.coalesce(F.get("full_forms", F.lit(0)), F.get("abbreviations", F.lit(0))))


def full_pool(lexicon: DataFrame) -> DataFrame:
    """Names of two words that aren't abbreviated."""
    return lexicon.where((F.size(F.split("name", " ")) == 2) & ~is_abbreviated(F.col("name"))).select("name").distinct()


def restricted_pool(pool: DataFrame, disallowed: DataFrame) -> DataFrame:
    """Two-word names of the pool whose key isn't among (initial, epithet) of ``disallowed``."""
    keyed = pool.select("name", species_key(F.col("name")).alias("k")).where("k is not null").select("name", "k.initial", "k.epithet")
    return keyed.join(disallowed.select("initial", "epithet"), ["initial", "epithet"], "left_anti").select("name")


def pool_for_mode(mode: str, pool: DataFrame, keys: DataFrame) -> DataFrame:
    """Switch pool: ``full``, ``curated_only`` (representatives) or ``exclude_curated``."""
    if mode == "full":
        return pool.select("name")
    if mode == "curated_only":
        return keys.select(F.trim("representative").alias("name")).where("name <> ''").distinct()
    if mode == "exclude_curated":
        return restricted_pool(pool, keys)
    raise ValueError(f"unknown pool mode: {mode}")


def _ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with its 0-based rank in a total order.

    Rows are range-partitioned, sorted and numbered within their partition, and
    written so: both reads below see one numbering, whatever range bounds or
    coalescing another evaluation would choose. Partition sizes (a row for each
    partition) give the offsets, so no task holds all rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranked")
    first = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    offset = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = first.select("_p", "_first", F.coalesce(offset, F.lit(0)).alias("_offset"))
    return dealt.join(F.broadcast(offsets), "_p").withColumn("rank", F.col("_offset") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_offset")


def coverage_plan(candidates: DataFrame, keys: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(initial, epithet, representative, example_id, reason): targets in key order meet candidates in (score, id) order.

    ``candidates``: example_id. Surplus targets have reason ``no_candidate_record``.
    """
    rows = candidates.select("example_id").where("coalesce(example_id, '') <> ''").distinct()
    rows = rows.join(scores, "example_id", "left") if scores is not None else rows.withColumn("score", F.lit(None).cast("bigint"))
    rows = _ranked(rows.withColumn("score", F.coalesce("score", F.lit(DEFAULT_SCORE))), "score", "example_id").select("rank", "example_id")
    targets = _ranked(keys.where("trim(representative) <> ''").select("initial", "epithet", F.trim("representative").alias("representative")), "initial", "epithet")
    out = targets.join(rows, "rank", "left")
    return out.select("initial", "epithet", "representative", "example_id", F.when(F.col("example_id").isNull(), "no_candidate_record").alias("reason"))
