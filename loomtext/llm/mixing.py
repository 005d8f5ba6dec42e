"""Mixing to target weights: raked cell weights and calibrated sampling, in DataFrame operations only.

Documents are counted into cells of source, language and topic. Iterative
proportional fitting scales the cells' token weights to each marginal in turn,
``ROUNDS`` times. A document's probability is its cell's raked weight per token,
times the one factor that makes the expected tokens ``RATE`` of all (with
probabilities of at most 1), and documents are sampled by a hash of their id.

Marginals default to the observed token shares to the power of ``FLATTEN``,
normalised; other targets are given as tables of (value, share).

Defined cases: a null source, language or topic is a value of its own, apart from
the text ``(null)``; a null text has no tokens and the topic of an empty one; very
long texts are counted whole; cells without tokens have weight per token 1; values
missing from given targets keep their observed share of what the targets leave;
repeated ids are sampled alike; a null id is hashed as the text ``null``; columns
of the documents keep their names and values whatever they are, since they travel
in one struct; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialise

ROUNDS = 20
FLATTEN = 0.7
RATE = 0.5
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")
NULL = "(null)"
LIKE_NULL = r"\A(\(+null\))\z"
#: Rounds between two cuts of the lineage.
CUT = 5
#: Cells of one partition; up to so many cells are raked without any exchange.
CELLS = 100_000
BROADCAST_ROWS = 1_000_000

WORDS = r"[^ \t\n\x0B\f\r]+"
#: Topic by the first marker that a text contains.
TOPICS = (("legal", "icense"), ("contact", "@"), ("table", " | "), ("list", "\n- "))


def topic_of(text: F.Column) -> F.Column:
    text = F.coalesce(text, F.lit(""))
    out = F.when(text.contains(TOPICS[0][1]), TOPICS[0][0])
    for name, marker in TOPICS[1:]:
        out = out.when(text.contains(marker), name)
    return out.otherwise("prose")


def tokens_of(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def value_of(c: F.Column) -> F.Column:
    """A value as text; null is ``NULL``, and texts that look like it get one more bracket."""
    return F.coalesce(F.regexp_replace(c.cast("string"), LIKE_NULL, "($1"), F.lit(NULL))


def with_cells(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: F.Column | None = None) -> DataFrame:
    """(row, mix_source, mix_lang, mix_topic, n_tokens, draw) of ``docs``, whose own columns are the struct ``row``."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), value_of(F.col(source_col)).alias("mix_source"), value_of(F.col(lang_col)).alias("mix_lang"),
        value_of(topic_of(F.col(text_col)) if topic is None else topic).alias("mix_topic"), tokens_of(F.col(text_col)).alias("n_tokens"), draw(id_col).alias("draw"),
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, *, rounds: int = ROUNDS, flatten: float = FLATTEN) -> DataFrame:
    """``cells`` (mix_source, mix_lang, mix_topic, tokens) with ``weight``, raked to the marginals."""
    w = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        w = _with_target(w, d, (targets or {}).get(d), flatten)
    few = cells.count() <= CELLS
    for r in range(rounds):
        for d in DIMENSIONS:
            if few:
                w = w.withColumn("own", F.sum("weight").over(Window.partitionBy(f"mix_{d}")))
            else:  # one value may have a large share of the cells: only its sum meets in one place
                w = w.join(w.groupBy(f"mix_{d}").agg(F.sum("weight").alias("own")), f"mix_{d}")
            w = w.withColumn("weight", F.when(F.col("own") > 0, F.col("weight") * F.try_divide(f"target_{d}", "own")).otherwise(0.0)).drop("own")
            if not few:
                w = materialise(w, "raked")
        if few and r % CUT == CUT - 1 and r < rounds - 1:
            w = _few(materialise(w, "raked"))
    return w


def _few(cells: DataFrame) -> DataFrame:
    """In as few partitions as hold ``CELLS`` each; windows over one partition need no exchange."""
    return cells.coalesce(max(1, math.ceil(cells.count() / CELLS)))


def _with_target(cells: DataFrame, d: str, target: DataFrame | None, flatten: float) -> DataFrame:
    """``cells`` with the token total that each value of dimension ``d`` is raked to."""
    value, name = f"mix_{d}", f"target_{d}"
    sums = cells.groupBy(value).agg(F.sum("tokens").cast("double").alias("n"))
    if target is None:
        sums = sums.withColumn("flat", F.when(F.col("n") > 0, F.pow("n", F.lit(flatten))).otherwise(0.0))
        total, flat = sums.agg(F.sum("n"), F.sum("flat")).first()
        sums = sums.withColumn(name, F.lit(total or 0.0) * F.col("flat") / F.lit(flat) if flat else F.lit(0.0))
    else:
        given = target.select(value_of(F.col("value")).alias(value), F.col("share").cast("double").alias("share"))
        sums = sums.join(given, value, "left")
        total, shares, rest = sums.agg(F.sum("n"), F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("n")))).first()
        left = max(0.0, 1 - (shares or 0.0))
        sums = sums.withColumn(name, F.lit(total or 0.0) * F.coalesce("share", F.lit(left) * F.col("n") / F.lit(rest) if rest else F.lit(0.0)))
    return cells.join(sums.select(value, name), value)


def residuals(raked: DataFrame) -> dict[str, float]:
    """For each dimension, the largest deviation of a raked marginal from its target, as a share of all tokens."""
    total = raked.agg(F.sum("weight")).first()[0] or 1.0
    by = {d: raked.groupBy(f"mix_{d}").agg((F.abs(F.sum("weight") - F.max(f"target_{d}")) / total).alias("off")) for d in DIMENSIONS}
    return {d: df.agg(F.max("off")).first()[0] or 0.0 for d, df in by.items()}


def calibrate(raked: DataFrame, rate: float = RATE) -> DataFrame:
    """Cells with ``probability``: min(1, c * weight / tokens), c such that ``rate`` of the tokens are expected.

    The factor is raised until the cells it brings to probability 1 stay the
    same; each step is an aggregate of one row, so no task holds all cells.
    """
    ratio = F.coalesce(F.try_divide(F.col("weight"), F.col("tokens").cast("double")), F.lit(1.0))
    cells = raked.withColumn("ratio", ratio)
    tokens, mass = F.col("tokens").cast("double"), F.col("tokens") * F.col("ratio")
    factor, full = 0.0, -1
    while True:
        capped = F.lit(factor) * F.col("ratio") > 1
        total, done, rest, n = cells.agg(F.sum(tokens), F.sum(F.when(capped, tokens)), F.sum(F.when(~capped, mass)), F.count_if(capped)).first()
        if not rest or n == full:
            break
        factor, full = (rate * total - (done or 0.0)) / rest, n
    if not total:
        factor = 1.0
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(factor) * F.col("ratio")))


def draw(id_col: str, seed: str = SEED) -> F.Column:
    """Uniform number in [0, 1) of an id, the same on every engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, *, rate: float = RATE, rounds: int = ROUNDS, flatten: float = FLATTEN, **columns) -> DataFrame:
    """(row, mix_source, mix_lang, mix_topic, n_tokens, probability, sampled); ``row`` holds the columns of ``docs``.

    One pass counts the cells (partial aggregation before the shuffle, so a hot
    source is no burden), one pass draws; texts aren't shuffled.
    """
    dealt = with_cells(docs, **columns)
    names = [f"mix_{d}" for d in DIMENSIONS]
    cells = materialise(dealt.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "cells")
    weights = materialise(calibrate(materialise(rake(_few(cells), targets, rounds=rounds, flatten=flatten), "raked"), rate).select(*names, "probability"), "weights")
    weights = F.broadcast(weights) if weights.count() <= BROADCAST_ROWS else weights
    out = dealt.join(weights, names, "left")
    return out.withColumn("sampled", F.coalesce(F.col("draw") < F.col("probability"), F.lit(False))).drop("draw")


def sample_mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """The sampled documents, with the columns of ``docs``."""
    return mixed(docs, targets, **options).where("sampled").select("row.*")
