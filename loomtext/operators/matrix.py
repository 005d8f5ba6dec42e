"""Job matrices, parameter precedence, prepared rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.labels import IGNORE
from loomtext.operators.summary import glob_to_regex


def job_matrix(tasks: list[str], sets: list[str], models: DataFrame, seeds: list[int], variants: list[str], *, eval_split: str = "test", eval_sets: list[str] = ()) -> DataFrame:
    """Cross product of the lists and ``models`` (model, tokenizer, max_length)."""
    out = models.coalesce(1)
    for name, values in (("task", tasks), ("set", sets), ("seed", seeds), ("train_variant", variants)):
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    sets_ = F.array(*(F.lit(s) for s in eval_sets)) if eval_sets else F.array().cast("array<string>")
    return out.select("task", "set", "model", "tokenizer", "max_length", "seed", "train_variant", F.lit(eval_split).alias("eval_split"), sets_.alias("eval_sets"))


def run_dir(jobs: DataFrame) -> DataFrame:
    """``jobs`` with the folder of each run."""
    return jobs.withColumn("run_dir", F.concat_ws("/", F.lit("runs"), "model", "set", F.concat(F.lit("seed_"), F.col("seed").cast("string")), "train_variant"))


def resolve_hparams(jobs: DataFrame, levels: list[DataFrame], defaults: dict[str, str]) -> DataFrame:
    """(job_id, name, value): the first level that has a name wins, then the defaults.

    ``levels``: tables (job_id, name, value) from the most specific one on.
    """
    given = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).cast("string").alias("value")) for n, v in defaults.items())).cast("array<struct<name:string,value:string>>")
    out = jobs.select("job_id", F.explode(given).alias("d")).select("d.name", "d.value", "job_id").withColumn("level", F.lit(len(levels)))
    for i, level in enumerate(levels):
        out = out.unionByName(level.select("name", "value", "job_id").withColumn("level", F.lit(i)))
    # dealt first: strings are aggregated by sorting, which before the shuffle would hold a whole input split of each task and merge next to nothing
    return out.repartition("job_id", "name").groupBy("job_id", "name").agg(F.min_by("value", "level").alias("value"))


def variant_pattern(jobs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(train_variant, pattern, params): the longest matching glob wins, then the lexically first. Patterns are a few rows."""
    hits = jobs.select("train_variant").distinct().join(F.broadcast(patterns.withColumn("re", glob_to_regex(F.col("pattern")))), F.expr("rlike(train_variant, re)"))
    rank = F.row_number().over(Window.partitionBy("train_variant").orderBy(F.length("pattern").desc(), "pattern"))
    return hits.withColumn("r", rank).where("r = 1").select("train_variant", "pattern", "params")


def common_variants(sets: DataFrame) -> DataFrame:
    """Train variants that every (task, set) has."""
    n = sets.select("task", "set").distinct().agg(F.count("*").alias("n"))
    return sets.select("task", "set", "train_variant").distinct().groupBy("train_variant").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("train_variant")


def matches_policy(policy: dict[str, list]):
    """Condition of the jobs whose model is saved: conjunction of memberships, empty ones hold."""
    cond = F.lit(True)
    for name in ("task", "set", "model", "seed", "train_variant"):
        if policy.get(name):
            cond = cond & F.col(name).isin(*policy[name])
    return cond


def label_map(labels: DataFrame) -> DataFrame:
    """(label, id): ``O`` is 0, the others follow in order. Label inventories are a few rows."""
    return labels.select("label").distinct().unionByName(labels.sparkSession.createDataFrame([("O",)], "label string")).distinct().select("label", (F.row_number().over(Window.orderBy(F.col("label") != "O", "label")) - 1).alias("id"))


def token_id(token):
    """28 bits of the token's MD5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 7), 16, 10).cast("int")


def prepared(examples: DataFrame, ids: DataFrame, *, max_length: int = 510, fail_on_truncation: bool = False) -> DataFrame:
    """(example_id, input_ids, attention_mask, labels) of whole-word tokens, cut to ``max_length``.

    Token ids are hashes; a subword tokenizer is a plug-in that gives
    ``word_ids`` to :func:`loomtext.functions.labels.align_subwords` instead.
    """
    table = ids.agg(F.map_from_entries(F.collect_list(F.struct("label", "id"))).alias("table"))
    rows = examples.crossJoin(F.broadcast(table))
    unknown = F.raise_error(F.lit("unknown label")).cast("int")
    labels = F.transform("labels", lambda x: F.coalesce(F.try_element_at("table", x), unknown))
    cut = lambda c: F.slice(c, 1, max_length)
    if fail_on_truncation:
        labels = F.when(F.size("tokens") > max_length, F.raise_error(F.lit("example is longer than max_length")).cast("array<int>")).otherwise(labels)
    out = rows.select("example_id", cut(F.transform("tokens", token_id)).alias("input_ids"), cut(labels).alias("labels"))
    return out.select("example_id", "input_ids", F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"), "labels")


def prepared_subwords(
    examples: DataFrame, ids: dict[str, int], load: Callable[[], Callable[[list[str]], tuple[list[int], list[int | None]]]], *, max_length: int = 510, fail_on_truncation: bool = False
) -> DataFrame:
    """(example_id, input_ids, attention_mask, labels, n_full, truncated) by a subword tokenizer.

    ``load`` gives on each executor a function of words that returns token ids
    and the word of each (None for specials), without truncation, so an example
    is known to be cut. The first token of a word carries its label, others -100.
    """
    kind = examples.schema["example_id"].dataType.simpleString()

    def run(batches):
        encode = load()
        for pdf in batches:
            rows = []
            for example, tokens, labels in zip(pdf["example_id"], pdf["tokens"], pdf["labels"], strict=True):
                input_ids, words = encode(list(tokens))
                cut = len(input_ids) > max_length
                if cut and fail_on_truncation:
                    raise ValueError(f"example {example} is longer than max_length")
                own = [IGNORE if w is None or (i and w == words[i - 1]) else ids[labels[w]] for i, w in enumerate(words[:max_length])]
                rows.append((example, input_ids[:max_length], [1] * len(own), own, len(input_ids), cut))
            yield pd.DataFrame(rows, columns=["example_id", "input_ids", "attention_mask", "labels", "n_full", "truncated"])

    schema = f"example_id {kind}, input_ids array<int>, attention_mask array<int>, labels array<int>, n_full int, truncated boolean"
    return examples.select("example_id", "tokens", "labels").mapInPandas(run, schema)


def padded(rows: DataFrame, column: str, pad: int, batch: str | None = None) -> DataFrame:
    """``rows`` with the arrays of each batch filled up to its longest one."""
    filled = lambda most: F.concat(column, F.array_repeat(F.lit(pad), (most - F.size(column)).cast("int")))
    if batch:
        return rows.withColumn(column, filled(F.max(F.size(column)).over(Window.partitionBy(batch))))
    most = rows.agg(F.max(F.size(column)).alias("longest"))
    return rows.crossJoin(F.broadcast(most)).withColumn(column, filled(F.col("longest"))).drop("longest")


def fingerprint(rows: DataFrame, id_col: str = "example_id") -> DataFrame:
    """(n, digest) of prepared rows: each row's SHA-256, combined in the order of ids within groups of their MD5, then over groups."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns))).cast("binary"), 256)
    key = F.col(id_col).cast("string")
    both = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), "").cast("binary"), 256)
    part = rows.select(F.left(F.md5(key.cast("binary")), F.lit(3)).alias("g"), key.alias("id"), row.alias("h")).groupBy("g").agg(F.count("*").alias("n"), both(F.struct("id", "h")).alias("h"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), both(F.struct("g", "h")).alias("digest"))
