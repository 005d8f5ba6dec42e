"""Span annotations: curation maps, BIO labels, overlap with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.labels import label_code
from loomtext.functions.let import let


def spans_from_map(articles: DataFrame, *, id_col: str = "article_id", map_col: str = "curation") -> DataFrame:
    """(id, ord, source_key, label4, start, length, end_excl) of a map from keys to ``start+length`` locations."""
    rows = F.flatten(F.transform(F.map_entries(map_col), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("key"), v.alias("loc")))))
    flat = articles.select(id_col, F.posexplode(rows).alias("ord", "x"))
    start = F.split_part("x.loc", F.lit("+"), F.lit(1)).cast("int")
    length = F.split_part("x.loc", F.lit("+"), F.lit(2)).cast("int")
    return flat.select(id_col, "ord", F.col("x.key").alias("source_key"), label_code(F.col("x.key")).alias("label4"), start.alias("start"), length.alias("length"), (start + length).alias("end_excl"))


def bio_labels(tokens: DataFrame, spans: DataFrame, mapping: dict[str, str] | None = None, *, id_col: str = "article_id", split: Column | None = None) -> DataFrame:
    """(id, tokens, labels): spans in the order of ``ord``, later ones overwrite.

    With a mapping (an empty one too), a label that it lacks or maps to ``O`` is
    skipped. A span beyond the tokens is an error. Spans meet the number of tokens
    of their article, so a reader of labels alone shuffles no token, and labels
    are put together from the gaps between labelled tokens, in one pass. ``split`` makes
    the tokens of rows that have none yet, so that texts are shuffled as they are.
    """
    label = F.col("label4")
    if mapping is not None:
        label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), F.col("label4")) if mapping else F.lit(None).cast("string"), F.lit("O"))
    own = spans.withColumn("label", label).where("label <> 'O' and length > 0")
    lists = own.groupBy(id_col).agg(F.collect_list(F.struct("start", "length", "ord", "label")).alias("own"))
    if split is not None:
        met = tokens.join(lists, id_col, "left").select(id_col, "own", split.alias("tokens"))
        return met.select(id_col, "tokens", _filled(F.col("own"), F.size("tokens")).alias("labels"))
    counted = tokens.select(id_col, "tokens", F.size("tokens").alias("_n")).join(lists, id_col, "left")
    return counted.select(id_col, "tokens", _filled(F.col("own"), F.col("_n")).alias("labels"))


def _filled(spans: Column, n: Column) -> Column:
    """``n`` labels: those of the spans' tokens, of several on one token that of the last ``ord``, and ``O`` between them."""

    def cell(x: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), x["ord"].alias("ord"), F.concat(F.when(pos == x["start"], "B-").otherwise("I-"), x["label"]).alias("label"))

    cells = F.flatten(F.transform(spans, lambda x: F.transform(F.sequence(x["start"], x["start"] + x["length"] - 1), lambda pos: cell(x, pos))))
    last = let(F.sort_array(F.filter(cells, lambda c: c["pos"] >= 0)), lambda own: F.filter(own, lambda c, i: F.coalesce(F.get(own, i + 1)["pos"] != c["pos"], F.lit(True))))
    gap = lambda k: F.array_repeat(F.lit("O"), k)

    def fill(own: Column) -> Column:
        far = F.coalesce(F.get(own, F.size(own) - 1)["pos"], F.lit(-1))
        parts = F.transform(own, lambda c, i: F.concat(gap(c["pos"] - F.coalesce(F.get(own, i - 1)["pos"], F.lit(-1)) - 1), F.array(c["label"])))
        return F.when(far >= n, F.raise_error(F.lit("span beyond the tokens")).cast("array<string>")).otherwise(F.concat(F.flatten(parts), gap(n - far - 1)))

    return F.when(spans.isNull(), gap(n)).otherwise(let(last, fill))


def phrase(tokens: Column, start: Column, length: Column) -> Column:
    """Tokens of a span joined by spaces; an over-run is cut off."""
    return F.array_join(F.slice(tokens, start + 1, F.greatest(length, F.lit(0))), " ")


def span_phrases(tokens: DataFrame, spans: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    """Distinct (id, label4, phrase)."""
    return spans.join(tokens, id_col).select(id_col, "label4", phrase(F.col("tokens"), F.col("start"), F.col("length")).alias("phrase")).distinct()


#: Tokens of a bin of :func:`overlapping`.
BIN = 256


def overlapping(windows: DataFrame, spans: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    """(id, s, e, source_key, label4, start, length, end_excl) of spans that overlap the inclusive window [s, e].

    Windows and spans meet in bins of ``BIN`` tokens of their article, and only in
    the first bin that both reach, so each pair is made once: the work is that of
    the bins and of the pairs, however many windows and spans an article has.
    """
    bins = lambda first, last: F.explode(F.sequence(F.floor(first / F.lit(BIN)), F.floor(F.greatest(first, last) / F.lit(BIN)))).alias("bin")
    w = windows.select("*", F.floor(F.col("s") / F.lit(BIN)).alias("w_bin"), bins(F.col("s"), F.col("e")))
    x = spans.select("*", F.floor(F.col("start") / F.lit(BIN)).alias("x_bin"), bins(F.col("start"), F.col("end_excl") - 1))
    met = w.join(x, [id_col, "bin"]).where(F.col("bin") == F.greatest("w_bin", "x_bin"))
    return met.where((F.col("end_excl") > F.col("s")) & (F.col("start") < F.col("e") + 1)).drop("bin", "w_bin", "x_bin")
