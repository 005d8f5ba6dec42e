"""Stateless operators over streams.

Variants, labels and licences of a record depend on that record alone (draws are
keyed by its id), so the batch expressions run unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import license_flags, license_id, phrase_order
from loomtext.operators.variants import scramble


def scrambled_stream(stream: DataFrame, seed: int, *, id_col: str = "example_id", text_col: str = "text", phrases_col: str = "phrases") -> DataFrame:
    """A stream with ``scrambled``: the identifiers of each record permuted as in the batch operator."""
    rows = stream.withColumn(phrases_col, phrase_order(F.col(phrases_col)))
    return scramble(rows, seed, id_col=id_col, text_col=text_col, phrases_col=phrases_col)


def licensed_stream(stream: DataFrame, *, raw_col: str = "license") -> DataFrame:
    """A stream with the normalised licence and its policy flags."""
    return stream.withColumn("license_id", license_id(F.col(raw_col))).withColumn("flags", license_flags(F.col("license_id")))
