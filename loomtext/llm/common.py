"""Shared plumbing: table loading, shared-folder materialisation, Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.shared import bounded_batches, discard, materialise, scratch, shared_dir

__all__ = ["bounded_batches", "bounds", "discard", "materialise", "runs", "sampled", "scratch", "shared_dir", "skew_join", "slices", "table", "utf8_column"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that :func:`skew_join` deals over several tasks at most, and the rows below which no key is.
HOT_KEYS, HOT_ROWS = 2000, 200
#: Rows that are broadcast as a whole, some 20 MB.
SMALL_ROWS = 200_000


def skew_join(rows: DataFrame, other: DataFrame, key: str, count: str, total: int, by: Column, how: str = "inner", *, small: bool = False) -> DataFrame:
    """``rows`` joined with ``other``, which has one row for each key and the number of ``rows`` of that key in ``count``.

    Keys of ``total / HOT_KEYS`` rows or more are dealt over several tasks by the
    hash of ``by``, their row of ``other`` once to each. There are ``HOT_KEYS`` of
    them at most, since ``total`` counts ``rows``, so their list is broadcast.
    With ``small``, ``other`` is a written table of a few fixed-width columns,
    which is broadcast as a whole if it has ``SMALL_ROWS`` rows or less.
    """
    if small and other.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(other), key, how)
    most = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    hot = other.where(F.col(count) > most).select(key, parts.alias("_parts"))
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts"))).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_parts")
    each = other.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(each, [key, "_part"], how).drop("_part")


def sampled(ids: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the distinct non-null ids of the one column, all if there are fewer; chosen by hash, without a sort."""
    name = ids.columns[0]
    ids = materialise(ids.where(F.col(name).isNotNull()).distinct(), "ids")
    n = ids.count()
    return ids if n <= most else ids.where(F.pmod(F.xxhash64(name, F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte values and row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int):
    """Row ranges of at most ``most_bytes`` each (a longer row stands alone)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def runs(batches, n_keys: int):
    """Record batches cut so that rows with equal leading ``n_keys`` columns come together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(n_keys)]
        same = np.ones(batch.num_rows, bool)
        for i, v in enumerate(last):
            same &= batch.column(i).to_numpy(zero_copy_only=False) == v
        cut = batch.num_rows - int(same.sum())
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = []
        elif rest and [rest[0].column(i)[0].as_py() for i in range(n_keys)] != last:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def bounds(table: pa.Table, n_keys: int) -> np.ndarray:
    """Offsets of the groups of a table that is sorted by its leading columns."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for i in range(n_keys):
        v = table.column(i).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
