"""Integer vectors in blocks: what the operators on whole-number vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import bounded_batches

#: Vectors of one block.
BLOCK = 4096


def integer_vectors(vectors: DataFrame, scale: int, limit: int, *, id_col: str, vector_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, kept columns, x): ``floor(scale * component)`` of the vectors without null or non-finite components.

    Vectors with an integer of ``limit`` or more, whose squared distances may not fit a long, are left out.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(limit // scale)))
    return v.where(F.col("v").isNotNull()).where(finite).withColumn("x", F.transform("v", lambda x: F.floor(x * scale).cast("int"))).drop("v")


def beyond(vectors: DataFrame, scale: int, limit: int, *, vector_col: str) -> DataFrame:
    """The rows that :func:`integer_vectors` leaves out for their size alone."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(finite & F.exists(v, lambda x: F.abs(x) >= float(limit // scale)))


def matrix(column: pa.Array) -> np.ndarray:
    """[n, d] of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def one_list(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def in_blocks(rows: DataFrame, build, schema: str, size: int = BLOCK) -> DataFrame:
    """``build(table)`` for up to ``size`` rows of a partition at a time gives one record batch."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        parts, n = [], 0
        for b in batches:
            while b.num_rows:
                head = b.slice(0, size - n)
                parts.append(head)
                n += head.num_rows
                b = b.slice(head.num_rows)
                if n == size:
                    yield build(pa.Table.from_batches(parts).combine_chunks())
                    parts, n = [], 0
        if n:
            yield build(pa.Table.from_batches(parts).combine_chunks())

    return rows.mapInArrow(run, schema)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[n, m] exact squared distances of integer rows; through doubles where these hold every sum exactly."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if top * top * a.shape[1] < 1 << 51:
        a, b = a.astype(np.float64), b.astype(np.float64)
    out = (a @ b.T) * -2
    out += np.square(a).sum(1)[:, None]
    out += np.square(b).sum(1)[None, :]
    return out.astype(np.int64)


def summed(rows: DataFrame, task) -> list:
    """(place, dim, n, s) summed over what ``task(batches)`` yields as such rows, few per task; as many rows as there are places and dims."""
    parts = rows.mapInArrow(task, "place int, dim int, n bigint, s bigint")
    return parts.groupBy("place", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()


def sums_batch(n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Rows (place, dim, n, s) of the places that have any; ``n``: [places], ``s``: [places, dims]."""
    place = np.flatnonzero((n != 0) | (s != 0).any(1))
    dims = s.shape[1]
    columns = (np.repeat(place, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(place)), np.repeat(n[place], dims), s[place].ravel())
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "dim", "n", "s"])
