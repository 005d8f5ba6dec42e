"""Digests of ordered lines, streamed: rows are sorted by Spark, which spills, and one hash state reads them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digests(lines: DataFrame, *sort: str, end: bool = False) -> DataFrame:
    """(group, digest): SHA-256 of each group's ``line`` values in the order of ``sort``, line ends between them or, with ``end``, after each.

    ``lines``: group (string), line, and the columns of ``sort``. A digest is a
    sequence by nature, so a group is read by one task, in batches: its memory
    holds a batch and a hash state, whatever the size of the group.
    """
    rows = lines.repartition("group").sortWithinPartitions("group", *sort).select("group", F.col("line").cast("binary").alias("line"))

    def run(batches):
        now, state, first = None, None, True

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["group", "digest"])

        for b in batches:
            for group, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if state is None or group != now:
                    if state is not None:
                        yield done()
                    now, state, first = group, hashlib.sha256(), True
                if not (end or first):
                    state.update(b"\n")
                state.update(line.as_buffer() if line.is_valid else b"")
                if end:
                    state.update(b"\n")
                first = False
        if state is not None:
            yield done()

    return rows.mapInArrow(run, "group string, digest string")
