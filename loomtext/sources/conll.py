"""CoNLL files: ``token label`` lines, a blank line between examples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.shared import BATCH_BYTES, discard, materialise

_SPACE = " \t\n\x0b\x0c\r"
_PIECE = "path string, block bigint, k int, closed boolean, tokens array<string>, labels array<string>"
#: Lines that Python takes at a time; pieces of a range that are numbered together; ranges whose numbers are broadcast at most.
_LINES, _PART, _FEW = 1 << 16, 4096, 10_000


def read_conll(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """(path, idx, tokens, labels): examples of each file in order; of a folder, files whose name matches ``glob``.

    A line splits at its first space; lines without one are skipped; examples
    without a token vanish. Spark's text reader cuts files into byte ranges at line
    ends, and each range is read once, by a task of its own: it gives pieces of
    examples between blank lines, which are written. Only the first and last piece
    of a range can belong to an example that goes beyond it; those are put
    together, a few rows for each range. They tell how many examples lie between
    them, so numbers come from them alone and no other piece is shuffled for them.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").cast("bigint").alias("block"), "value")
    # small ranges share tasks, so that they don't make a file each
    pieces = materialise(lines.coalesce(8 * spark.sparkContext.defaultParallelism).mapInArrow(_pieces, _PIECE), "pieces")
    # an open piece goes on with the first piece of the next range
    chain = F.sum(F.when(F.col("k") > 0, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("block", "k"))
    ends = pieces.where("k = 0 OR NOT closed").withColumn("chain", chain).groupBy("path", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "k", "tokens", "labels"))).alias("p"))
    flat = lambda c: F.flatten(F.transform("p", lambda x: x[c])).alias(c)
    joined = ends.select("path", "chain", F.get("p", 0)["block"].alias("block"), F.get("p", 0)["k"].alias("k"), flat("tokens"), flat("labels"))
    # before a chain that begins with an open piece come the closed pieces of its range
    joined = joined.withColumn("inner", F.greatest(F.col("k") - 1, F.lit(0)).cast("bigint"))
    before = F.sum(F.col("inner") + (F.size("tokens") > 0).cast("int")).over(Window.partitionBy("path").orderBy("chain").rowsBetween(Window.unboundedPreceding, -1))
    joined = materialise(joined.withColumn("before", F.coalesce(before, F.lit(0))), "ends")
    ranges = joined.where("inner > 0").select("path", "block", "before", F.explode(F.sequence(F.lit(0), (F.col("inner") / _PART).cast("int"))).alias("part"))
    if joined.count() <= _FEW:
        ranges = F.broadcast(ranges)
    inner = pieces.where("k > 0 AND closed").withColumn("part", (F.col("k") / _PART).cast("int")).join(ranges, ["path", "block", "part"])
    number = lambda at: at.cast("int").alias("idx")
    inner = inner.select("path", number(F.col("before") + F.col("k") - 1), "tokens", "labels")
    return inner.unionByName(joined.where(F.size("tokens") > 0).select("path", number(F.col("before") + F.col("inner")), "tokens", "labels"))


def _read_together(batches):
    """Columns (path, block, value) of many lines at a time: Arrow batches of lines are short."""
    some, n, size = [], 0, 0
    for b in batches:
        some.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= _LINES or size >= BATCH_BYTES:
            yield pa.Table.from_batches(some).combine_chunks()
            some, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(some).combine_chunks()


def _pieces(batches):
    """Pieces of examples of each byte range: all but its last are closed by a blank line."""
    now, k, open_tokens, open_labels, rows = None, 0, [], [], []
    string = pa.string()

    def piece(closed, ends, tokens, labels):
        n, offsets = len(ends), pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (tokens, labels)]
        columns = [pa.repeat(pa.scalar(now[0], string), n), pa.repeat(pa.scalar(now[1], pa.int64()), n), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.repeat(closed, n), *lists]
        rows.append(pa.RecordBatch.from_arrays(columns, names=["path", "block", "k", "closed", "tokens", "labels"]))

    def end():
        tokens, labels = (pa.concat_arrays([*x, pa.array([], string)]) for x in (open_tokens, open_labels))
        piece(False, [len(tokens)], tokens, labels)

    def written():
        out = pa.Table.from_batches(rows).combine_chunks().to_batches()
        rows.clear()
        return out

    for lines in _read_together(batches):
        path, block, value = (c.combine_chunks() for c in lines.columns)
        new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1]))
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), len(value)]
        blank = pc.equal(pc.binary_length(pc.utf8_trim(value, _SPACE)), 0).to_numpy(zero_copy_only=False)
        split = ~blank & (pc.find_substring(value, " ").to_numpy() >= 0)
        cells = pc.split_pattern(value.filter(pa.array(split)), " ", max_splits=1).flatten()
        at = pa.array(np.arange(0, len(cells), 2))
        tokens, labels = cells.take(at).cast(string), pc.utf8_trim(cells.take(pc.add(at, 1)), " ").cast(string)
        before = np.concatenate([[0], np.cumsum(split)])
        for a, b in zip(starts, starts[1:], strict=False):
            if (place := (path[a].as_py(), block[a].as_py())) != now:
                if now:
                    end()
                now, k, open_tokens, open_labels = place, 0, [], []
            own = slice(before[a], before[b])
            open_tokens.append(tokens[own])
            open_labels.append(labels[own])
            ends = before[a:b][blank[a:b]] - before[a] + sum(map(len, open_tokens[:-1]))
            if len(ends):
                # an empty piece tells no more than the blank line before it, but for the first of a range
                ends = ends[np.diff(ends, prepend=-1 if k == 0 else 0) > 0]
            if len(ends):
                whole = [pa.concat_arrays(x) for x in (open_tokens, open_labels)]
                piece(True, ends, *(x[: ends[-1]] for x in whole))
                k += len(ends)
                open_tokens, open_labels = ([x[ends[-1] :]] for x in whole)
        if rows:
            yield from written()
    if now:
        end()
        yield from written()


def conll_text(tokens, labels):
    """Lines of one example; token and label numbers must agree."""
    lines = F.array_join(F.zip_with(tokens, labels, lambda t, x: F.concat(t, F.lit(" "), x)), "\n")
    return F.when(F.size(tokens) != F.size(labels), F.raise_error(F.lit("tokens and labels differ in length")).cast("string")).otherwise(lines)


def write_conll(examples: DataFrame, path: str, *, order_by: str = "example_id", tokens_col: str = "tokens", labels_col: str = "labels") -> None:
    """Write examples in order, range-partitioned, as text files whose concatenation is one CoNLL file.

    Their texts are written first, as ranges are found by passes of their own.
    """
    texts = materialise(examples.select(order_by, F.concat(conll_text(F.col(tokens_col), F.col(labels_col)), F.lit("\n")).alias("value")), "texts")
    texts.repartitionByRange(order_by).sortWithinPartitions(order_by).select("value").write.text(path)
    discard(texts)
