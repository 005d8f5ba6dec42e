"""Vector codes by heap Lloyd: product quantisation in exact integers.

Vectors are cut into ``PARTS`` consecutive parts, each with a codebook of its
own. Every block of a partition keeps, for each part position, one heap per
codebook entry of the parts assigned to it, keyed by slack: the lower bound on
the distance to any other entry minus the upper bound on the distance to its
own. When entries move, the slack of a part shrinks by its entry's drift and the
largest drift of another one at most. A part's key is its slack plus its entry's
cumulative shrinkage at the time it was pushed, so a round pops only the parts
whose key has been passed by that sum, compares them with all entries exactly,
and pushes them again; all others keep their entry unread.

Parts that changed their entry add the difference to the sums by entry, which is
all that the driver gets. The heaps travel with their block, in a table that each
round writes anew; a lost task starts from the round before.

Distances are integers; bounds are square roots with a margin above their
rounding, and ties have no slack, so they are always compared exactly and the
lower index wins.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do those whose dimension isn't the most frequent one (the smaller
one if two are), nor those with a component of 16,384 or more in size, whose
distances might not fit a long (:func:`left_out` has the latter); a dimension
that four doesn't divide is filled up with zeros; repeated ids are rows of their
own, ordered by their components; rows of null id come last in a codebook; with
fewer rows than entries a codebook has so many entries; null labels are one
label; error sums beyond a long are null; columns other than the named ones are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.blocks import beyond, in_blocks, integer_vectors, matrix, one_list, squared, summed, sums_batch
from loomtext.llm.common import discard, materialise, scratch, skew_join

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LIMIT = 1 << 24


class Heaps:
    """Heaps of (key, part) for the entries of one codebook; every part is in one of them."""

    def __init__(self, entries: int) -> None:
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(entries)]

    def write(self) -> bytes:
        size = np.array([len(h) for h in self.heaps], np.int32)
        flat = [x for h in self.heaps for x in h]
        return size.tobytes() + np.array([k for k, _ in flat], np.float64).tobytes() + np.array([i for _, i in flat], np.int32).tobytes()

    @classmethod
    def read(cls, data: bytes, entries: int, n: int) -> Heaps:
        size = np.frombuffer(data, np.int32, entries).tolist()
        keys = np.frombuffer(data, np.float64, n, 4 * entries).tolist()
        parts = np.frombuffer(data, np.int32, n, 4 * entries + 8 * n).tolist()
        out, at = cls(entries), 0
        for j, m in enumerate(size):
            out.heaps[j] = list(zip(keys[at : at + m], parts[at : at + m], strict=True))
            at += m
        return out

    def fill(self, entry: np.ndarray, key: np.ndarray) -> None:
        """Push all parts at once."""
        for i, (j, k) in enumerate(zip(entry.tolist(), key.tolist(), strict=True)):
            self.heaps[j].append((k, i))
        for h in self.heaps:
            heapify(h)

    def violated(self, shrunk: np.ndarray) -> tuple[list[int], list[int]]:
        """Pop the parts whose slack may be used up; (parts, their entries)."""
        parts, entries = [], []
        for j, (h, most) in enumerate(zip(self.heaps, shrunk.tolist(), strict=True)):
            while h and h[0][0] <= most:
                parts.append(heappop(h)[1])
                entries.append(j)
        return parts, entries

    def push(self, parts: list[int], entry: np.ndarray, key: np.ndarray) -> None:
        for i, j, k in zip(parts, entry.tolist(), key.tolist(), strict=True):
            heappush(self.heaps[j], (k, i))

    def entries(self, n: int) -> np.ndarray:
        """The entry of every part."""
        out = np.zeros(n, np.int64)
        for j, h in enumerate(self.heaps):
            out[[i for _, i in h]] = j
        return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, slack) of every row."""
    d = squared(x, book)
    at = np.arange(len(x))
    entry = d.argmin(1)
    near = np.sqrt(d[at, entry].astype(np.float64))
    if len(book) == 1:
        return entry, np.full(len(x), np.inf)
    d[at, entry] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64))
    return entry, second - near - 1e-9 * (1 + near)


def step(x: np.ndarray, heaps: Heaps | None, book: np.ndarray, shrunk: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, int]:
    """Bring the heaps of one part position up to date with ``book``.

    ``shrunk`` is the cumulative shrinkage by entry. Returns the heaps, the change of
    counts and sums by entry, and how many parts were compared.
    """
    n, s = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    if heaps is None:
        heaps = Heaps(len(book))
        entry, slack = scan(x, book)
        heaps.fill(entry, slack + shrunk[entry])
        np.add.at(n, entry, 1)
        np.add.at(s, entry, x)
        return heaps, n, s, len(x)
    parts, before = heaps.violated(shrunk)
    if parts:
        own, before = x[parts], np.array(before)
        entry, slack = scan(own, book)
        heaps.push(parts, entry, slack + shrunk[entry])
        moved = entry != before
        for sign, e in ((1, entry[moved]), (-1, before[moved])):
            np.add.at(n, e, sign)
            np.add.at(s, e, sign * own[moved])
    return heaps, n, s, len(parts)


def _blocks(rows: DataFrame, width: int, label_type: str) -> DataFrame:
    """One row a block of (vec_id, label, x): ids, labels, vectors, no heaps yet."""

    def build(t: pa.Table) -> pa.RecordBatch:
        x = matrix(t.column("x").combine_chunks())
        x = np.pad(x, ((0, 0), (0, width * PARTS - x.shape[1]))).astype(np.int32)
        columns = [one_list(t.column(c).combine_chunks()) for c in ("vec_id", "k0")]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([v], pa.binary()) for v in (x.tobytes(), None, None))], names=NAMES)

    return in_blocks(rows.select("vec_id", "k0", "x"), build, _schema(label_type))


NAMES = ["ids", "labels", "x", "heaps", "change"]


def _schema(label_type: str) -> str:
    return f"ids array<bigint>, labels array<{label_type}>, x binary, heaps array<binary>, change binary"


def _parts_of(data: pa.Buffer, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, PARTS, width).astype(np.int64)


def _stepped(blocks: DataFrame, books: np.ndarray, shrunk: np.ndarray, label_type: str) -> DataFrame:
    """The blocks with their heaps after a round, and the changes of counts and sums."""
    entries, width = books.shape[1:]

    def task(batches):
        for b in batches:
            for i in range(b.num_rows):
                x, old = _parts_of(b.column("x")[i].as_buffer(), width), b.column("heaps")[i].as_py()
                heaps, change = [], []
                for p in range(PARTS):
                    held = Heaps.read(old[p], entries, len(x)) if old else None
                    held, n, s, _ = step(x[:, p], held, books[p], shrunk[p])
                    heaps.append(held.write())
                    change.append(np.hstack([n[:, None], s]))
                row = b.slice(i, 1)
                kept = [row.column(c) for c in ("ids", "labels", "x")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([heaps], pa.list_(pa.binary())), pa.array([np.stack(change).tobytes()], pa.binary())], names=NAMES)

    return blocks.mapInArrow(task, _schema(label_type))


def _changes(blocks: DataFrame, entries: int, width: int) -> np.ndarray:
    """[parts, entries, 1 + width]: change of count and sums."""

    def task(batches):
        total = np.zeros((PARTS * entries, 1 + width), np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_buffer(), np.int64).reshape(total.shape)
        yield sums_batch(total[:, 0].copy(), total[:, 1:])

    out = np.zeros((PARTS * entries, 1 + width), np.int64)
    for r in summed(blocks.select("change"), task):
        out[r["place"], 0], out[r["place"], 1 + r["dim"]] = r["n"], r["s"]
    return out.reshape(PARTS, entries, 1 + width)


def shrinkage(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """[parts, entries]: an entry's drift plus the largest drift of another one, rounded up."""
    drift = np.sqrt(np.square(new - old).sum(2).astype(np.float64)) * (1 + 1e-12)
    out = np.empty_like(drift)
    for p, d in enumerate(drift):
        for j in range(len(d)):
            out[p, j] = d[j] + max(d[:j].max(initial=0), d[j + 1 :].max(initial=0))
    return out


def left_out(vectors: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
    """Rows whose components are too large to take part."""
    return beyond(vectors, SCALE, LIMIT, vector_col=vector_col)


def compress(
    vectors: DataFrame, *, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256.

    The first entries are the parts of the vectors of smallest ids.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    spark, label_type = vectors.sparkSession, vectors.schema[label_col].dataType.simpleString()
    rows = integer_vectors(vectors, SCALE, LIMIT, id_col=id_col, vector_col=vector_col, keep=(label_col,))
    first = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if first is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = first["dim"]
    width = -(-dim // PARTS)
    rows = rows.where(F.size("x") == dim)
    chosen = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.pad(np.array([r["x"] for r in chosen], np.int64), ((0, 0), (0, width * PARTS - dim)))
    books = np.ascontiguousarray(start.reshape(len(chosen), PARTS, width).transpose(1, 0, 2))
    with scratch(spark) as keep:
        blocks = materialise(_blocks(rows, width, label_type), "parts")
        shrunk, total = np.zeros(books.shape[:2]), np.zeros((*books.shape[:2], 1 + width), np.int64)
        for _ in range(rounds):
            blocks, before = materialise(_stepped(blocks, books, shrunk, label_type), "heaps"), blocks
            discard(before)
            total += _changes(blocks, *books.shape[1:])
            used = total[:, :, 0] > 0
            new = books.copy()
            new[used] = total[used][:, 1:] // total[used][:, :1]
            shrunk, books = shrunk + shrinkage(books, new), new
        coded = keep(materialise(_coded(_stepped(blocks, books, shrunk, label_type), books, label_type), "codes"))
    return _with_labels(coded, books)


def _coded(blocks: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    entries, width = books.shape[1:]

    def task(batches):
        for b in batches:
            for i in range(b.num_rows):
                x, heaps = _parts_of(b.column("x")[i].as_buffer(), width), b.column("heaps")[i].as_py()
                entry = np.stack([Heaps.read(heaps[p], entries, len(x)).entries(len(x)) for p in range(PARTS)], 1)
                error = sum(np.square(x[:, p] - books[p][entry[:, p]]).sum(1) for p in range(PARTS))
                digits = entry.astype(np.uint8).tobytes().hex()
                code = [digits[j : j + 2 * PARTS] for j in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(task, f"vec_id bigint, label {label_type}, code string, error bigint")


def _with_labels(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Errors summed by label, nulls together; a label of many rows is dealt over tasks."""
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = coded.select("vec_id", "code", "error", F.to_json(F.struct("label")).alias("label"))
    sums = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = materialise(sums, "labels")
    joined = skew_join(rows, sums, "label", "n", coded.count(), F.col("vec_id"), small=True)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
