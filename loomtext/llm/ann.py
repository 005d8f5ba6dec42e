"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component, so that
all have norm 1 and the largest inner product is the smallest distance. Each of
``TABLES`` tables hashes a vector by ``floor((a.x + b) / WIDTH)`` for several
Gaussian directions ``a``. A query visits its own bucket and the buckets that
perturb its hashes by one step, in the order of estimated success: the sum of
squared distances to the boundaries crossed. The number of visits is the
smallest that finds ``RECALL`` of the exact neighbours of ``CALIBRATION``
queries (a bounded sample; every row is indexed). Beyond ``MOST_VISITS`` a table
scan is no dearer, and all queries are answered exactly.

Buckets are dealt to groups by hash, large ones in salted parts, so that a group
has some ``GROUP_BYTES`` of vectors. A query's vector goes once to each group
that holds buckets it visits, with the list of them. Candidates of all tables
are merged and reranked by the exact inner product.

Queries that found fewer than ``k`` candidates are answered exactly: the rows are
dealt to groups, and each query goes to all of them.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows of null id, take no part; nor do vectors whose dimension
isn't the most frequent one (:func:`left_out` counts them); of repeated ids the
smallest vector counts; ties go to the smaller id; columns other than the named
ones are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import bounded_batches, materialise, utf8_column
from loomtext.llm.shingles import mix

TABLES = 4
WIDTH = 1.5
SEED = 20240607
CALIBRATION = 64
RECALL = 0.96
#: Visits of a table at most.
MOST_VISITS = 20_000
#: Rows of one part of a bucket at least, and the number of buckets with several parts at most, whose list is broadcast.
PART, LARGE_BUCKETS = 4096, 500_000
#: Vectors of one group, as doubles.
GROUP_BYTES = 16 << 20
SLACK = 1e-9


def depth(n: int) -> int:
    """Hashes of a table: one more for each fourfold of the rows beyond 100,000."""
    return 5 + max(0, round(math.log(max(n, 1) / 100_000, 4)))


@dataclass
class Hashing:
    directions: np.ndarray  # [tables, d + 1, depth]
    shifts: np.ndarray  # [tables, depth]
    norm: float  # largest

    @classmethod
    def draw(cls, dim: int, n: int, norm: float) -> Hashing:
        rng = np.random.default_rng(SEED)
        k = depth(n)
        return cls(rng.normal(size=(TABLES, dim + 1, k)), rng.uniform(0, WIDTH, (TABLES, k)), norm)

    def stored(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - np.square(x).sum(1)))[:, None]])

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.directions[t] + self.shifts[t]) / WIDTH

    @staticmethod
    def keys(codes: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = np.full(codes.shape[:-1], mix(np.array([t + 1], np.uint64))[0])
            for j in range(codes.shape[-1]):
                key = mix(key ^ codes[..., j].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def bucket_keys(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.keys(np.floor(self.places(self.stored(x), t)), t)

    def probes(self, q: np.ndarray, t: int, visits: int) -> np.ndarray:
        """[n, visits] bucket keys in the order of estimated success."""
        place = self.places(self.asked(q), t)
        code = np.floor(place)
        low = place - code
        cost = np.stack([np.zeros_like(low), low**2, (1 - low) ** 2], -1)  # of steps 0, -1, +1
        # the best sets of all hashes begin with the best sets of the first ones
        total, steps = np.zeros((len(q), 1)), np.zeros((len(q), 1, 0), np.int8)
        for j in range(place.shape[1]):
            more = (total[:, :, None] + cost[:, j, None, :]).reshape(len(q), -1)
            best = np.argsort(more, axis=1, kind="stable")[:, :visits]
            total = np.take_along_axis(more, best, 1)
            step = np.array([0, -1, 1], np.int8)[best % 3][:, :, None]
            steps = np.concatenate([np.take_along_axis(steps, (best // 3)[:, :, None], 1), step], 2)
        return self.keys(code[:, None, :] + steps, t)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed from the first component on, so equal vectors score equally."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Best:
    """The k nearest of each query among the candidates seen so far."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size, self.floor = k, [], 0, {}

    def add(self, q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray) -> None:
        s = q @ v.T
        s[q_id[:, None] == v_id[None, :]] = -np.inf
        least = np.array([self.floor.get(i, -np.inf) for i in q_id.tolist()])
        if s.shape[1] > self.k:
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        margin = SLACK * np.linalg.norm(q, axis=1) * max(1e-300, float(np.linalg.norm(v, axis=1).max()))
        row, col = np.nonzero((s >= (least - margin)[:, None]) & (s > -np.inf))
        for a in range(0, len(row), 100_000):
            r, c = row[a : a + 100_000], col[a : a + 100_000]
            self.parts.append((q_id[r], v_id[c], inner(q[r], v[c])))
        self.size += len(row)
        if self.size > 400_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, v, s = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # equal pairs have equal scores and so are neighbours
        q, v, s = q[fresh], v[fresh], s[fresh]
        start = np.flatnonzero(np.diff(q, prepend=q[:1] - 1)) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        keep = rank < self.k
        q, v, s, rank = q[keep], v[keep], s[keep], rank[keep]
        self.floor.update(zip(q[rank == self.k - 1].tolist(), s[rank == self.k - 1].tolist(), strict=True))
        self.parts, self.size = [(q, v, s)], len(q)
        return q, v, s

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.cut()], names=["query_id", "vec_id", "score"])


FOUND = "query_id bigint, vec_id bigint, score double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a binary column, of floats or doubles, as doubles."""
    data, offsets = utf8_column(column)
    single = len(offsets) > 1 and offsets[1] == 4 * dim
    return np.frombuffer(data.tobytes(), np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, ids distinct; components are floats if they were given so, else doubles."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _dimensions(rows: DataFrame) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("norm")).orderBy(F.desc("n"), "dim")


def left_out(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(dim, n) of usable vectors that take no part since another dimension is more frequent."""
    by = _dimensions(usable(vectors, id_col, vector_col))
    first = by.first()
    return by.where(F.col("dim") != (first["dim"] if first else 0)).select("dim", "n")


def _packed(v: DataFrame) -> DataFrame:
    single = v.schema["embedding"].dataType.simpleString() == "array<float>"

    def run(batches):
        for b in batches:
            rows = b.column(1)
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
            dim = len(flat) // max(1, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[i * dim : (i + 1) * dim].tobytes() for i in range(b.num_rows)], pa.binary())], names=["vec_id", "v"])

    return v.mapInArrow(run, "vec_id bigint, v binary")


class _Group:
    """Stored vectors of a group by place."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int) -> None:
        t = pa.Table.from_batches(parts).combine_chunks()
        place = t.column(2).to_numpy()
        order = np.argsort(place, kind="stable")
        self.ids, self.vectors = t.column(3).to_numpy()[order], _matrix(t.column(4), dim)[order]
        self.places, self.starts = np.unique(place[order], return_index=True)
        self.starts = np.append(self.starts, len(place))

    def best(self, asked: pa.RecordBatch, dim: int, k: int) -> pa.RecordBatch:
        """The k nearest of each query of the slice in the places that it visits."""
        best = Best(k)
        ids, q, lists = asked.column(3).to_numpy(), _matrix(asked.column(4), dim), asked.column(5)
        place = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
        held = self.places[at] == place
        at, row = at[held], row[held]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low, high = self.starts[at[a]], self.starts[at[a] + 1]
            for i in range(a, b, 256):
                r = row[i : min(b, i + 256)]
                for j in range(low, high, PART):
                    stop = min(high, j + PART)
                    best.add(ids[r], q[r], self.ids[j:stop], self.vectors[j:stop])
        return best.batch()


def met(stored: DataFrame, asked: DataFrame, vectors: DataFrame, rows: int, dim: int, k: int) -> DataFrame:
    """Best k candidates of each query in each group.

    ``stored``: (place, id, v), some ``rows``; ``asked``: (place, query_id), the places that a query
    visits; ``vectors``: (vec_id, v) of the queries.
    """
    bounded_batches(stored.sparkSession)
    group = F.pmod("place", F.lit(groups_of(rows, dim))).cast("int").alias("group")

    def compare(batches):
        now, parts, held = None, [], None
        for b in batches:
            group, is_query = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(is_query) != 0)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if x == y:
                    continue
                if group[x] != now:
                    now, parts, held = group[x], [], None
                if not is_query[x]:
                    parts.append(b.slice(x, y - x))
                elif parts:
                    held = held or _Group(parts, dim)
                    yield held.best(b.slice(x, y - x), dim, k)

    lists = asked.groupBy(group, "query_id").agg(F.collect_list("place").alias("places"))
    queries = lists.join(vectors.select(F.col("vec_id").alias("query_id"), "v"), "query_id")
    queries = queries.select("group", F.lit(1).alias("is_query"), F.lit(0).cast("bigint").alias("place"), F.col("query_id").alias("id"), "v", "places")
    base = stored.select(group, F.lit(0).alias("is_query"), "place", "id", "v", F.lit(None).cast("array<bigint>").alias("places"))
    return base.unionByName(queries).repartition("group").sortWithinPartitions("group", "is_query").mapInArrow(compare, FOUND)


def groups_of(rows: int, dim: int) -> int:
    return max(1, math.ceil(rows * dim * 8 / GROUP_BYTES))


def exact_nearest(base: DataFrame, queries: DataFrame, rows: int, dim: int, k: int) -> DataFrame:
    """The k nearest of each query row (vec_id, v) among all rows of ``base``."""
    n = groups_of(rows, dim)
    stored = base.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("place"), F.col("vec_id").alias("id"), "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("place"), F.col("vec_id").alias("query_id"))
    return ranked(met(stored, asked, queries, rows, dim, k), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _read(rows, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r[0] for r in rows], np.int64)
    return ids, _matrix(pa.array([bytes(r[1]) for r in rows], pa.binary()), dim)


def calibrated(hashing: Hashing, base: DataFrame, queries: DataFrame, rows: int, k: int, dim: int) -> int | None:
    """Visits of a table that find ``RECALL`` of the exact neighbours of a bounded sample of queries; none if that is too many."""
    most = min(MOST_VISITS, 3 ** hashing.directions.shape[2])
    chosen = materialise(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION), "sample")
    sample = chosen.collect()
    if not sample:
        return 1
    q_id, q = _read(sample, dim)
    near = exact_nearest(base, chosen, rows, dim, k).join(base, "vec_id").select("query_id", "v").collect()
    if not near:
        return 1
    own, v = _read(near, dim)
    at = np.argsort(q_id)[np.searchsorted(np.sort(q_id), own)]
    first = np.full(len(own), most)
    for t in range(TABLES):
        probes, keys = hashing.probes(q, t, most), hashing.bucket_keys(v, t)
        for i in range(len(own)):
            hit = np.flatnonzero(probes[at[i]] == keys[i])
            first[i] = min(first[i], hit[0] if len(hit) else most)
    visits = int(np.sort(first)[math.ceil(RECALL * len(first)) - 1] + 1)
    return visits if visits <= most else None


def nearest(vectors: DataFrame, queries_where: F.Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row: query_id, rank, vec_id, score.

    ``queries_where`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    dims = _dimensions(rows).first()
    if dims is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = dims["dim"], dims["n"]
    base = materialise(_packed(rows.where(F.size("embedding") == dim)), "vectors")
    asked = base.where(queries_where)
    hashing = Hashing.draw(dim, n, math.sqrt(dims["norm"]))
    visits = calibrated(hashing, base, asked, n, k, dim)
    if visits is None:
        return exact_nearest(base, asked, n, dim, k)

    def index(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), dim)
                keys = [hashing.bucket_keys(v, t) for t in range(TABLES)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.concat_arrays([b.column(i)] * TABLES) for i in (0, 1))], names=["key", "id", "v"])

    def probe(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                q = _matrix(part.column(1), dim)
                for t in range(TABLES):
                    keys = hashing.probes(q, t, visits)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "query_id"])

    stored = base.mapInArrow(index, "key bigint, id bigint, v binary")
    # 1 part for PART rows, or for so many rows that few buckets have several parts
    least = max(PART, math.ceil(TABLES * n / LARGE_BUCKETS))
    large = stored.groupBy("key").agg(F.ceil(F.count("*") / F.lit(least)).cast("int").alias("parts")).where("parts > 1")
    large = F.broadcast(materialise(large, "buckets"))
    parts = F.coalesce("parts", F.lit(1))
    place = F.xxhash64("key", F.pmod(F.xxhash64("id"), parts).cast("int")).alias("place")
    dealt = stored.join(large, "key", "left").select(place, "id", "v")
    visited = asked.mapInArrow(probe, "key bigint, query_id bigint").join(large, "key", "left")
    visited = visited.select("key", "query_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(F.xxhash64("key", "part").alias("place"), "query_id")
    found = materialise(ranked(met(dealt, visited, asked, TABLES * n, dim, k), k), "nearest")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    short = materialise(asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if short.isEmpty():
        return found
    exact = exact_nearest(base, short, n, dim, k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*found.columns).unionByName(exact)
