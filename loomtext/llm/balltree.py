"""Centroid clustering with ball-tree filtering, in exact integers.

Every partition cuts its vectors into blocks and builds a metric tree over each:
a node is a ball with centre, radius, count and integer sum of its vectors. The
trees are written once. In each round a ball whose nearest centroid is nearer
than the second one by more than the ball's diameter belongs to that centroid as
a whole (triangle inequality) and adds its stored sum and count; others are
descended, and at the leaves every vector is compared exactly. Tasks return sums
by centroid only, so the driver holds as many numbers as the centroids have.

Distances of vectors are integers. Those of balls are square roots, compared
with a margin above their rounding, so ties and near ties always reach the
exact leaves, where the smaller centroid number wins.

Defined cases: vectors that are null, of another dimension, or hold null or
non-finite components take no part, nor do those with a component of 65,536 or
more in size, whose distances might not fit a long (:func:`left_out` has them);
repeated ids are rows of their own, ordered by their components where ids tie;
rows of null id come last among the first centroids; with fewer rows than
centroids there are so many centroids; equal vectors are one ball of radius 0;
sums beyond a long are null; columns other than the named ones are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.blocks import beyond, in_blocks, integer_vectors, matrix, one_list, squared, summed, sums_batch
from loomtext.llm.common import materialise, scratch

SCALE, DIM, CENTROIDS, ROUNDS = 256, 64, 40, 5
LIMIT = 1 << 24
#: Vectors of a leaf at most, unless they are all equal.
LEAF = 32


class Tree:
    """A metric tree over the rows of ``x``, which it reorders by ``order`` so that every ball is a range."""

    #: Node fields that are kept as they are, by type.
    FIELDS = (("start", np.int32), ("stop", np.int32), ("left", np.int32), ("radius", np.int64))

    def __init__(self, start, stop, left, radius, centre, total) -> None:
        self.start, self.stop, self.left, self.radius, self.centre, self.total = start, stop, left, radius, centre, total

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        order = np.arange(len(x))
        nodes, todo = [[0, len(x)]], [0]
        start, stop, left, radius, centre, total = [], [], [], [], [], []
        at = 0
        while at < len(todo):  # breadth first: both children of a node are neighbours
            low, high = nodes[at]
            own = x[order[low:high]]
            sums = own.sum(0)
            middle = sums // (high - low)
            far = np.square(own - middle).sum(1)
            start.append(low), stop.append(high), radius.append(int(far.max())), centre.append(middle), total.append(sums)
            if high - low <= leaf or not far.max() or (own == own[0]).all():
                left.append(-1)
            else:
                a = own[far.argmax()]
                b = own[np.square(own - a).sum(1).argmax()]
                half = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(own @ (b - a), half)]
                left.append(len(nodes))
                nodes += [[low, low + half], [low + half, high]]
                todo += [0, 0]
            at += 1
        make = lambda v, t: np.array(v, t)
        tree = cls(make(start, np.int32), make(stop, np.int32), make(left, np.int32), make(radius, np.int64), make(centre, np.int64), make(total, np.int64))
        return tree, order

    def write(self) -> bytes:
        head = np.array([len(self.start)], np.int64).tobytes()
        return head + b"".join(getattr(self, f).astype(t).tobytes() for f, t in self.FIELDS) + self.centre.astype(np.int32).tobytes() + self.total.tobytes()

    @classmethod
    def read(cls, data: bytes, dim: int) -> Tree:
        n, at, fields = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
        for kind, width in [*((t, 1) for _, t in cls.FIELDS), (np.int32, dim), (np.int64, dim)]:
            fields.append(np.frombuffer(data, kind, n * width, at))
            at += n * width * np.dtype(kind).itemsize
        *plain, centre, total = fields
        return cls(*plain, centre.reshape(n, dim).astype(np.int64), total.reshape(n, dim))

    def settle(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(balls that belong to one centroid, those centroids, leaves that don't)."""
        balls, owners, leaves = [], [], []
        ahead = np.zeros(min(1, len(self.start)), np.int64)
        while len(ahead):
            d = np.sqrt(squared(self.centre[ahead], centroids).astype(np.float64))
            first = d.argmin(1)
            near = d[np.arange(len(d)), first]
            d[np.arange(len(d)), first] = np.inf
            second = d.min(1)
            wide = 2 * np.sqrt(self.radius[ahead].astype(np.float64))
            whole = second - near > wide + 1e-9 * (1 + near + wide)
            balls.append(ahead[whole]), owners.append(first[whole])
            rest = ahead[~whole]
            leaf = self.left[rest] < 0
            leaves.append(rest[leaf])
            down = self.left[rest[~leaf]].astype(np.int64)
            ahead = np.concatenate([down, down + 1])
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(v) if v else empty for v in (balls, owners, leaves))

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """Places of all vectors below the nodes, node by node."""
        size = (self.stop[nodes] - self.start[nodes]).astype(np.int64)
        return np.repeat(self.start[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())


def nearest_centroids(tree: Tree, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and squared distance of every vector."""
    balls, owners, leaves = tree.settle(centroids)
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    at = tree.rows(balls)
    cluster[at] = np.repeat(owners, tree.stop[balls] - tree.start[balls])
    distance[at] = np.square(x[at] - centroids[cluster[at]]).sum(1)
    at = tree.rows(leaves)
    d = squared(x[at], centroids)
    cluster[at] = d.argmin(1)
    distance[at] = d[np.arange(len(at)), cluster[at]]
    return cluster, distance


def add_sums(tree: Tree, x: np.ndarray, centroids: np.ndarray, n: np.ndarray, s: np.ndarray) -> int:
    """Add the block to counts and sums by centroid; the number of vectors compared one by one."""
    balls, owners, leaves = tree.settle(centroids)
    np.add.at(n, owners, tree.stop[balls] - tree.start[balls])
    np.add.at(s, owners, tree.total[balls])
    own = x[tree.rows(leaves)]
    cluster = squared(own, centroids).argmin(1)
    for c in np.unique(cluster):
        mine = own[cluster == c]
        n[c] += len(mine)
        s[c] += mine.sum(0)
    return len(own)


def _read(batch: pa.RecordBatch, dim: int):
    """(ids, vectors, tree) of each block."""
    for i in range(batch.num_rows):
        x = np.frombuffer(batch.column("x")[i].as_buffer(), np.int32).reshape(-1, dim).astype(np.int64)
        yield batch.column("ids")[i].values, x, Tree.read(batch.column("tree")[i].as_buffer(), dim)


def trees(rows: DataFrame) -> DataFrame:
    """One row a block of (vec_id, x): ids, vectors in the order of the tree, tree."""

    def build(t: pa.Table) -> pa.RecordBatch:
        x = matrix(t.column("x").combine_chunks())
        tree, order = Tree.build(x)
        ids = t.column("vec_id").combine_chunks().take(pa.array(order))
        return pa.RecordBatch.from_arrays([one_list(ids), pa.array([x[order].astype(np.int32).tobytes()], pa.binary()), pa.array([tree.write()], pa.binary())], names=["ids", "x", "tree"])

    return in_blocks(rows.select("vec_id", "x"), build, "ids array<bigint>, x binary, tree binary")


def left_out(vectors: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
    """Rows whose components are too large to take part."""
    return beyond(vectors, SCALE, LIMIT, vector_col=vector_col)


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster_vectors(
    vectors: DataFrame, *, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the vectors of smallest SHA-256 of ``seed:vec_id``.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.where(F.size(vector_col) == dim), SCALE, LIMIT, id_col=id_col, vector_col=vector_col)
    with scratch(spark) as keep:
        blocks = materialise(trees(rows), "balls")
        drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
        chosen = rows.orderBy(drawn.asc_nulls_last(), "x").limit(centroids).collect()
        if not chosen:
            return spark.createDataFrame([], RESULT)
        now = np.array([r["x"] for r in chosen], np.int64)
        for _ in range(rounds):
            now = _moved(blocks, now)
        assigned = keep(materialise(_assigned(blocks, now), "assigned"))
    return _with_inertia(assigned, now)


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; empty ones stay."""
    dim = centroids.shape[1]

    def task(batches):
        n, s = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for _, x, tree in _read(b, dim):
                add_sums(tree, x, centroids, n, s)
        yield sums_batch(n, s)

    out = centroids.copy()
    for r in summed(blocks, task):
        if r["n"]:
            out[r["place"], r["dim"]] = r["s"] // r["n"]
    return out


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    def task(batches):
        for b in batches:
            for ids, x, tree in _read(b, centroids.shape[1]):
                cluster, distance = nearest_centroids(tree, x, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(task, "vec_id bigint, cluster int, distance bigint")


def _with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Sums of distances and digests of centroids, a table of as many rows as there are centroids, which is broadcast."""
    spark, top = assigned.sparkSession, (1 << 63) - 1
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    fit = lambda v: v if v <= top else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by = spark.createDataFrame([(c, fit(s), fit(whole), digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
