"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import discard, materialise, skew_join

MAX_ROUNDS = 60
#: Edges of one partition. Rounds over few edges need no exchange at all; more edges are spread over partitions.
EDGES = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round costs two aggregations and joins over the edges, needs O(log^2 n)
    rounds at most, and is written to the shared folder. A node's neighbours are
    never gathered in one place: only their minimum is, by a partial aggregate.
    A hub's edges are dealt over several tasks. Self-loops and repeated or
    reversed edges are allowed; null nodes are not.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialise(e, "edges")
    seen = _state(e)
    for _ in range(MAX_ROUNDS):
        parts = _parts(seen)
        old, e = e, e.coalesce(parts)
        stars = _small_star(_large_star(e.where("u <> v"), seen[0], parts), seen[0], parts)
        e = materialise(stars.unionByName(e.where("u = v")).coalesce(parts).distinct(), "edges")
        discard(old)
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    nodes = e.coalesce(_parts(seen)).select("v", F.explode(F.array("u", "v")).alias("node"))
    return nodes.groupBy("node").agg(F.min("v").alias("component"))


def _parts(state: tuple) -> int:
    return max(1, math.ceil(state[0] / EDGES))


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(e: DataFrame, least: DataFrame, n: int, parts: int) -> DataFrame:
    """Edges with the least neighbour of ``u``; a hub's edges are dealt over several tasks."""
    return e.join(least.drop("n"), "u") if parts == 1 else skew_join(e, least, "u", "n", 2 * n, F.col("v"))


def _large_star(e: DataFrame, n: int, parts: int) -> DataFrame:
    ends = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = e.select(F.explode(ends).alias("x")).select("x.u", "x.v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, n, parts).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, n: int, parts: int) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(e, least, n, parts).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()
