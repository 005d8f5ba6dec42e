"""Near-duplicate groups by HyperMinHash, banding and verification on full sets.

1. Each text's shingle set gets a digest and ``BANDS * ROWS`` registers. A
   register holds the leading-zero count and the next ``MANTISSA`` bits of the
   smallest hash of its bucket; a bucket that stays empty is filled from rounds
   of rehashing, whose registers are marked, so that registers of two sets agree
   with a chance near their Jaccard similarity whatever their sizes.
2. Equal digests form classes, which are numbered; a class is represented by its
   row of the smallest id from here on.
3. Registers are banded. Within each band bucket the collision-corrected estimate
   of pairs is taken, and pairs that could reach the threshold (within ``SIGMAS``
   standard errors) connect candidate clusters.
4. The representatives' texts of each cluster are brought together, full sets are
   intersected and confirmed links returned as a forest, whose components are the
   groups.

Buckets and clusters beyond ``BLOCK`` members are compared in two passes. The first
deals them in chunks, each with the same few pivots, and so joins most members
that belong together at a cost in proportion to them. The second compares every
member outside its group's largest component with all members it isn't joined to
yet, so no pair is left out; its cost is the product of those two numbers.
Each task returns an edge from each of its members to the member of its tree that
has the smallest draw, so no group is expanded into its pairs and tasks repeat
few edges.

A pair at the threshold shares a band but for a chance of (1 - j^5)^25, which is
about 4e-7 at 0.85 and 5e-5 at 0.8, and less the more alike it is.

Defined cases: a null or wordless text has an empty set, is linked with nothing
and is its own group. Rows of one id belong to one group in
:func:`near_duplicates`, which joins the groups of all its texts;
:func:`drop_near_duplicates` decides for each row by its own text alone. A null
id has a null group and is kept in the former, and gives way to any id in the
latter. Of rows that repeat id and text the latter keeps one. A set is compared
by the 64-bit hashes of its shingles. Very long texts are hashed whole, in
slices. Columns other than id and text are ignored, or passed through, whatever
their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import bounded_batches, bounds, materialise, runs, scratch, skew_join, slices, utf8_column
from loomtext.llm.components import connected_components
from loomtext.llm.shingles import mix, shingle_sets

SHINGLE = 5
SHARE, OF = 85, 100  # linked when OF * intersection >= share * union; SHARE is the default share
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
SIGMAS = 6
#: Hashes that the rounds of one step make for each bucket; results don't depend on it.
FILL = 7
#: Members of one chunk of a large group.
BLOCK = 128
PIVOTS = 8
DRAWS = 1 << 40
#: Rows of a few bigints each are broadcast up to this many (some 64 MB); beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


# ---------------------------------------------------------------- registers


def _encode(fraction: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Registers of 32-bit fractions: leading zeros (marked in later rounds), then mantissa bits."""
    length = np.frexp(fraction.astype(np.float64))[1].astype(np.int64)  # bit length; 0 for 0
    zeros = 32 - length
    shift = length - 1 - MANTISSA
    value = fraction.astype(np.int64)
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0), value << np.maximum(-shift, 0)) & ((1 << MANTISSA) - 1)
    exponent = np.where(mark == 0, np.minimum(zeros, 31), 32 + np.minimum(zeros, 15) + 16 * (mark & 1))
    return ((exponent << MANTISSA) | mantissa).astype(np.uint16)


def minima_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fraction, round) of each bucket's smallest hash, of a non-empty sorted set of 64-bit hashes; round 0 uses the hashes themselves."""
    fraction, mark = np.zeros(REGISTERS, np.uint64), np.full(REGISTERS, -1)
    m, low = np.uint64(REGISTERS), np.uint64(0xFFFFFFFF)
    product = (hashes >> np.uint64(32)) * m
    bucket = (product >> np.uint64(32)).astype(np.int64)  # rising, as the hashes are
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    fraction[bucket[first]], mark[bucket[first]] = product[first] & low, 0
    done, rounds = 1, max(1, FILL * REGISTERS // len(hashes))
    while (mark < 0).any():
        number = np.arange(done, done + rounds, dtype=np.uint64)
        h = mix(hashes[None, :] ^ mix(number * np.uint64(0xD6E8FEB86659FD93))[:, None])
        product = (h >> np.uint64(32)) * m
        key = np.sort(((product >> np.uint64(32) << np.uint64(57)) | ((number - np.uint64(done))[:, None] << np.uint64(32)) | (product & low)).ravel())
        bucket = (key >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        first = first[mark[bucket[first]] < 0]
        fraction[bucket[first]], mark[bucket[first]] = key[first] & low, ((key[first] >> np.uint64(32)) & np.uint64(0x1FFFFFF)).astype(np.int64) + done
        done += rounds
    return fraction, mark


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set of 64-bit hashes."""
    return _encode(*minima_of(hashes))


@functools.lru_cache(maxsize=4096)
def chance_of_collision(size_a: int, size_b: int) -> float:
    """Chance that registers of two unrelated minima agree, by the sets' sizes."""
    e = np.arange(32)

    def exponents(size: int) -> np.ndarray:
        k = max(1.0, size / REGISTERS)
        return (1 - 2.0 ** -(e + 1)) ** k - (1 - 2.0**-e) ** k

    return float((exponents(size_a) * exponents(size_b)).sum() / 2**MANTISSA)


def estimate(matches: np.ndarray | float, chance: np.ndarray | float) -> np.ndarray | float:
    """Jaccard estimate of a number of agreeing registers, less those that agree by chance."""
    return (matches / REGISTERS - chance) / (1 - chance)


def threshold(share: int = SHARE) -> float:
    j = share / OF
    return j - SIGMAS * (j * (1 - j) / REGISTERS) ** 0.5


def band_keys(registers: np.ndarray) -> np.ndarray:
    """[n, BANDS] keys of [n, REGISTERS] registers."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), r.shape[:2])
    for i in range(ROWS):
        key = mix(key ^ (r[:, :, i] + np.uint64(0x10000 * (i + 1))))
    return key.view(np.int64) if key.dtype == np.uint64 else key


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(own, th, text, ...): the id, null ids as the largest number, and a hash of the text, which tell rows apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("own"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), text.alias("text"), *more)


def signatures(rows: DataFrame) -> DataFrame:
    """Per row of :func:`keyed`: own, th, n_shingles, digest of the set, registers (null for an empty set). Map-only."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(2))
            n, digests, minima = [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(data, offsets, SHINGLE, slices):
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        minima.append(minima_of(s))
            encoded = iter(_encode(*map(np.array, zip(*minima, strict=True)))) if minima else iter(())
            registers = [next(encoded).tobytes() if k else None for k in n]
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "th", "n_shingles", "digest", "registers"])

    return rows.select("own", "th", "text").mapInArrow(run, "own bigint, th bigint, n_shingles bigint, digest binary, registers binary")


# ---------------------------------------------------------------- groups in sorted partitions


class Forest:
    """Union-find of a task. The root of a tree is its node of the smallest draw, so that tasks agree on it."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.draw: dict[int, int] = {}

    def know(self, nodes: np.ndarray, draws: np.ndarray) -> None:
        self.draw.update(zip(nodes.tolist(), draws.tolist(), strict=True))

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            first = min(a, b, key=lambda x: (self.draw.get(x, 0), x))
            self.up[b if first == a else a] = first

    def edges(self) -> pa.RecordBatch:
        """An edge from each node to its root."""
        nodes = list(self.up)
        roots = [self.find(x) for x in nodes]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


def chunks_of(size: Column) -> Column:
    return F.ceil(size / F.lit(BLOCK)).cast("int")


def _chunk(n: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")


def in_chunks(members: DataFrame, *payload: str) -> DataFrame:
    """(key, chunk, node, draw, payload) of members (key, size, node, payload), sorted for the first pass.

    A group of up to ``BLOCK`` members is one chunk. Members of a larger one are
    dealt over chunks by hash; its pivots, some ``PIVOTS`` members of the smallest
    draws, stand in all of its chunks.
    """
    n = chunks_of(F.col("size"))
    draw = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(DRAWS))
    pivot = (n > 1) & (draw * n < F.lit(DRAWS // BLOCK * PIVOTS))
    at = F.when(pivot, F.sequence(F.lit(0), n - 1)).otherwise(F.array(_chunk(n, 1)))
    return members.select("key", F.explode(at).alias("chunk"), "node", draw.alias("draw"), *payload).repartition("key", "chunk").sortWithinPartitions("key", "chunk")


def still_apart(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, i, j, side, node, comp) for the second pass over groups (key, size, node) beyond ``BLOCK``.

    ``joined``: (node, component) of the first pass. Members outside their group's
    largest component stand on side 0 of the blocks (i, j) of all j, all members
    on side 1 of the blocks of all i. Groups of one component give no rows.
    """
    own = members.join(joined, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    own = materialise(own.select("key", "size", "node", "comp", _chunk(chunks_of(F.col("size")), 1).alias("j")), "members")
    per = own.groupBy("key", "size", "comp").agg(F.count("*").alias("n"))
    main = per.groupBy("key", "size").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("apart"))
    main = main.where("apart > 0").select("key", "main", chunks_of(F.col("apart")).alias("rows"), chunks_of(F.col("size")).alias("columns"))
    # each chunk of a group meets its own copy of the group's row, so no group is one task's
    rows = own.join(main.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))), ["key", "j"])
    block = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    left = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: block(_chunk(F.col("rows"), 3), j, 0))
    right = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: block(i, F.col("j"), 1))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    blocks = F.concat(F.when(F.col("comp") != F.col("main"), left).otherwise(none), right)
    return rows.select("key", "node", "comp", F.explode(blocks).alias("x")).select("key", "x.i", "x.j", "x.side", "node", "comp")


def _inner_pairs(at: np.ndarray):
    """Index pairs within each group, in pieces of bounded size; groups of one size go together."""
    size = np.diff(at)
    for s in np.unique(size):
        if s < 2:
            continue
        i, j = np.triu_indices(s, 1)
        starts = at[:-1][size == s]
        step = max(1, 20_000 // len(i))
        for k in range(0, len(starts), step):
            base = starts[k : k + step, None]
            for x in range(0, len(i), 50_000):
                yield (base + i[x : x + 50_000]).ravel(), (base + j[x : x + 50_000]).ravel()


def _cross_pairs(at: np.ndarray, side: np.ndarray, comp: np.ndarray):
    """Index pairs of the two sides of each group that aren't in one component."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        low, high = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
        for x in range(0, len(low), 64):
            part = low[x : x + 64]
            p, q = np.repeat(part, len(high)), np.tile(high, len(part))
            differ = comp[p] != comp[q]
            yield p[differ], q[differ]


def _fresh(batches):
    """Batches of (node, ...) without the rows of nodes seen before in this task."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for node in batch.column(0).to_pylist():
            keep.append(node not in seen)
            seen.add(node)
        yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))


def _once(batches, n_keys: int, node: int):
    """Batches sorted by their leading columns and ``node`` without repeated rows."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in (*range(n_keys), node)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last != [c[0] for c in columns]
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = [c[-1] for c in columns]
        yield batch if new.all() else batch.filter(pa.array(new))


# ---------------------------------------------------------------- candidates and links


EDGE = "a bigint, b bigint"


def as_edges(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b"))


def candidate_clusters(nodes: DataFrame, share: int = SHARE) -> DataFrame:
    """(node, component) of components that hold every candidate pair. ``nodes``: node, n_shingles, registers."""

    def bands(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = utf8_column(batch.column(1))
            with np.errstate(over="ignore"):
                keys = band_keys(np.frombuffer(data.tobytes(), np.uint16).reshape(-1, REGISTERS))
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys).ravel()), pa.array(node)], names=["key", "node"])

    least = threshold(share)

    def compare(forest, pairs, node, n, registers):
        data, _ = utf8_column(registers)
        reg = np.frombuffer(data.tobytes(), np.uint16).reshape(-1, REGISTERS)
        for a, b in pairs:
            matches = (reg[a] == reg[b]).sum(1)
            hit = np.flatnonzero(matches >= least * REGISTERS)  # the correction only lowers the estimate
            for x, y, m in zip(a[hit].tolist(), b[hit].tolist(), matches[hit].tolist(), strict=True):
                if estimate(m, chance_of_collision(1 << int(n[x]).bit_length(), 1 << int(n[y]).bit_length())) >= least:
                    forest.join(int(node[x]), int(node[y]))

    def within(batches):
        forest = Forest()
        for t in runs(batches, 2):
            node, draw, n = (t.column(i).to_numpy() for i in range(2, 5))
            forest.know(node, draw)
            compare(forest, _inner_pairs(bounds(t, 2)), node, n, t.column(5))
        yield forest.edges()

    def across(batches):
        forest = Forest()
        for t in runs(batches, 3):
            side, node, comp, n = (t.column(i).to_numpy() for i in range(3, 7))
            compare(forest, _cross_pairs(bounds(t, 3), side, comp), node, n, t.column(7))
        yield forest.edges()

    band = nodes.select("node", "registers").mapInArrow(bands, "key bigint, node bigint")
    total = BANDS * nodes.count()
    shared = materialise(band.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    met = skew_join(band, shared, "key", "size", total, F.col("node"), small=True)
    registers = nodes.select("node", "n_shingles", "registers")
    edges = in_chunks(met.join(registers, "node"), "n_shingles", "registers").mapInArrow(within, EDGE)
    joined = materialise(connected_components(edges), "joined")
    large = shared.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return joined
    apart = still_apart(skew_join(band, large, "key", "size", total, F.col("node"), small=True), joined).join(registers, "node")
    apart = apart.select("key", "i", "j", "side", "node", "comp", "n_shingles", "registers").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = materialise(apart.mapInArrow(across, EDGE), "candidates")
    return joined if more.isEmpty() else connected_components(as_edges(joined).unionByName(more))


def linked(sets: list[np.ndarray], left: list[int] | None = None, right: list[int] | None = None, share: int = SHARE):
    """Index pairs whose sets reach ``share`` of 100; with ``left`` and ``right`` only those between them."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if left is None:
        left = right = list(range(k))
    same = left is right
    if len(left) * len(right) <= 64:
        for x, i in enumerate(left):
            for j in right[x + 1 :] if same else right:
                if OF * min(size[i], size[j]) >= share * max(size[i], size[j]) and size[i]:
                    both = np.sort(np.concatenate([sets[i], sets[j]]))
                    common = int((both[1:] == both[:-1]).sum())
                    if OF * common >= share * (size[i] + size[j] - common):
                        yield i, j
        return
    values, owner = np.concatenate(sets), np.repeat(np.arange(k), size)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    column = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    counts = np.bincount(column)
    keep = counts[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), np.float64)
    width = 8192
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            m = np.zeros((k, width), np.float32)
            m[owner[a:b], column[a:b] % width] = 1
            common += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - common
    hit = (OF * common >= share * union) & (union > 0)
    for x, y in zip(*np.nonzero(np.triu(hit, 1) if same else hit), strict=True):
        yield left[x], right[y]


def confirmed_edges(rows: DataFrame, clusters: DataFrame, share: int = SHARE) -> DataFrame:
    """Spanning forest of the links confirmed on full sets within each cluster.

    ``rows``: own, th, text; ``clusters``: node, component, own, th.
    """

    def confirm(forest, node, at, texts, sides):
        data, offsets = utf8_column(texts)
        sets = shingle_sets(data, offsets, SHINGLE, slices)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = [next(sets) for _ in range(b - a)]
            for i, j in linked(own, *sides(a, b), share):
                forest.join(int(node[a + i]), int(node[a + j]))

    def within(batches):
        forest = Forest()
        for t in runs(_once(batches, 2, 2), 2):
            node = t.column(2).to_numpy()
            forest.know(node, t.column(3).to_numpy())
            confirm(forest, node, bounds(t, 2), t.column(4), lambda a, b: (None, None))
        yield forest.edges()

    def across(batches):
        forest = Forest()
        for t in runs(_once(batches, 4, 4), 3):
            side, node = t.column(3).to_numpy(), t.column(4).to_numpy()
            sides = lambda a, b: (np.flatnonzero(side[a:b] == 0).tolist(), np.flatnonzero(side[a:b] == 1).tolist())  # noqa: B023,E731
            confirm(forest, node, bounds(t, 3), t.column(6), sides)
        yield forest.edges()

    def fetched(found: DataFrame) -> DataFrame:
        """``found`` with one text of each node from every task that has any."""
        small = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        return rows.select("own", "th", "text").join(small, ["own", "th"])

    total = clusters.count()
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    sizes = materialise(sizes, "sizes")
    members = skew_join(clusters, sizes, "component", "size", total, F.col("node"), small=True).select("node", F.col("component").alias("key"), "size", "own", "th")
    members = materialise(members, "members")
    texts = fetched(members).select("node", "key", "size", "text").mapInArrow(_fresh, "node bigint, key bigint, size bigint, text string")
    # rows that repeat the id and text of a representative give it once
    dealt = in_chunks(texts, "text").sortWithinPartitions("key", "chunk", "node")
    edges = dealt.mapInArrow(within, EDGE)
    large = members.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return edges
    joined = materialise(connected_components(edges), "joined")
    apart = materialise(still_apart(large.select("key", "size", "node"), joined), "apart")
    if apart.isEmpty():
        return as_edges(joined)
    wanted = materialise(apart.select("node").distinct().join(large.select("node", "own", "th"), "node"), "wanted")
    found = fetched(wanted).select("node", "text").mapInArrow(_fresh, "node bigint, text string")
    dealt = apart.join(found, "node").select("key", "i", "j", "side", "node", "comp", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    return as_edges(joined).unionByName(dealt.mapInArrow(across, EDGE))


def grouped(rows: DataFrame, share: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``rows``, and their classes: digest, n_rows, first (own, th), of the smallest id of the group.

    With ``by_id`` all texts of an id belong to one group.
    """
    with scratch(rows.sparkSession) as keep:
        found = keep(materialise(signatures(rows), "signatures"))
        usable = found.where("digest is not null")
        first = F.min(F.struct("own", "th")).alias("first")
        nodes = usable.groupBy("digest").agg(first, F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        clusters = materialise(candidate_clusters(nodes, share).join(nodes.select("node", "first.own", "first.th"), "node"), "clusters")
        links = confirmed_edges(rows, clusters, share)
        if by_id:
            links = links.unionByName(_same_id(usable, nodes))
        groups = materialise(connected_components(links).join(nodes.select("node", "first"), "node"), "groups")
        least = groups.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n"))
        least = skew_join(groups, materialise(least, "least"), "component", "n", groups.count(), F.col("node"), small=True).select("node", "least")
        return found, keep(materialise(nodes.join(least, "node", "left").select("digest", "n_rows", F.coalesce("least", "first").alias("least")), "classes"))


def _same_id(usable: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between each id of several classes, as a negative node, and its classes."""
    h = F.xxhash64("digest")
    several = usable.where(F.col("own") != NO_ID).groupBy("own").agg(F.min(h).alias("a"), F.max(h).alias("b"), F.count("*").alias("n")).where("a <> b")
    several = materialise(several.select("own", "n", (-1 - F.monotonically_increasing_id()).alias("b")), "several")
    total = usable.count()
    own = skew_join(usable.select("own", "digest"), several, "own", "n", total, F.col("digest")).select("b", "digest").distinct()
    return skew_join(own, nodes.select("digest", "n_rows", F.col("node").alias("a")), "digest", "n_rows", total, F.col("b")).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """Per document: doc id, n_shingles, component_id, kept (ids must be integers). Sets link from ``share`` of 100 on."""
    found, classes = grouped(keyed(docs, id_col, text_col), share, True)
    named = classes.select("digest", "n_rows", F.col("least.own").alias("least"))
    out = skew_join(found.select("own", "n_shingles", "digest"), named, "digest", "n_rows", found.count(), F.col("own"), "left", small=True)
    own = F.when(F.col("own") != NO_ID, F.col("own"))
    component = F.when(own.isNotNull(), F.coalesce("least", "own"))
    return out.select(own.alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id, with the columns of ``docs``."""
    rows = keyed(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found, classes = grouped(rows, share, False)
    total = found.count()
    of = skew_join(found.where("digest is not null").select("own", "th", "digest"), classes, "digest", "n_rows", total, F.col("own"), "left", small=True)
    kept = (F.col("own") == F.col("least.own")) & (F.col("th") == F.col("least.th"))
    verdict = of.select("own", "th", kept.alias("kept")).groupBy("own", "th").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    verdict = materialise(verdict.where("not kept or n > 1"), "verdicts")
    few = verdict.count() <= BROADCAST_ROWS
    told = rows.join(F.broadcast(verdict) if few else verdict, ["own", "th"], "left")
    out = told.where("n is null").select("row.*")
    if verdict.where("kept").isEmpty():
        return out
    # rows that repeat id and text: any one of them
    return out.unionByName(told.where("kept").groupBy("own", "th").agg(F.first("row").alias("row")).select("row.*"))
