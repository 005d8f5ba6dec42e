"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the BLAKE2b-128 of the line, stripped and with A-Z in lower
case; keys of fewer than ``LEAST`` code points are never dropped. A
:class:`LineIndex` is a folder of generations, one for each batch of insertions
or deletions, each committed by its last table:

- ``postings``: the distinct (key, id) of a batch; ``gone``: the ids of a deletion;
- ``refs``: for each key that a batch touched, the exact number of documents that
  hold it, before and after, and its owner, the smallest id. The newest row of a
  key counts;
- ``filters``: for each shard of keys two cuckoo filters, ``live`` (keys that any
  document holds) and ``repeated`` (keys that several hold).

Keys that miss ``live`` are new and need no look into the tables; lines that miss
``repeated`` stay without one. Hits are confirmed by the exact tables, so false
positives change nothing. Deleting a document takes its references back: counts
fall, owners pass to the next smallest id, fingerprints leave the filters, and
:meth:`LineIndex.dedupe` gives what an index without that document would.

Shards hold ``SHARD_KEYS`` keys; when the keys outgrow them, or a filter can't
take a key, filters are built anew over more shards from the exact counts. A
shard's rows are dealt over several tasks where they are many, its filter once
to each, and so are the lines of a hot key. A deletion reads the postings once,
ids and keys alone.

Defined cases: a null or empty text is one empty line; rows that repeat an id are
one document; rows of null id are one document too, the last one; a document that
is inserted again adds the keys it didn't hold; deleting an unknown id changes
nothing; a document outside the index loses the lines whose keys two indexed
documents hold, or one of a smaller id; all lines of the owner stay, repeated ones
too; very long texts are read whole; a text that loses no line is returned as it
is, null included; other columns travel in a struct, so no name can clash; an empty
table gives an empty generation and no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import HOT_KEYS, bounded_batches, materialise, scratch, skew_join, utf8_column
from loomtext.llm.cuckoo import KEYS, Cuckoo

SPACE = " \t\n\x0b\x0c\r"
LEAST = 10
SHARD_KEYS = KEYS
#: Rows of one part of a shard at least.
PART_ROWS = 100_000


# ---------------------------------------------------------------- keys


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes | None]]:
    """(lines, row of each line, key of each line or none) of a string column."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = split.flatten()
    row = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    folded = pc.ascii_lower(pc.ascii_trim(lines, SPACE)).dictionary_encode()
    words = folded.dictionary
    long = pc.greater_equal(pc.utf8_length(words), LEAST).to_pylist()
    digest = [hashlib.blake2b(w, digest_size=16).digest() if ok else None for w, ok in zip(words.cast(pa.binary()).to_pylist(), long, strict=True)]
    return lines, row, [digest[i] for i in folded.indices.to_pylist()]


def _as_numbers(keys: pa.Array) -> np.ndarray:
    """[n, 2] uint64 of a binary column of 16 bytes a row."""
    return np.frombuffer(utf8_column(keys)[0].tobytes(), np.uint64).reshape(-1, 2)


def line_keys(docs: DataFrame) -> DataFrame:
    """(id, tag, key), distinct within a batch, of (id, tag, text) rows."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                _, row, keys = keys_of(b.column(2))
                pairs = list(dict.fromkeys((i, k) for i, k in zip(row.tolist(), keys, strict=True) if k is not None))
                rows = pa.array([i for i, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([k for _, k in pairs], pa.binary())], names=["id", "tag", "key"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tag bigint, key binary")


def _own_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


# ---------------------------------------------------------------- filters


def probed(rows: DataFrame, filters: DataFrame, name: str, shards: int, *, only_hits: bool) -> DataFrame:
    """``rows``, which hold ``key``, with ``hit``: whether the filter of the key's shard contains it."""
    bounded_batches(rows.sparkSession)
    rows = rows.withColumn("shard", _shard(shards))
    counts = materialise(rows.groupBy("shard").count(), "shards")
    total = counts.agg(F.sum("count")).first()[0] or 0
    most = max(PART_ROWS, total // HOT_KEYS)
    # at most HOT_KEYS shards have more rows than that
    hot = F.broadcast(counts.where(F.col("count") > most).select("shard", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    names = [c for c in rows.columns if c != "shard"]
    dealt = rows.join(hot, "shard", "left").withColumn("part", F.pmod(F.xxhash64(*names), parts).cast("int"))
    dealt = dealt.select("shard", "part", F.lit(1).alias("is_row"), F.lit(None).cast("binary").alias("filter"), *names)
    each = filters.join(hot, "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    each = each.select("shard", "part", F.lit(0).alias("is_row"), F.col(name).alias("filter"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names))
    at = 4 + names.index("key")

    def run(batches):
        now, held = None, None
        for b in batches:
            place = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if x == y:
                    continue
                if not place[x, 2]:
                    now, held = tuple(place[x, :2]), Cuckoo.read(b.column(3)[x].as_buffer())
                    continue
                own = b.slice(x, y - x)
                hit = held.contains(_as_numbers(own.column(at))) if now == tuple(place[x, :2]) else np.zeros(y - x, bool)
                out = pa.RecordBatch.from_arrays([*own.columns[4:], pa.array(hit)], names=[*names, "hit"])
                yield out.filter(pa.array(hit)) if only_hits else out

    both = dealt.unionByName(each).repartition("shard", "part").sortWithinPartitions("shard", "part", "is_row")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return both.mapInArrow(run, f"{fields}, hit boolean")


def changed_filters(filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """(shard, live, repeated, full) after changes (key, live, repeated), whose counts are 1, 0 or -1; ``full`` marks a filter that couldn't take a key."""
    bounded_batches(changes.sparkSession)
    none = F.lit(None).cast("binary")
    rows = changes.select(_shard(shards).alias("shard"), F.lit(1).alias("is_row"), none.alias("f_live"), none.alias("f_repeated"), "key", "live", "repeated")
    old = filters if filters is not None else changes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), none.alias("live"), none.alias("repeated"))
    zero = F.lit(0).cast("int")
    old = old.select("shard", F.lit(0).alias("is_row"), F.col("live").alias("f_live"), F.col("repeated").alias("f_repeated"), none.alias("key"), zero.alias("live"), zero.alias("repeated"))

    def apply(held: Cuckoo, keys: np.ndarray, change: np.ndarray) -> bool:
        held.remove(keys[change < 0])
        return held.add(keys[change > 0])

    def run(batches):
        now, held, full = None, (), False

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([h.write()], pa.binary()) for h in held), pa.array([full])], names=["shard", "live", "repeated", "full"])

        for b in batches:
            place = np.stack([b.column(i).to_numpy() for i in range(2)], 1)
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if x == y:
                    continue
                if not place[x, 1]:
                    if now is not None:
                        yield done()
                    now, full = int(place[x, 0]), False
                    held = tuple(Cuckoo.read(b.column(i)[x].as_buffer()) if b.column(i)[x].is_valid else Cuckoo.empty() for i in (2, 3))
                    continue
                keys = _as_numbers(b.column(4).slice(x, y - x))
                for h, i in zip(held, (5, 6), strict=True):
                    full = not apply(h, keys, b.column(i).slice(x, y - x).to_numpy()) or full
        if now is not None:
            yield done()

    both = old.unionByName(rows).repartition("shard").sortWithinPartitions("shard", "is_row")
    return both.mapInArrow(run, "shard int, live binary, repeated binary, full boolean")


# ---------------------------------------------------------------- index


class LineIndex:
    """Reference counts of line keys in a folder that all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint") -> None:
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self.generations: list[int] = self._committed()
        last = self.spark.read.parquet(f"{self.path}/state/{self.generations[-1]}").first() if self.generations else None
        self.shards, self.keys = (last["shards"], last["keys"]) if last else (1, 0)

    def _committed(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()) for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _write(self, df: DataFrame, name: str, generation: int) -> DataFrame:
        # what a failed writer left behind isn't committed and is replaced
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{generation}")
        return self._read(name, generation, df.schema)

    def _read(self, name: str, generation: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{generation}")

    def _all(self, name: str, schema: str) -> DataFrame:
        """All generations of a table, with their number."""
        out = self.spark.createDataFrame([], f"{schema}, generation int")
        for g in self.generations:
            out = out.unionByName(self._read(name, g, schema).withColumn("generation", F.lit(g)))
        return out

    @property
    def _refs_schema(self) -> str:
        return f"key binary, refs bigint, owner {self.id_type}, before bigint"

    def filters(self) -> DataFrame:
        return self._read("filters", self.generations[-1], "shard int, live binary, repeated binary, full boolean").drop("full")

    def refs(self) -> DataFrame:
        """(key, refs, owner): the newest of each key, also those that nothing refers to any more."""
        if len(self.generations) == 1:
            return self._read("refs", self.generations[0], self._refs_schema).drop("before")
        newest = F.max_by(F.struct("refs", "owner"), "generation").alias("newest")
        return self._all("refs", self._refs_schema).groupBy("key").agg(newest).select("key", "newest.*")

    def postings(self) -> DataFrame:
        """(key, id) of the documents that are in."""
        rows = self._all("postings", f"key binary, id {self.id_type}")
        gone = self._all("gone", f"id {self.id_type}").groupBy("id").agg(F.max("generation").alias("last")).withColumnRenamed("id", "gone_id")
        rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")), "left").where("last IS NULL OR last < generation")
        return rows.select("key", "id").distinct()

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """A generation with the keys of ``docs``."""
        generation = (self.generations or [0])[-1] + 1
        rows = _own_rows(docs, id_col, text_col).withColumn("tag", F.lit(0).cast("bigint"))
        rows = line_keys(rows).select("key", "id").distinct()
        with scratch(self.spark):
            if self.generations:
                rows = materialise(probed(materialise(rows, "keys"), self.filters(), "live", self.shards, only_hits=False), "probed")
                held = self.postings().select("key", F.col("id").alias("held"), F.lit(True).alias("in"))
                again = rows.where("hit").join(held, ["key"], "left_semi")
                known = again.join(held, (again["key"] == held["key"]) & F.col("id").eqNullSafe(F.col("held")), "left_anti")
                rows = rows.where("not hit").unionByName(rows.where("hit").join(held, ["key"], "left_anti")).unionByName(known)
            rows = self._write(rows.select("key", "id"), "postings", generation)
            counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
            if self.generations:
                old = self.refs().withColumnsRenamed({"refs": "old_refs", "owner": "old_owner"})
                counts = counts.join(old, "key", "left")
                before = F.coalesce("old_refs", F.lit(0).cast("bigint"))
                # an owner of an earlier time counts only while the key is referred to
                owner = F.least("first", F.when(before > 0, F.col("old_owner")))
            else:
                before, owner = F.lit(0).cast("bigint"), F.col("first")
            refs = counts.select("key", (F.col("n") + before).alias("refs"), owner.alias("owner"), before.alias("before"))
            self._commit(generation, refs, self.spark.createDataFrame([], f"id {self.id_type}"))
        return self

    def delete(self, ids: DataFrame) -> LineIndex:
        """A generation without the documents of ``ids``, one column."""
        generation = (self.generations or [0])[-1] + 1
        ids = ids.select(F.col(ids.columns[0]).cast(self.id_type).alias("id")).distinct()
        with scratch(self.spark):
            ids = materialise(ids, "ids")
            marked = materialise(self.postings().join(ids.withColumn("gone", F.col("id")).select("gone", F.lit(True).alias("out")), F.col("id").eqNullSafe(F.col("gone")), "left").drop("gone"), "marked")
            touched = marked.where("out").groupBy("key").agg(F.count("*").alias("removed"))
            rest = marked.where("out IS NULL").join(touched.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("refs"), F.min("id").alias("owner"))
            left = F.coalesce("refs", F.lit(0).cast("bigint"))
            refs = touched.join(rest, "key", "left").select("key", left.alias("refs"), "owner", (left + F.col("removed")).alias("before"))
            self._write(self.spark.createDataFrame([], f"key binary, id {self.id_type}"), "postings", generation)
            self._commit(generation, refs, ids)
        return self

    def _commit(self, generation: int, refs: DataFrame, gone: DataFrame) -> None:
        refs = self._write(refs, "refs", generation)
        self._write(gone, "gone", generation)
        step = lambda least: F.when((F.col("refs") >= least) & (F.col("before") < least), 1).when((F.col("refs") < least) & (F.col("before") >= least), -1).otherwise(0)
        changes = refs.select("key", step(1).cast("int").alias("live"), step(2).cast("int").alias("repeated")).where("live <> 0 OR repeated <> 0")
        keys = self.keys + (changes.agg(F.sum("live")).first()[0] or 0)
        shards, old = max(self.shards, _power_of_two(keys / SHARD_KEYS)), None
        if shards == self.shards:
            old = self.filters() if self.generations else None
        self.generations.append(generation)
        while True:
            if old is None and len(self.generations) > 1:
                now = self.refs().where("refs > 0")
                changes = now.select("key", F.lit(1).alias("live"), (F.col("refs") > 1).cast("int").alias("repeated"))
            written = self._write(changed_filters(old, changes, shards), "filters", generation)
            if written.where("full").isEmpty():
                break
            shards, old = shards * 2, None
        self.shards, self.keys = shards, keys
        self._write(self.spark.createDataFrame([(shards, keys)], "shards int, keys bigint"), "state", generation)

    def dedupe(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(row, n_lines, n_dropped): each row of ``docs`` as a struct, its text without the lines that a smaller id holds."""
        own = _own_rows(docs, id_col, text_col)
        with scratch(self.spark) as keep:
            keys = materialise(line_keys(own).distinct(), "keys")
            hits = materialise(probed(keys, self.filters(), "repeated", self.shards, only_hits=True).drop("hit"), "hits")
            counts = hits.groupBy("key").agg(F.count("*").alias("n"))
            owners = materialise(self.refs().where("refs > 1").join(counts, "key"), "owners")
            held = skew_join(hits, owners, "key", "n", hits.count(), F.xxhash64("id", "tag"))
            drops = held.where(~F.col("id").eqNullSafe(F.col("owner"))).groupBy("id", "tag").agg(F.collect_set("key").alias("drop"))
            drops = keep(materialise(drops.withColumnsRenamed({"id": "d_id", "tag": "d_tag"}), "drops"))
        rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("text"))
        joined = rows.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("tag") == F.col("d_tag")), "left").select("row", "text", "drop")
        return _without(joined, text_col)


def _without(rows: DataFrame, text_col: str) -> DataFrame:
    """(row, n_lines, n_dropped) of (row, text, drop): the lines whose keys are in ``drop`` go."""
    kind = rows.schema["row"].dataType

    def run(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(1), b.column(2), strict=True):
                if not drop.is_valid:
                    texts.append(text.as_py())
                    n_lines.append((texts[-1] or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                drop = set(drop.as_py())
                lines, _, keys = keys_of(pa.array([text.as_py()], pa.string()))
                kept = [x for x, k in zip(lines.to_pylist(), keys, strict=True) if k not in drop]
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])

    bounded_batches(rows.sparkSession)
    out = rows.mapInArrow(run, f"row {kind.simpleString()}, text string, n_lines bigint, n_dropped bigint")
    return out.select(F.col("row").withField(f"`{text_col}`", F.col("text")).alias("row"), "n_lines", "n_dropped")


def _power_of_two(n: float) -> int:
    out = 1
    while out < n:
        out *= 2
    return out
