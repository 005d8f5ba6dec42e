"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark item is normalised to words and cut into windows of ``window``
consecutive words (an item of fewer words, but not none, is one window). All
windows become patterns of one automaton over word numbers, whose states stand in
flat arrays; it is built once, on the driver, and broadcast. Each document is
scanned once: words that no item has send the automaton back to its start, so
only stretches of known words are stepped through, many at a time. Hits are word
intervals; :func:`find_passages` maps them to code-point offsets of the original
text.

Defined cases: a null or wordless document has no words and no hits; a null or
wordless item has no windows; every document row gives its own row, whatever
its id and the size of the benchmark; a null item id is the text ``null``;
repeated item ids count once; an empty benchmark hits nothing; very long texts
are scanned whole, in pieces that overlap; columns of the inputs other than the
named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import bounded_batches, materialise, slices, utf8_column

WINDOW = 13
#: Benchmark text that one automaton holds at most; a larger benchmark is scanned in blocks of this size.
#: An automaton has at most ``window`` states a word and 16 bytes a state, so some 200 MB for usual words.
AUTOMATON_BYTES = 6_000_000
#: Words of one piece that is stepped through.
PIECE = 256
#: Text that is scanned at once.
SLICE_BYTES = 2_000_000

#: Byte table: A-Z to lower case, every other ASCII byte that is no word byte to a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in UTF-8."""
    return (text or "").encode().translate(_NORMAL).split()


@dataclass
class Automaton:
    """States are numbered level by level; state 0 is the start."""

    vocabulary: dict[bytes, int]  # words to numbers from 1 on
    edges: np.ndarray  # sorted (state << 32 | word); edge i leads to state i + 1
    fail: np.ndarray  # of each state: the state of its longest proper suffix
    out: np.ndarray  # of each state: the longest pattern that ends there, as a state, or 0
    depth: np.ndarray  # first state of each level
    shortest: int  # words of the shortest pattern
    longest: int
    owned: np.ndarray  # sorted states where patterns end, one row for each owner
    owners: np.ndarray  # their items
    items: list[str]

    def child(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state that an edge leads to, or -1."""
        key = (state.astype(np.int64) << 32) | word
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, at + 1, -1)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        to = self.child(state, word)
        open_ = np.flatnonzero(to < 0)
        while len(open_):
            at_start = state[open_] == 0
            to[open_[at_start]] = 0
            open_ = open_[~at_start]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
            to[open_] = self.child(state[open_], word[open_])
            open_ = open_[to[open_] < 0]
        return to

    def words(self, state: np.ndarray) -> np.ndarray:
        """Words of the prefix that a state stands for."""
        return np.searchsorted(self.depth, state, side="right") - 1

    def names(self, states: np.ndarray) -> set[str]:
        """Items that own a pattern which ends in one of the states."""
        found, states = set(), np.unique(states)
        while len(states):
            low, high = np.searchsorted(self.owned, states), np.searchsorted(self.owned, states, side="right")
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                found.update(self.owners[a:b].tolist())
            states = np.unique(self.out[self.fail[states]])
            states = states[states > 0]
        return {self.items[i] for i in found}


def build_automaton(items: list[tuple[object, str | None]], window: int = WINDOW) -> Automaton | None:
    """Automaton over the windows of (item id, text); none if there are no words."""
    vocabulary: dict[bytes, int] = {}
    text, starts, owner, names = array("i"), [], [], []
    for item_id, item in items:
        words = words_of(item)
        if not words:
            continue
        first = len(text)
        text.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
        size = min(window, len(words))
        n = len(words) - size + 1
        starts.append(np.stack([np.arange(first, first + n), np.full(n, size)]))
        owner.append(np.full(n, len(names)))
        names.append("null" if item_id is None else str(item_id))
    if not names:
        return None
    words = np.frombuffer(text, np.int32).astype(np.int64)
    (start, size), owner = np.concatenate(starts, 1), np.concatenate(owner)
    automaton = Automaton(vocabulary, np.zeros(0, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int64), int(size.min()), int(size.max()), np.zeros(0), np.zeros(0), names)
    state, level = np.zeros(len(start), np.int64), 0
    edges, ends = [], np.zeros(len(start), np.int64)
    firsts, states = [0], 1
    for level in range(int(size.max())):
        live = np.flatnonzero(size > level)
        key, place = np.unique((state[live] << 32) | words[start[live] + level], return_inverse=True)
        edges.append(key)
        firsts.append(states)
        state[live] = states + place
        states += len(key)
        done = live[size[live] == level + 1]
        ends[done] = state[done]
    automaton.edges, automaton.depth = np.concatenate(edges), np.array(firsts)
    fail, out = np.zeros(states, np.int32), np.zeros(states, np.int32)
    out[ends] = ends
    automaton.fail, automaton.out = fail, out
    for level, key in enumerate(edges):
        own = firsts[level + 1] + np.arange(len(key))
        if level:
            parent = key >> 32
            fail[own] = automaton.step(fail[parent].astype(np.int64), key & 0xFFFFFFFF)
        out[own] = np.where(out[own] > 0, out[own], out[fail[own]])
    pairs = np.unique(np.stack([ends, owner]), axis=1)
    automaton.owned, automaton.owners = pairs[0].astype(np.int32), pairs[1].astype(np.int32)
    return automaton


def scan(texts: list[list[bytes]], automaton: Automaton | None) -> Iterator[tuple[list[tuple[int, int]], set[str]]]:
    """Of each list of words: merged intervals [start, end) inside windows, and the items that own them."""
    if automaton is None:
        yield from (([], set()) for _ in texts)
        return
    number = automaton.vocabulary.get
    ids = np.array([number(w, 0) for words in texts for w in (*words, b"")], np.int64)  # texts end with an unknown word
    bounds = np.cumsum([0] + [len(words) + 1 for words in texts])
    known = np.flatnonzero(np.diff((ids > 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    first, last = known[::2], known[1::2]
    enough = last - first >= automaton.shortest
    first, last = first[enough], last[enough]
    # stretches of known words in pieces, each with the words before it that a window may begin in
    pieces = -(-(last - first) // PIECE)
    own = np.repeat(first, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(own + PIECE, np.repeat(last, pieces))
    at = np.maximum(own - automaton.longest + 1, np.repeat(first, pieces))
    order = np.argsort(at - end, kind="stable")
    own, end, at = own[order], end[order], at[order]
    length, state = end - at, np.zeros(len(at), np.int64)
    found_at, found = [], []
    for i in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -i, side="left"))  # pieces of more than i words
        state[:n] = automaton.step(state[:n], ids[at[:n] + i])
        out = automaton.out[state[:n]]
        hit = np.flatnonzero((out > 0) & (at[:n] + i >= own[:n]))
        if len(hit):
            found_at.append(at[hit] + i)
            found.append(out[hit])
    places, states = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_at, found))
    order = np.argsort(places, kind="stable")
    places, states = places[order], states[order]
    begins = places + 1 - automaton.words(states)
    cuts = np.searchsorted(places, bounds)
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        merged: list[tuple[int, int]] = []
        # intervals in the order of their ends: a later one may begin before several earlier ones
        for x, y in zip((begins[a:b] - bounds[k]).tolist(), (places[a:b] + 1 - bounds[k]).tolist(), strict=True):
            while merged and x <= merged[-1][1]:
                x = min(x, merged.pop()[0])
            merged.append((x, y))
        yield merged, automaton.names(states[a:b]) if merged else set()


def original_offsets(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets [start, end) in ``text`` of word intervals."""
    if not intervals:
        return []
    raw = text.encode()
    plain = raw.translate(_NORMAL)
    wanted = sorted({i for s, e in intervals for i in (s, e - 1)})
    place, pos, n = {}, 0, 0
    for word in plain.split():
        pos = plain.index(word, pos)
        if n == wanted[len(place)]:
            place[n] = (pos, pos + len(word))
            if len(place) == len(wanted):
                break
        pos += len(word)
        n += 1
    return [(len(raw[: place[s][0]].decode()), len(raw[: place[e - 1][1]].decode())) for s, e in intervals]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size; never more than one block on the driver."""
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(row[1].encode())
        if block and size + n > most_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def _scan_block(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, window: int, only_hits: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(build_automaton(items, window))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automaton = shared.value
        for batch in batches:
            rows = {"n_words": [], "starts": [], "ends": [], "items": [], "passages": []}
            keep = []
            _, offsets = utf8_column(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                words = [words_of(t) for t in texts]
                for i, (text, own, (intervals, found)) in enumerate(zip(texts, words, scan(words, automaton), strict=True), a):
                    if only_hits and not intervals:
                        continue
                    keep.append(i)
                    rows["n_words"].append(len(own))
                    rows["starts"].append([s for s, _ in intervals])
                    rows["ends"].append([e for _, e in intervals])
                    rows["items"].append(sorted(found))
                    rows["passages"].append([{"start": s, "end": e} for s, e in original_offsets(text or "", intervals)])
            ids = batch.column(0).take(pa.array(keep, pa.int64())) if only_hits else batch.column(0)
            passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(rows["n_words"], pa.int64()), pa.array(rows["starts"], pa.list_(pa.int64())), pa.array(rows["ends"], pa.list_(pa.int64())), pa.array(rows["items"], pa.list_(pa.string())), pa.array(rows["passages"], passage)],
                names=[id_col, "n_words", "starts", "ends", "items", "passages"],
            )

    schema = f"`{id_col}` {id_type}, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>, passages array<struct<start:bigint,end:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Per document: n_words, n_hit, item ids, and hit passages as original offsets.

    A benchmark of at most ``automaton_bytes`` is one broadcast automaton and one
    map-only scan of the documents. A larger one is scanned in blocks: the rows are written once
    with a key of their own, each block scans them, and the word intervals are
    merged by that key, so repeated and null ids keep their rows.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, automaton_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        whole = _scan_block(docs, first, id_col, text_col, window, False)
        n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return whole.select(id_col, "n_words", n_hit.alias("n_hit"), "items", "passages")
    key = F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    rows = materialise(docs.select(key.alias("key"), F.col(text_col).alias("text")), "keyed")
    both = _scan_block(rows, first, "key", "text", window, False)
    for block in itertools.chain([second], blocks):
        more = _scan_block(rows, block, "key", "text", window, True)
        both = both.unionByName(more.withColumn("n_words", F.lit(None).cast("bigint")))
    cols = ("starts", "ends", "items", "passages")
    merged = both.groupBy("key").agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in cols))
    spans = F.aggregate(F.array_sort(F.arrays_zip("starts", "ends", "passages")), F.array().cast("array<struct<s:bigint,e:bigint,start:bigint,end:bigint>>"), _merge)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    passages = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return merged.withColumn("spans", spans).select(
        F.col("key.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), passages.alias("passages")
    )


def _merge(done: Column, x: Column) -> Column:
    """``done`` with an interval of words and its passage, which grows the last one if they meet."""
    last = F.get(done, F.size(done) - 1)
    entry = lambda *c: F.array(F.struct(*(v.alias(n) for v, n in zip(c, ("s", "e", "start", "end"), strict=True))))
    grown = entry(last["s"], F.greatest(last["e"], x["ends"]), last["start"], F.greatest(last["end"], x["passages"]["end"]))
    new = entry(x["starts"], x["ends"], x["passages"]["start"], x["passages"]["end"])
    return F.when(x["starts"] <= last["e"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), grown)).otherwise(F.concat(done, new))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """:func:`find_passages` with the verdict: contaminated when n_hit > 0 and ``share`` * n_hit >= n_words."""
    return find_passages(docs, benchmark, **options).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """The rows that aren't contaminated, with the columns of ``docs``; each row is judged by its own text, whatever its id.

    With one automaton whole rows are filtered where they are. With several, rows
    are written once with a key of their own and the contaminated keys go.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, automaton_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        spark = docs.sparkSession
        bounded_batches(spark)
        shared = spark.sparkContext.broadcast(build_automaton(first, window))
        at = docs.columns.index(text_col)

        def run(batches):
            for batch in batches:
                keep = []
                _, offsets = utf8_column(batch.column(at))
                for a, b in slices(offsets, SLICE_BYTES):
                    words = [words_of(t) for t in batch.column(at).slice(a, b - a).to_pylist()]
                    n_hit = [sum(e - s for s, e in intervals) for intervals, _ in scan(words, shared.value)]
                    keep += [n == 0 or share * n < len(w) for n, w in zip(n_hit, words, strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = materialise(docs.select(row, F.monotonically_increasing_id().alias("key"), F.col(text_col).alias("text")), "rows")
    options = {"item_col": item_col, "item_text_col": item_text_col, "window": window, "automaton_bytes": automaton_bytes}
    found = decontaminate(rows, benchmark, share=share, id_col="key", **options).where("contaminated").select("key")
    return rows.join(found, "key", "left_anti").select("row.*")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
