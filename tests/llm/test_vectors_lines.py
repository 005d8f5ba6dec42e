"""Ball trees, heap Lloyd and the line index against brute force, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import balltree, codes, lines
from loomtext.llm.cuckoo import BUCKETS, SLOTS, Cuckoo
from loomtext.llm.lines import LineIndex

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, v, lab in rows], VECTORS)
    return df.withColumns({c: F.lit(1) for c in ("cluster", "ids", "x", "error", "code", "n", "place")}).repartition(3)


def exact_floor(scale, v):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def nearest(x, book):
    d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
    return d.index(min(d)), min(d)


def lloyd(rows, book, rounds):
    for _ in range(rounds):
        own = [nearest(x, book)[0] for x in rows]
        for j in range(len(book)):
            mine = [x for x, o in zip(rows, own, strict=True) if o == j]
            if mine:
                book[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [nearest(x, book) for x in rows], book


def clustered(rng, n, dim=64, centres=7):
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.01


ODD = [(900, None, 1), (901, [1.0] * 63, 1), (902, [], None), (903, [None] + [1.0] * 63, 2), (904, [float("nan")] * 64, 2), (905, [float("inf")] * 64, 3), (906, [1e9] * 64, 3)]


def brute_clusters(rows, k, rounds):
    held = [(i, exact_floor(256, v)) for i, v, _ in rows]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    found, book = lloyd([x for _, x in held], [list(x) for _, x in order[:k]], rounds)
    inertia = [sum(d for c, d in found if c == j) for j in range(k)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (c, d) in zip(held, found, strict=True))


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal"])
def test_clusters_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=(150, 64)), "clustered": clustered(rng, 300), "equal": np.repeat(rng.integers(-1, 2, (3, 64)), 50, 0)}[kind]
    rows = [(i if i != 5 else None, v.tolist(), i % 3) for i, v in enumerate(x)] + [(7, x[0].tolist(), 1), (7, x[0].tolist(), 1)]
    got = balltree.cluster_vectors(vectors(spark, rows + ODD), centroids=12, rounds=3).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in got) == brute_clusters(rows, 12, 3)


def test_clusters_of_few_and_no_rows(spark):
    rows = [(1, [0.5] * 64, 1), (2, [-0.5] * 64, 1)]
    got = balltree.cluster_vectors(vectors(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute_clusters(rows, 2, 5)
    assert balltree.cluster_vectors(vectors(spark, ODD)).count() == 0
    assert balltree.cluster_vectors(vectors(spark, rows).limit(0)).count() == 0
    assert [r.vec_id for r in balltree.left_out(vectors(spark, ODD + rows)).collect()] == [906]


def test_balls_are_exact_and_skip_most_vectors():
    rng = np.random.default_rng(1)
    x = np.floor(clustered(rng, 4096) * 256).astype(np.int64)
    book = x[rng.integers(0, len(x), 7)]
    book[1] = book[0]  # a tie of centroids
    tree, order = balltree.Tree.build(x)
    own = x[order]
    tree = balltree.Tree.read(tree.write(), 64)
    for node in range(len(tree.start)):
        part = own[tree.start[node] : tree.stop[node]]
        assert (part.sum(0) == tree.total[node]).all()
        assert np.square(part - tree.centre[node]).sum(1).max() == tree.radius[node]
    cluster, distance = balltree.nearest_centroids(tree, own, book)
    d = np.square(own[:, None, :] - book[None]).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    centres = np.stack([own[cluster == c].sum(0) // max(1, (cluster == c).sum()) for c in np.unique(cluster)])
    n, s = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
    compared = balltree.add_sums(tree, own, centres, n, s)
    assert compared < len(x) // 2 and n.sum() == len(x) and (s.sum(0) == x.sum(0)).all()


def test_large_integers_stay_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 24), 1 << 24, (50, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in x[:5]] for u in x]
    assert balltree.squared(x, x[:5]).tolist() == want


def brute_codes(rows, entries, rounds, width=16):
    held = [(i, exact_floor(1024, v), lab) for i, v, lab in rows]
    order = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    found, books = [], []
    for p in range(4):
        cut = slice(p * width, (p + 1) * width)
        f, book = lloyd([x[cut] for _, x, _ in held], [list(x[cut]) for _, x, _ in order], rounds)
        found.append(f), books.append(book)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    rows = [(i, "".join(f"{f[n][0]:02x}" for f in found), sum(f[n][1] for f in found), lab) for n, (i, _, lab) in enumerate(held)]
    return sorted(((-1 if i is None else i), c, e, sum(o[2] for o in rows if o[3] == lab), digest) for i, c, e, lab in rows)


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal"])
def test_codes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = {"spread": rng.normal(size=(120, 64)), "clustered": clustered(rng, 200), "equal": np.repeat(rng.integers(-1, 2, (3, 64)), 40, 0)}[kind]
    rows = [(i if i != 5 else None, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)] + [(7, x[1].tolist(), 1)] * 2
    odd = [r for r in ODD if r[0] != 902]
    got = codes.compress(vectors(spark, rows + odd), entries=16, rounds=3).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in got) == brute_codes(rows, 16, 3)


def test_codes_of_other_dimensions_and_no_rows(spark):
    rows = [(i, [i / 7, 0.25, -i, 1.0, 0.5, i % 2], None) for i in range(9)]
    got = codes.compress(vectors(spark, rows), entries=4, rounds=2).collect()
    padded = [(i, [*v, 0.0, 0.0], lab) for i, v, lab in rows]
    assert sorted(tuple(r) for r in got) == brute_codes(padded, 4, 2, width=2)
    assert codes.compress(vectors(spark, ODD[:1])).count() == 0
    assert codes.compress(vectors(spark, rows).limit(0)).count() == 0
    assert [r.vec_id for r in codes.left_out(vectors(spark, ODD)).collect()] == [906]


def test_heaps_pop_only_what_drift_has_violated():
    rng = np.random.default_rng(7)
    # 64 entries: one for each of 60 clusters, and four that share one
    middle = rng.normal(size=(60, 16))
    x = np.floor((middle[np.arange(3000) % 60] + rng.normal(size=(3000, 16)) * 0.01) * 1024).astype(np.int64)
    x[60:64] = x[0] + np.arange(4)[:, None]
    books, shrunk, heaps, compared = x[:64].copy()[None], np.zeros((1, 64)), None, []
    total = np.zeros((64, 17), np.int64)
    for _ in range(6):
        heaps, n, s, c = codes.step(x, heaps, books[0], shrunk[0])
        compared.append(c)
        d = np.square(x[:, None, :] - books[0][None]).sum(2)
        assert (heaps.entries(len(x)) == d.argmin(1)).all()
        total += np.hstack([n[:, None], s])
        assert (total[:, 0] == np.bincount(d.argmin(1), minlength=64)).all()
        new, used = books.copy(), total[:, 0] > 0
        new[0, used] = total[used, 1:] // total[used, :1]
        shrunk, books = shrunk + codes.shrinkage(books, new), new
        heaps = codes.Heaps.read(heaps.write(), 64, len(x))
    assert compared[0] == len(x) and 0 < sum(compared[1:]) < len(x)


# ---------------------------------------------------------------- lines


def test_cuckoo_filter_holds_what_was_added():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (int(BUCKETS * SLOTS * 0.9), 2)).astype(np.uint64)
    held = Cuckoo.empty()
    assert held.add(keys[:1000]) and held.add(keys[1000:])
    held = Cuckoo.read(held.write())
    assert held.contains(keys).all()
    other = rng.integers(0, 1 << 63, (50_000, 2)).astype(np.uint64)
    assert held.contains(other).mean() < 0.001
    held.remove(keys[:5000])
    assert held.contains(keys[5000:]).all() and held.contains(keys[:5000]).mean() < 0.01
    held.remove(keys[5000:])
    assert not held.table.any()
    assert not Cuckoo.empty(16).add(keys[:100])


def fold(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def brute_lines(indexed, docs):
    """By row number: (lines, dropped, text)."""
    owner, held = {}, {}
    rank = lambda i: (i is None, i)
    for i, t in indexed:
        for line in (t or "").split("\n"):
            if len(k := fold(line)) >= 10:
                held.setdefault(k, set()).add(i)
    for k, ids in held.items():
        if len(ids) > 1:
            owner[k] = min(ids, key=rank)
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if fold(x) not in owner or owner[fold(x)] == i]
        out.append((len(all_lines), len(all_lines) - len(kept), t if len(kept) == len(all_lines) else "\n".join(kept)))
    return out


DOCS = "doc_id bigint, text string, n_lines string, key int, row int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, n) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)


def deduped(index, spark, rows):
    got = sorted(index.dedupe(documents(spark, rows)).collect(), key=lambda r: r.row.row)
    assert [(r.row.doc_id, r.row.n_lines, r.row.key) for r in got] == [(i, "x", 1) for i, _ in rows]
    return [(r.n_lines, r.n_dropped, r.row.text) for r in got]


def corpus(rng, ids):
    pool = [f"Line number {i} of the POOL" for i in range(12)] + ["short", "ÄÖÜ äöü ß ÄÖÜ", "  line number 3 of the pool\t\r", "nine char", "ten  chars"]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in ids]


def new_index(spark, tmp):
    return LineIndex(spark, f"{tmp}/{uuid.uuid4().hex}")


def test_line_index_is_reversible(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    odd = [(None, None), (None, "Line number 1 of the POOL"), (50, ""), (51, "line number 2 OF the pool\n" * 3), (52, "only in this document, long\n\n"), (0, "line number 9 of the pool"), (53, "x" * 200_000 + "\nLINE number 9 of the pool")]
    a, b, c = corpus(rng, range(1, 20)) + odd, corpus(rng, range(20, 40)), corpus(rng, [*range(0, 3), *range(60, 70)])
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)  # several shards, which the second batch outgrows
    monkeypatch.setattr(lines, "PART_ROWS", 5)
    index = new_index(spark, tmp_path).insert(documents(spark, a))
    assert deduped(index, spark, a + c) == brute_lines(a, a + c)
    first = [(r.shard, r.live, r.repeated) for r in index.filters().orderBy("shard").collect()]
    index.insert(documents(spark, b + c))
    assert deduped(index, spark, a + b + c) == brute_lines(a + b + c, a + b + c)
    assert index.shards > 1
    index = LineIndex(spark, index.path)  # as another process finds it
    gone = [1, 2, 25, 51, 0, 12345, None]
    index.delete(spark.createDataFrame([(i,) for i in gone], "id bigint"))
    rest = [(i, t) for i, t in a + b + c if i not in gone]
    assert deduped(index, spark, a + b + c) == brute_lines(rest, a + b + c)
    index.insert(documents(spark, [x for x in a + b + c if x[0] in gone]))
    assert deduped(index, spark, a + b + c) == brute_lines(a + b + c, a + b + c)
    # taking all of the second batch back gives the first state, counts and owners alike
    index.delete(spark.createDataFrame([(i,) for i in sorted({i for i, _ in b + c})], "id bigint"))
    rest = [(i, t) for i, t in a if i not in {i for i, _ in b + c}]
    assert deduped(index, spark, a + b) == brute_lines(rest, a + b)
    fresh = new_index(spark, tmp_path).insert(documents(spark, rest))
    counts = lambda x: sorted((bytes(r.key), r.refs, r.owner) for r in x.refs().where("refs > 0").collect())
    assert counts(index) == counts(fresh)
    assert first


def test_line_index_of_nothing(spark, tmp_path):
    index = new_index(spark, tmp_path).insert(documents(spark, []))
    assert deduped(index, spark, []) == []
    assert deduped(index, spark, [(1, "a long line of one document\n" * 2), (2, None)]) == [(3, 0, "a long line of one document\n" * 2), (1, 0, None)]
    index.delete(spark.createDataFrame([(1,)], "id bigint"))
    assert index.refs().count() == 0


def test_uncommitted_generations_do_not_count(spark, tmp_path):
    rows = [(1, "one line of ten or more"), (2, "one line of ten or more")]
    index = new_index(spark, tmp_path).insert(documents(spark, rows))
    # a writer that was lost after its postings
    index._write(spark.createDataFrame([(b"0" * 16, 9)], "key binary, id bigint"), "postings", 2)
    again = LineIndex(spark, index.path)
    assert again.generations == [1] and deduped(again, spark, rows) == brute_lines(rows, rows)
    again.insert(documents(spark, [(3, "another line of its own")]))
    assert again.refs().count() == 2
