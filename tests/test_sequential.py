"""Operators that replace sequential loops, against these loops."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions.budget import Counter
from loomtext.operators import splits as st
from loomtext.operators import variants as va
from loomtext.operators import windows as wn

# ---------------------------------------------------------------- budgets


def pieces():
    """Words in pieces of three characters."""
    return lambda text: [w[i : i + 3] for w in text.split() for i in range(0, len(w), 3)]


def pairs():
    """Pairs of characters across words: no sum over words."""
    return lambda texts: [re.findall(r"..|.", t) for t in texts]


COUNTERS = {
    "sums": [Counter(), Counter(pieces, by_word=True, overhead=2), Counter(characters=4)],
    "texts": [Counter(pieces, by_word=True, lower=True), Counter(pairs, batch=True, overhead=1)],
}


def count(kind, tokens):
    text = " ".join(tokens)
    if kind == "sums":
        return max(len(tokens), len(pieces()(text)) + 2, -(-len(text) // 4))
    return max(len(pieces()(text.lower())), len(pairs()([text])[0]) + 1)


def looped(article, tokens, sents, start, kind, maxlen, final):
    """Grow by whole sentences and cut word by word, counting the text at every step."""
    k = next(i for i, (s, e) in enumerate(sents) if s <= start <= e)
    lo = hi = k
    left_open, right_open, lefts, step = k > 0, k < len(sents) - 1, 0, 0
    while left_open or right_open:
        step += 1
        head = hashlib.md5(f"0:coin:{article}:{start}:{step}".encode()).hexdigest()[0]
        go_left = left_open and (lefts < 2 or not right_open or head in "01234567")
        if go_left:
            if count(kind, tokens[sents[lo - 1][0] : sents[hi][1] + 1]) < maxlen:
                lo, lefts = lo - 1, lefts + 1
                left_open = lo > 0
            else:
                left_open = False
        elif count(kind, tokens[sents[lo][0] : sents[hi + 1][1] + 1]) < maxlen:
            hi += 1
            right_open = hi < len(sents) - 1
        else:
            right_open = False
    s, e = sents[lo][0], sents[hi][1]
    while s < e and count(kind, tokens[s : e + 1]) > final:
        if e - start > start - s:
            e -= 1
        else:
            s += 1
    return s, e


def articles(spark, rng, n=25):
    rows, spans = [], []
    for a in range(n):
        tokens = [rng.choice(["ab", "Abcdefgh", "a", "xyzzyx", "end.", "ÄÖÜäöüß", "K12", "B7b"]) for _ in range(rng.randrange(1, 90))]
        rows.append((a, tokens))
        spans += [(a, i, "STRA/digit", "STRA", 1, i + 1) for i, t in enumerate(tokens) if t in ("K12", "B7b")] or [(a, 0, "SPEC/name", "SPEC", 1, 1)]
    own = spark.createDataFrame([(a, t, ["O"] * len(t)) for a, t in rows], "article_id int, tokens array<string>, labels array<string>")
    return rows, own, spark.createDataFrame(spans, "article_id int, start int, source_key string, label4 string, length int, end_excl int")


@pytest.mark.parametrize("kind", COUNTERS)
def test_windows_equal_a_loop_that_counts_each_step(spark, kind):
    rows, own, spans = articles(spark, random.Random(5))
    bounds = {r.article_id: [(x.s, x.e) for x in r.b] for r in own.select("article_id", wn.sentences(F.col("tokens")).alias("b")).collect()}
    for maxlen, final in ((60, 40), (40, 60), (12, 5), (1000, 1)):
        got = wn.windows(own, spans, maxlen=maxlen, final=final, counters=COUNTERS[kind]).collect()
        tokens = dict(rows)
        want = {(r.article_id, r.seed_index): looped(r.article_id, tokens[r.article_id], bounds[r.article_id], r.seed_index, kind, maxlen, final) for r in got}
        assert {(r.article_id, r.seed_index): (r.s, r.e) for r in got} == want, (maxlen, final)
        assert len(got) == spans.count()
    index = wn.example_index(own, spans, maxlen=60, final=40, counters=COUNTERS[kind]).collect()
    assert all(count(kind, r.text.split()) <= 40 or r.s == r.e for r in index)


@pytest.mark.parametrize("kind", COUNTERS)
def test_variants_are_dropped_by_the_count_of_their_text(spark, kind):
    _, own, spans = articles(spark, random.Random(6), 8)
    index = wn.example_index(own, spans, maxlen=60, final=45, counters=COUNTERS[kind])
    known = spark.createDataFrame([], "example_id string, name string, ord int")
    pool = spark.createDataFrame([("Zeta ze",)], "name string")
    rows = va.materialise_variants(index, known, pool, seed=1, max_final=40, align=False, counters=COUNTERS[kind]).collect()
    kept, dropped = [r for r in rows if r.drop_reason is None], [r for r in rows if r.drop_reason]
    assert kept and dropped
    assert all(r.token_count == count(kind, r.text.split()) for r in kept)
    assert all(r.token_count <= 40 for r in kept if r.variant != "none")
    assert {r.drop_reason for r in dropped} <= {"switch_budget_or_error", "scramble_budget_exceeded"}


# ---------------------------------------------------------------- unique forms


@pytest.mark.parametrize("n, phrase", [(2500, lambda r: f"{r.choice('ab')}{r.randrange(90)}"), (300, lambda r: str(r.randrange(10))), (200, lambda r: f"K{r.randrange(10**6)}")])
def test_unique_outputs_equal_the_pass_in_id_order(spark, n, phrase):
    rng = random.Random(n)
    rows = [(f"e{i:05d}", sorted({phrase(rng) for _ in range(rng.randrange(3))})) for i in range(n)]
    d = spark.createDataFrame(rows, "example_id string, phrases array<string>")
    tries = 8
    forms = d.where(F.size("phrases") > 0).select("example_id", F.transform(va.attempts(F.col("example_id"), 3, tries=tries), lambda t: va.scrambled_pairs(F.col("phrases"), t)).alias("f"))
    forms = {r.example_id: [{p.src: p.dst for p in f} for f in r.f] for r in forms.collect()}
    taken, want = {p for _, each in rows for p in each} | {"K1"}, {}
    for i in sorted(forms):
        a = next((a for a, f in enumerate(forms[i]) if not taken & set(f.values())), None)
        want[i] = (a, forms[i][a] if a is not None else None)
        taken |= set(forms[i][a].values()) if a is not None else set()
    got: dict = {}
    for r in va.unique_outputs(d, 3, reserved=spark.createDataFrame([("K1",)], "phrase string"), tries=tries).collect():
        if r.reason:
            assert r.reason == va.EXHAUSTED and r.example_id not in got
            got[r.example_id] = (None, None)
        else:
            a, each = got.setdefault(r.example_id, (r.attempt, {}))
            assert a == r.attempt
            each[r.src] = r.dst
    assert got == want


# ---------------------------------------------------------------- repair


def naive_repair(members, cats, target):
    """Look at every article in every step."""
    split, trace = dict(members), []
    every = set().union(*cats.values()) if cats else set()
    sizes = {s: sum(x == s for x in split.values()) for s in set(split.values())}
    donors = sorted((s for s in sizes if s != target), key=lambda s: (s != "train", -sizes[s], s))
    while True:
        inside = [a for a, s in split.items() if s == target]
        held = [c for a in inside for c in cats.get(a, ())]
        missing = every - set(held)
        if not missing:
            return split, trace
        choice = min(((-len(cats.get(a, set()) & missing), donors.index(s), a) for a, s in split.items() if s != target and cats.get(a, set()) & missing), default=None)
        if choice is None:
            return split, [*trace, ("unresolved_missing", ",".join(sorted(missing)))]
        spare = min(((bool(cats.get(a)), -sum(held.count(c) - 1 for c in cats.get(a, ())), a) for a in inside if all(held.count(c) > 1 for c in cats.get(a, ()))), default=None)
        donor = split[choice[2]]
        split[choice[2]] = target
        if spare:
            split[spare[2]] = donor
        trace.append((choice, spare))


def test_repair_equals_a_look_at_every_article(spark):
    rng, lineages, rows, cats = random.Random(9), {}, [], []
    for lineage in range(12):
        names = "abcdefghij"[: rng.randrange(1, 11)]
        members = {f"{lineage}-{i:02d}": rng.choice(["train", "train", "eval", "dev", "test"]) for i in range(rng.randrange(1, 40))}
        own = {i: {c for c in names if rng.random() < rng.choice([0.05, 0.3])} for i in members}
        lineages[lineage] = members, own
        rows += [(lineage, i, s) for i, s in members.items()]
        cats += [(i, c) for i, each in own.items() for c in each]
        got, trace = st.repair(members, own, "test")
        want, plain = naive_repair(members, own, "test")
        assert got == want
        decided = [(t[1], t[2]) if t[1] == "unresolved_missing" else ((-t[5], t[4]), t[6]) for t in trace]
        assert decided == [t if t[0] == "unresolved_missing" else ((t[0][0], t[0][2]), t[1][2] if t[1] else None) for t in plain]
    assigned = spark.createDataFrame(rows, "lineage int, article_id string, split string")
    moved, _ = st.repair_coverage(assigned, spark.createDataFrame(cats, "article_id string, category string"), ["test", "dev"])
    want = {}
    for lineage, (members, own) in lineages.items():
        for target in ("test", "dev"):
            members = naive_repair(members, own, target)[0]
        want |= {(lineage, i): s for i, s in members.items()}
    assert {(r.lineage, r.id): r.split for r in moved.collect()} == want


def test_repair_is_linear():
    rng, took = random.Random(1), []
    for n in (50_000, 100_000):
        members = {f"{i:07d}": "train" if i % 10 else "test" for i in range(n)}
        cats = {a: ({f"c{rng.randrange(200)}", f"c{rng.randrange(200)}"} if s == "train" else {"c0"} if rng.random() < 0.5 else set()) for a, s in members.items()}
        began = time.perf_counter()
        split, trace = st.repair(members, cats, "test")
        took.append(time.perf_counter() - began)
        assert len(trace) >= 100 and sum(s == "test" for s in split.values()) == n // 10
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 10


# ---------------------------------------------------------------- bootstrap


def mixed(x):
    """The hash in plain integers."""
    m = 0xFFFFFFFF
    x = ((x ^ (x >> 16)) * 0x21F0AAAD) & m
    x = ((x ^ (x >> 15)) * 0x735A2D97) & m
    return x ^ (x >> 15)


def drawn(seed, key, n, replicate):
    head = hashlib.md5(f"{seed}:boot:{key}".encode()).hexdigest()
    a, b = int(head[:8], 16), int(head[8:16], 16)
    of = mixed((replicate + b) & 0xFFFFFFFF)
    return [(mixed((mixed((j + a) & 0xFFFFFFFF) + of) & 0xFFFFFFFF) * n) >> 32 for j in range(n)]


@pytest.mark.parametrize("block, work, slab", [(250_000, 20_000_000, 1 << 19), (7, 100, 16), (1, 10, 5)])
def test_resamples_equal_single_draws(spark, monkeypatch, block, work, slab):
    from loomtext.operators import bootstrap as bs

    for name, v in (("BLOCK", block), ("WORK", work), ("SLAB", slab)):
        monkeypatch.setattr(bs, name, v)
    rng = random.Random(3)
    rows = [(g, h, i, rng.randrange(1, 4), float(rng.randrange(100))) for g, h, n in (("a", "b", 40), (None, "a", 1), ("a", None, 23), ("c", "d", 2)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, h string, i int, times int, value double").repartition(5)
    sums = {(r.group, r.replicate): (r.n, r.value) for r in bs.resampled_sums(d, ("g", "h"), ["i"], ["value"], 9, 4, times="times").collect()}
    middles = {(r.group, r.replicate): (r.n, r.value) for r in bs.resampled_middles(d, ("g", "h"), ["i"], ["value"], 9, 4).collect()}
    groups = {(r.g, r.h): r.group for r in d.select("g", "h", bs._group(("g", "h")).alias("group")).distinct().collect()}
    assert len(groups) == 4 and len(sums) == len(middles) == 36
    for (g, h), group in groups.items():
        own = sorted(r[2:] for r in rows if r[:2] == (g, h))
        key = ":".join(x for x in (g, h) if x is not None)
        long = [v for _, t, v in own for _ in range(t)]
        for replicate in range(9):
            picked = drawn(4, key, len(long), replicate)
            assert sums[group, replicate] == (len(long), sum(long[p] for p in picked))
            places = sorted(drawn(4, key, len(own), replicate))
            low, high = (own[places[x]][2] for x in ((len(own) - 1) // 2, len(own) // 2))
            assert middles[group, replicate] == (len(own), (low + high) / 2)


def test_rows_are_copied_a_bounded_number_of_times_and_units_have_their_own_tasks(spark, monkeypatch):
    """Findings F1, F2 and F15: copies grew with rows times replicates, and small units of much work met in one task."""
    from loomtext.operators import bootstrap as bs

    monkeypatch.setattr(bs, "WORK", 100)
    monkeypatch.setattr(bs, "PORTION", 50)
    d = spark.range(400).select(F.col("id").alias("i"), (F.col("id") % 2).cast("string").alias("g"), F.lit(1.0).alias("value"))
    chunks = spark.createDataFrame([(10,), (10**9,)], "n bigint").select(bs._chunks(F.col("n"), 50_000).alias("c")).collect()
    assert all(x.c <= bs.CHUNKS for x in chunks)
    units = bs._dealt(spark.createDataFrame([(r, 8) for r in range(5)], "rank bigint, chunks int"), F.col("rank")).withColumn("p", F.spark_partition_id())
    assert units.count() == units.select("p").distinct().count() == 40
    sums = bs.resampled_sums(d, ("g",), ["i"], ["value"], 40, 1).collect()
    assert len(sums) == 80 and all(x.n == x.value == 200 for x in sums)


@pytest.mark.parametrize("n", [1, 2, 5, 4097, 100_001])
def test_middles_equal_sorted_draws(n, monkeypatch):
    from loomtext.operators import bootstrap as bs

    monkeypatch.setattr(bs, "TALLY", 40_000)
    draws = bs.Draws(1, "k", n)
    for r, got in enumerate(bs._middles(draws, 0, 3)):
        want = sorted(drawn(1, "k", n, r))
        assert draws.places(got).tolist() == [want[(n - 1) // 2], want[n // 2]]


@pytest.mark.parametrize("rows, plain", [(5, False), (40, False), (3000, True)])
def test_portions_add_up(rows, plain, monkeypatch):
    import numpy as np

    from loomtext.operators import bootstrap as bs

    monkeypatch.setattr(bs, "TALLY", 1000)
    monkeypatch.setattr(bs, "SLAB", 700)
    rng = np.random.default_rng(1)
    times = np.ones(rows, np.int64) if plain else rng.integers(1, 90, rows)
    data, n = rng.integers(0, 9, (2, rows)).astype(float), int(times.sum())
    got = sum(bs._sums(bs.Draws(1, "k", n), range(2, 6), int(times[:a].sum()), times[a:b], data[:, a:b]) for a, b in ((0, rows // 2), (rows // 2, rows)))
    row = np.repeat(np.arange(rows), times)
    for r in range(2, 6):
        assert got[r - 2].tolist() == data[:, row[drawn(1, "k", n, r)]].sum(1).tolist()


def test_few_equal_rows_of_many_draws_are_dealt(spark):
    """Finding F15: four rows with their numbers were one task, whatever the draws."""
    from loomtext.operators import bootstrap as bs

    n = spark.createDataFrame([(240_000,)], "n bigint").select(bs._chunks(F.col("n"), 50_000).alias("chunks"), F.lit(0).alias("rank"))
    units = bs._dealt(n, F.col("rank")).withColumn("p", F.spark_partition_id())
    assert units.select("p").distinct().count() == bs.CHUNKS


def test_replicates_have_the_size_of_the_sample_and_its_spread(spark):
    from loomtext.operators import metrics as me

    d = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") % 3 == 0).cast("int").alias("y_pred"), (F.col("id") % 7 / 10).alias("loss"))
    got = me.bootstrap_binary(d, 3000, 1)
    assert got.select("n").distinct().collect()[0].n == 1000 and got.count() == 3000
    point = me.binary_metrics(d).first()
    spread = got.agg(F.avg("precision").alias("p"), F.stddev("precision").alias("sp"), F.avg("loss").alias("l"), F.stddev("loss").alias("sl"), F.stddev("tp").alias("st")).first()
    assert spread.p == pytest.approx(point.precision, abs=0.003) and spread.sp == pytest.approx((0.5 * 0.5 / 334) ** 0.5, rel=0.1)
    assert spread.l == pytest.approx(point.loss, abs=0.001) and spread.sl == pytest.approx(0.2 / 1000**0.5, rel=0.1)
    assert spread.st == pytest.approx((1000 * 0.167 * 0.833) ** 0.5, rel=0.1)
    assert me.bootstrap_binary(d.limit(0), 5, 1).count() == 0


# ---------------------------------------------------------------- files and digests


def conll_examples(text):
    out, tokens = [], []
    for line in [*re.split(r"\r\n|\r|\n", text), ""]:
        if not line.strip(" \t\x0b\x0c"):
            if tokens:
                out.append(tokens)
            tokens = []
        elif " " in line:
            token, _, label = line.partition(" ")
            tokens = [*tokens, (token, label.strip(" "))]
    return out


@pytest.mark.parametrize("size", ["16", "97", "134217728"])
def test_conll_by_byte_ranges_equals_one_pass(spark, tmp_path, size):
    from loomtext.sources import conll

    rng, want = random.Random(int(size)), {}
    for f in range(8):
        text = "".join(rng.choice(["tok O\n", "Ä B-P extra \n", "nolabel\n", "\n", "\n", " \t\n", "x I-P\r\n", "\r\n", "w O\n" * 12]) for _ in range(f * 15)) + rng.choice(["", "end O", "\n\n"])
        (tmp_path / f"{f}.set").write_bytes(text.encode())
        want[f"{f}.set"] = conll_examples(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = conll.read_conll(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.path, r.idx)):
        each = got.setdefault(r.path.rsplit("/", 1)[1], [])
        assert r.idx == len(each)
        each.append(list(zip(r.tokens, r.labels, strict=True)))
    assert got == {f: e for f, e in want.items() if e}


def test_digests_are_streamed(spark):
    from loomtext.operators import claims

    rows = [("l1", "train", x) for x in ("b", "a", "a", None, "é")] + [("l1", "test", None), (None, "train", "z"), ("l2", None, "q")]
    got = {(r.lineage, r.split): (r.n, r.digest) for r in claims.split_digests(spark.createDataFrame(rows, "lineage string, split string, article_id string")).collect()}
    sha = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    assert got == {("l1", "train"): (5, sha("a", "b", "é")), ("l1", "test"): (1, sha("")), (None, "train"): (1, sha("z")), ("l2", None): (1, sha("q"))}
    many = spark.range(300_000).select(F.lit("l").alias("lineage"), F.lit("s").alias("split"), F.col("id").alias("article_id"))
    assert claims.split_digests(many).first().digest == sha(*sorted(str(i) for i in range(300_000)))
    files = spark.createDataFrame([("b", 2, "y"), ("a", 1, "x")], "path string, size bigint, sha256 string")
    assert tuple(claims.tree_digest(files).first()) == (2, 3, hashlib.sha256(b"a\t1\tx\nb\t2\ty\n").hexdigest())
    assert claims.tree_digest(files.limit(0)).first().digest == sha("")


# ---------------------------------------------------------------- overlaps and the cache


def test_overlaps_equal_all_pairs(spark, monkeypatch):
    from loomtext.operators import spans as sp

    monkeypatch.setattr(sp, "BIN", 5)
    rng = random.Random(2)
    windows = sorted({(rng.randrange(3), s, s + rng.randrange(30)) for s in (rng.randrange(60) for _ in range(60))})
    spans = [(rng.randrange(4), f"k{i}", s, s + rng.choice([0, 1, 2, 40])) for i, s in enumerate(rng.randrange(80) for _ in range(80))]
    w = spark.createDataFrame(windows, "article_id int, s int, e int")
    x = spark.createDataFrame(spans, "article_id int, source_key string, start int, end_excl int")
    got = sorted(tuple(r) for r in sp.overlapping(w, x).select("article_id", "s", "e", "source_key").collect())
    assert got == sorted((a, s, e, k) for a, s, e in windows for b, k, start, end in spans if a == b and end > s and start < e + 1)


def test_overlaps_of_one_large_article_are_linear(spark):
    from loomtext.operators import spans as sp

    n = 100_000
    w = spark.range(n).select(F.lit(1).alias("article_id"), (F.col("id") * 3).cast("int").alias("s"), (F.col("id") * 3 + 2).cast("int").alias("e"))
    x = spark.range(n).select(F.lit(1).alias("article_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 1).cast("int").alias("end_excl"))
    began = time.perf_counter()
    assert sp.overlapping(w, x).count() == n
    assert time.perf_counter() - began < 60


def test_prepared_tables_are_made_once(spark, tmp_path):
    from loomtext.sources.prepared import Cache, key_digest

    made = []

    def make(n=5):
        made.append(n)
        return spark.range(n).select("id", F.array(F.col("id").cast("int")).alias("a"))

    cache, key = Cache(spark, str(tmp_path)), {"b": 1, "a": ["x"]}
    assert cache.get(key) is None
    assert cache.prepare(key, make).count() == 5 and cache.prepare({"a": ["x"], "b": 1}, make).count() == 5 and made == [5]
    assert Cache(spark, str(tmp_path)).get(key).dtypes == make().dtypes
    # another key, an empty table
    assert cache.prepare(key | {"c": 2}, lambda: make(0)).count() == 0
    # a second writer of the same key that began before the first one's commit: one table stays, both read it
    folder = tmp_path / key_digest({"k": 1})

    def late():
        Cache(spark, str(tmp_path)).prepare({"k": 1}, make)
        return make(7)

    n = cache.prepare({"k": 1}, late).count()
    assert n in (5, 7) and len(list(folder.glob("commit-*.json"))) == 1 and cache.get({"k": 1}).count() == n
    # a writer that was lost, and data that lost a file
    (tmp_path / key_digest({"k": 2}) / "data-x").mkdir(parents=True)
    assert cache.get({"k": 2}) is None
    next(folder.glob("data-*/part-*.parquet")).unlink()
    assert cache.get({"k": 1}) is None and cache.prepare({"k": 1}, make).count() == 5
    cache.forget({"k": 1})
    assert cache.get({"k": 1}) is None


# ---------------------------------------------------------------- plug-ins and roots


def by_position(p, v, c):
    return {"metrics": {"range": (min(v), max(v)), "point": (p, p)}}


def test_custom_intervals_by_name_and_position(spark):
    from loomtext.operators import metrics as me

    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, value double")
    want = {("a", "range", 1.0, 3.0), ("a", "point", 2.0, 2.0), (None, "range", 5.0, 5.0), (None, "point", 5.0, 5.0)}
    assert {tuple(r) for r in me.custom_intervals(d, "tests.test_sequential:by_position", {}, "g").collect()} == want
    assert {tuple(r) for r in me.custom_intervals(d, lambda p, v, c: {"range": (min(v), max(v)), "point": (p, p)}, {}, "g").collect()} == want
    assert {tuple(r)[1:] for r in me.custom_intervals(d, lambda values, config, point: {"n": [len(values), config["x"]]}, {"x": 9}, "g").collect()} == {("n", 2.0, 9.0), ("n", 1.0, 9.0)}
    rows = spark.range(40).select(F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") % 3 == 0).cast("int").alias("y_pred"), F.lit(0.5).alias("loss"))
    out = me.evaluate_binary(rows, {"strategy": "custom", "n_bootstrap": 20, "custom_callable": "tests.test_sequential:by_position"}).collect()
    assert {(r.metric, r.method) for r in out} == {(m, x) for m in me.METRICS for x in ("range", "point")}
    with pytest.raises(ValueError):
        me.evaluate_binary(rows, {"strategy": "custom"})
    with pytest.raises(ValueError):
        me.load_callable("no_colon")
    with pytest.raises(ValueError):
        me._checked({"a": [1, 2, 3]}, "it")


def test_curated_roots_and_documents(spark, tmp_path, monkeypatch):
    from loomtext.sources import config, jsonl

    good, bad = tmp_path / "good", tmp_path / "bad"
    for name in config.ROOT_FOLDERS:
        (good / name).mkdir(parents=True)
    bad.mkdir()
    assert config.resolve_root(spark, {"curated_data_root": str(good)})[1] == {"source": "config", "key": "curated_data_root", "path": str(good)}
    monkeypatch.setenv("SOME_ROOT", str(good))
    assert config.resolve_root(spark, {}, variables=("OTHER_ROOT", "SOME_ROOT"), default=str(bad))[1]["env"] == "SOME_ROOT"
    assert config.resolve_root(spark, {}, default=str(good))[1]["source"] == "local"
    for settings, default in (({"curated_root": str(bad)}, str(good)), ({}, str(bad)), ({}, str(tmp_path / "none")), ({}, None)):
        with pytest.raises(ValueError):
            config.resolve_root(spark, settings, default=default)
    path = str(tmp_path / "d" / "x.json")
    jsonl.write_document(spark, {"b": [1, "é"], "a": None}, path)
    jsonl.write_document(spark, {"a": 2}, path)
    assert jsonl.read_document(spark, path) == {"a": 2} and [p.name for p in (tmp_path / "d").iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_scopes_of_threads_are_apart(spark):
    import threading

    from loomtext.shared import materialise, scratch

    inside, done, counts = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            df = materialise(spark.range(3), "mine")
            inside.set()
            done.wait(60)
            counts.append(df.count())

    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with scratch(spark) as keep:
        kept = keep(materialise(spark.range(5), "kept"))
        materialise(spark.range(7), "gone")
    done.set()
    t.join()
    assert counts == [3] and kept.count() == 5
