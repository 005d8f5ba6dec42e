"""Cases that a review found."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def same_as_sql(spark, name, folder, *tables):
    """Rows of a query, which must be those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    rows = entry.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in rows.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in rows.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


@pytest.fixture(scope="module")
def abbreviated(spark, tmp_path_factory):
    """Documents whose lexicon has abbreviated names."""
    folder = tmp_path_factory.mktemp("abbreviated")
    texts = ["so A. idiot and Abc idiot", "so G. lone here", "Gab lone A. idiot"] * 6
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["lexicon_key_index", "pool_modes", "pool_restricted", "sampled_names"])
def test_abbreviated_names_of_the_lexicon(spark, abbreviated, name):
    """Findings F5 and F6: a name like ``A. idiot`` that occurs five times."""
    assert "A. idiot" in str(same_as_sql(spark, name, abbreviated, "documents")) or name in ("pool_restricted", "sampled_names")


def test_run_files_has_every_run(spark, tmp_path):
    """Finding F7: each row of the table is a run, not only the last one of a group."""
    spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.rand(1).alias("value"), F.lit("").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    assert len(same_as_sql(spark, "run_files", tmp_path, "events")) == 40


def test_variants_write_no_text_twice(spark, monkeypatch):
    """Findings F3, F4, F9 and F10: all texts and counts of an example were written up to three times."""
    from loomtext.operators import variants as va
    from loomtext.plans import augmentation

    written = []
    plain = va.materialise
    monkeypatch.setattr(va, "materialise", lambda df, purpose: written.append(purpose) or plain(df, purpose))
    assert augmentation.variant_stats(spark, "/root/testdata/sf0.001").count() > 0
    assert not written


def test_window_steps_do_not_grow_with_the_article():
    """Findings F11, F14, F18 and F20: a seed looked at every sentence of its article."""
    from loomtext.operators.windows import _placed

    asked = []

    def size(s, e):
        asked.append((s, e))
        return e - s + 1

    s, e = _placed(50_000, list(range(4, 100_000, 5)), size, "k", 60, 40, 0)
    assert e - s + 1 == 40 and len(asked) < 40


def test_labels_shuffle_no_tokens(spark):
    """Findings F12, F16 and F17: tokens went through a shuffle to be looked up one by one in a map of the labelled ones."""
    from loomtext.operators.spans import bio_labels

    n = 300
    tokens = spark.range(3).select(F.col("id").alias("article_id"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("tokens"))
    rows = [(a, k, "k", "ABCD"[k % 4], (k * 7 + a) % (n - 5), 1 + k % 5, 0) for a in (0, 2) for k in range(200)]
    out = bio_labels(tokens, spark.createDataFrame(rows, "article_id bigint, ord int, source_key string, label4 string, start int, length int, end_excl int"))
    want = {a: ["O"] * n for a in range(3)}
    for a, _, _, label, start, length, _ in rows:
        for at in range(start, start + length):
            want[a][at] = f"{'B' if at == start else 'I'}-{label}"
    assert {r.article_id: r.labels for r in out.collect()} == want
    plan = out.select("article_id", "labels")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert "_n#" in joined and "tokens#" not in joined.split("_n#")[0].split("Project")[-1].replace("size(tokens#", "")


def test_overlaps_read_the_texts_for_spans_once(spark):
    """Finding F16: spans were found anew, and tokens shuffled, for each of the three mappings."""
    from loomtext.plans import audits

    plan = audits.bio_labels_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "mapInArrow" not in plan.replace("MapInArrow", "mapInArrow")


def test_parameters_are_sorted_after_the_shuffle_only(spark):
    """Finding F13: each task sorted its whole input split, and jobs met the defaults in a cross join."""
    from loomtext.operators.matrix import resolve_hparams

    jobs = spark.createDataFrame([(1,), (2,), (None,), (1,)], "job_id bigint")
    level = lambda *rows: spark.createDataFrame(list(rows), "job_id bigint, name string, value string")
    out = resolve_hparams(jobs, [level((1, "lr", "a")), level((1, "lr", "b"), (2, "more", "c"), (9, "lr", "d"))], {"lr": "x", "n": "y"})
    assert {tuple(r) for r in out.collect()} == {(1, "lr", "a"), (1, "n", "y"), (2, "lr", "x"), (2, "n", "y"), (2, "more", "c"), (9, "lr", "d"), (None, "lr", "x"), (None, "n", "y")}
    assert out.count() == 8 and not resolve_hparams(jobs, [], {}).count()
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange") and "Cartesian" not in plan and "NestedLoop" not in plan


def test_middles_finish_only_draws_near_the_middle(monkeypatch):
    """Finding F2: the middle of a resample took all steps of the hash, and a masked copy, for every draw."""
    import numpy as np

    from loomtext.operators import bootstrap as bs

    finished = []
    plain = bs.finish
    for n in (5001, 70_000):
        draws = bs.Draws(3, "g", n)
        want = np.array([np.sort(np.concatenate([x.ravel().copy() for _, x in draws.numbers(r, r + 1, 0, n)]))[[(n - 1) // 2, n // 2]] for r in range(7)])
        monkeypatch.setattr(bs, "finish", lambda x, spare: finished.append(x.size) or plain(x, spare))
        draws._own(0, n)
        finished.clear()
        assert (bs._middles(draws, 0, 7) == want).all() and sum(finished) < 7 * n / 4
        # a band that misses the middle is widened
        assert [len(near) for _, near in bs._around(draws, 0, 2, 1.0)] == [n, n]
        monkeypatch.setattr(bs, "finish", plain)


def test_spans_come_from_one_pass_over_the_texts(spark, tmp_path):
    """Findings F12, F14, F18 and F20: texts were read three times for spans: for mentions, for pairs of tokens and for digits."""
    from loomtext import fixtures as fx

    texts = ["xAb cd Ab cd,", "Ab\ncd  Ab cd\t9 A. cd", None, "", "Ab\x0bcd É1 Ab cd", "Ab cdé Ab cd Abc d9", "Ab cd"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans = fx.spans(spark, str(tmp_path))
    assert "MapInArrow" not in spans._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.article_id, r.label4, r.start, r.end_excl) for r in spans.collect()}
    # names are counted with a plain space only, pairs may have any
    assert got == {(1, "SPEC", 0, 2), (1, "SPEC", 2, 4), (4, "SPEC", 0, 2), (4, "SPEC", 3, 5), (5, "SPEC", 2, 4), (6, "SPEC", 0, 2), (1, "STRA", 4, 5), (4, "STRA", 2, 3), (5, "STRA", 5, 6)}



def test_windows_by_characters_send_no_tokens_to_python(spark):
    """Findings F4 and F8: Python took all tokens of an article to count their characters."""
    from loomtext.functions.budget import Counter, summed, word_counts
    from loomtext.operators import windows as wn

    rows = [(1, ["one", "Zwölf,", "two."]), (2, []), (3, ["a b", "", " ", "c"]), (4, None)]
    t = spark.createDataFrame(rows, "article_id bigint, tokens array<string>")
    for counter, want in ((Counter(), [[0, 1, 2, 3], [0], [0, 2, 2, 2, 3], [0]]), (Counter(characters=4), [[0, 4, 11, 16], [0], [0, 4, 5, 7, 9], [0]])):
        counts = t.orderBy("article_id").select(word_counts(F.col("tokens"), counter).alias("n")).toArrow().column(0).combine_chunks()
        assert [x.tolist() for x in summed(counts)] == want
    spans = spark.createDataFrame([(1, 0, "k", "STRA", 1, 1, 2)], "article_id bigint, ord int, source_key string, label4 string, start int, length int, end_excl int")
    plan = wn.windows(t, spans, maxlen=9, final=5, counters=[Counter(), Counter(characters=4)])._jdf.queryExecution().optimizedPlan().toString()
    assert "_count0" in plan and "_count1" in plan


def test_phrases_are_put_together_once_an_article(spark):
    """Finding F14: tokens were copied for each span to make its phrase, in a join of their own, and windows were placed twice, for entities and for texts."""
    from loomtext.operators import windows as wn

    labelled = spark.createDataFrame([(1, ["a1", "b", "a1", "c22."], ["B-STRA", "O", "B-STRA", "B-STRA"]), (2, ["x."], ["O"])], "article_id bigint, tokens array<string>, labels array<string>")
    rows = [(1, k, "k", code, at, n, at + n) for k, (at, n, code) in enumerate([(0, 1, "STRA"), (2, 1, "STRA"), (3, 1, "STRA"), (0, 2, "SPEC")])]
    rows.append((2, 0, "k", "SPEC", 0, 1, 1))
    spans = spark.createDataFrame(rows, "article_id bigint, ord int, source_key string, label4 string, start int, length int, end_excl int")
    out = wn.example_index(labelled, spans, maxlen=9, final=9)
    assert {(r.checksum, tuple(r.scramble_phrases)) for r in out.collect()} == {("1", ("c22.", "a1")), ("2", ())}
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(array_join" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 10_000])
def test_conll_ranges_are_read_once(spark, tmp_path, monkeypatch, few):
    """Finding F12: Python read each range three times, line by line, and all pieces were shuffled by range to be numbered."""
    from loomtext.sources import conll

    monkeypatch.setattr(conll, "_FEW", few)
    monkeypatch.setattr(conll, "_PART", 3)
    texts = {"a.set": "".join(f"t{i} O\n x{i} B-P q \n" + "\n" * (i % 3) for i in range(400)), "b.set": "lone O", "c.set": "\n\nno\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        back = conll.read_conll(spark, str(tmp_path))
        plan = back._jdf.queryExecution().optimizedPlan().toString()
        rows = back.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "MapInArrow" not in plan and "Window" not in plan
    want = {("b.set", 0): (["lone"], ["O"])}
    for n, block in enumerate(x for x in texts["a.set"].split("\n\n") if x.strip()):
        cells = [line.split(" ", 1) for line in block.strip("\n").split("\n")]
        want["a.set", n] = ([t for t, _ in cells], [x.strip(" ") for _, x in cells])
    assert {(r.path.rsplit("/", 1)[1], r.idx): (r.tokens, r.labels) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("few", [0, 10_000])
def test_lines_of_a_range_are_numbered_without_meeting(spark, tmp_path, monkeypatch, few):
    """Finding F19: all lines of a byte range went to one task to be numbered."""
    from loomtext.sources import jsonl

    monkeypatch.setattr(jsonl, "_FEW", few)
    monkeypatch.setattr(jsonl, "_PART", 7)
    for k in range(2):
        (tmp_path / f"{k}.meta.jsonl").write_text("".join(f'{{"i": {i}}}\n' + "  \n" * (i % 3 == 0) for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = jsonl.numbered_lines(spark, str(tmp_path), "*.meta.jsonl")
        got = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 600 and all(r.value == f'{{"i": {r.idx}}}' for r in got)
    # the windows are over sizes of ranges
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_rows_of_a_set_do_not_meet_to_learn_of_its_metadata(spark, tmp_path):
    """Finding F19: examples were joined by the name of their set alone, so each set went to one task."""
    from loomtext.sources import jsonl

    d = tmp_path / "t1" / "set1" / "train"
    d.mkdir(parents=True)
    (d / "all.set").write_text("".join(f"t{i} O\n\n" for i in range(50)))
    (d / "all.meta.jsonl").write_text("".join(f'{{"example_id": "e{i}"}}\n' for i in range(50)))
    (d / "none.set").write_text("c O\n")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = jsonl.with_metadata(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = {(r.example_id, r.tokens[0]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {(f"e{i}", f"t{i}") for i in range(50)} | {("ex_00000000", "c")}
    assert "BroadcastHashJoin [stem" in plan and "SortMergeJoin [stem" in plan and plan.count("SortMergeJoin [stem") == 1


def test_sums_of_a_large_group_are_cut_before_they_are_counted(monkeypatch):
    """Finding F2 of round 4: each replicate of a large group counted at random over all its rows, and groups beyond 2 M rows drew twice."""
    import numpy as np

    from loomtext.operators import bootstrap as bs

    assert bs.PORTION >= 2_400_000
    n = 5000
    run = np.sort(np.random.default_rng(1).integers(0, 90, n))
    data = np.stack([run / 7, np.random.default_rng(2).random(n), run % 13 / 3])
    draws, want = bs.Draws(7, "k", n), []
    for r in range(3, 7):
        at = np.concatenate([draws.places(x)[0] for _, x in draws.numbers(r, r + 1, 0, n)])
        want.append(data[:, at].sum(axis=1))
    parts = []
    monkeypatch.setattr(bs, "NEAR", 300)
    plain = bs._parts
    monkeypatch.setattr(bs, "_parts", lambda x: parts.append(len(x)) or plain(x))
    assert np.allclose(bs._sums(draws, range(3, 7), 0, np.ones(n, np.int64), data), want, rtol=1e-12, atol=0)
    assert parts == [n] * 4


def test_window_mentions_are_those_of_their_texts(spark):
    """Findings F1, F3 and F4 of round 4: texts of examples were written, and shuffled again, to meet the names in them."""
    from loomtext.operators import lexicon as lx

    text = "x(Abc de-f\tAb cdE. coli G. h,  aA.  bX Yz k Yz kL mn Ab. cd É. coli Qa é Qa eÉ Zb c Zb c\n"
    tokens = [t for t in re.split(r"[ \t\n\x0b\f\r]+", text) if t]
    docs = spark.createDataFrame([(1, text), (2, None), (3, " Ab cd"), (4, "Ab")], "article_id bigint, text string")
    windows = [(1, s, e) for s in range(len(tokens)) for e in range(s, len(tokens))] + [(3, 0, 1), (3, 0, 0), (4, 0, 0)]
    grouped = spark.createDataFrame(windows, "article_id bigint, s int, e int").select(F.concat_ws(":", "article_id", "s", "e").alias("example_id"), "*")
    own = {1: tokens, 3: ["Ab", "cd"], 4: ["Ab"]}
    texts = spark.createDataFrame([(f"{a}:{s}:{e}", " ".join(own[a][s : e + 1])) for a, s, e in windows], "example_id string, text string")
    found = lx.mentions_at(docs)
    lexicon = found.select("name").distinct().where("name <> 'Yz k'")
    listed = lambda rows: [(r.example_id, r.name) for r in sorted(rows.collect(), key=lambda r: (r.example_id, r.ord))]
    got = listed(lx.window_mentions(grouped, found, lexicon))
    assert len(set(got)) > 30 and got == listed(lx.known_mentions(texts, lexicon, id_col="example_id"))


def test_variant_bundle_writes_no_texts(spark, monkeypatch):
    """Findings F1, F3 and F4 of round 4: all examples were written with their texts and labels."""
    from loomtext import shared
    from loomtext.plans import augmentation

    written = []
    plain = shared.materialise

    def noted(df, purpose):
        written.append((purpose, df.columns))
        return plain(df, purpose)

    for module in ("fixtures", "operators.lexicon", "operators.variants", "operators.windows", "plans.annotation", "plans.augmentation"):
        monkeypatch.setattr(f"loomtext.{module}.materialise", noted)
    assert augmentation.variant_bundle_tight(spark, "/root/testdata/sf0.001").count() > 0
    assert written and not [p for p, columns in written if {"text", "labels_raw", "tokens"} & set(columns)]


def test_texts_of_variants_are_dealt_over_tasks(spark):
    """Finding F4 of round 4: windows are few bytes, so all of their texts were made by a few tasks."""
    from loomtext.plans import augmentation

    assert augmentation.variant_bundle_counted(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
