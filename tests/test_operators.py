"""Properties and files that the SQL comparison doesn't reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomtext import fixtures as fx
from loomtext.functions.text import CLASSES, SKIPPED
from loomtext.operators import claims
from loomtext.operators import lexicon as lx
from loomtext.operators import licences as lc
from loomtext.operators import metrics as me
from loomtext.operators import reports as rp
from loomtext.operators import sampling as sa
from loomtext.operators import splits as st
from loomtext.operators import variants as va
from loomtext.plans import commands
from loomtext.plans.augmentation import _bundle, _phrases
from loomtext.sources import config, conll, jsonl, runs

SF = "/root/testdata/sf0.001"


def test_scramble_keeps_classes_and_has_no_fixed_point(spark):
    rows = va.scramble(_phrases(spark, SF).where(F.size("phrases") > 0), 3, force_diff=True, id_col="doc_id")
    kind = {c: i for i, cs in enumerate(CLASSES) for c in cs if c not in SKIPPED}
    pairs = [(p.src, p.dst) for r in rows.select("pairs").collect() for p in r.pairs]
    assert pairs
    for src, dst in pairs:
        assert [kind.get(c, c) for c in src] == [kind.get(c, c) for c in dst]
        assert all(a != b for a, b in zip(src, dst, strict=True) if a in kind)


def test_variants_share_permutation_and_account_for_all(spark):
    rows = _bundle(spark, SF, max_final=58).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.example_id, {})[r.variant] = r
    assert by and all(set(v) == set(va.VARIANTS) for v in by.values())
    for v in by.values():
        kept = {k for k, r in v.items() if r.drop_reason is None}
        assert {"species", "strains", "all"} <= kept or not kept & {"species", "strains", "all"}
        for k in kept:
            assert len(v[k].text.split()) == len(v[k].labels)
        if "all" in kept:
            assert v["all"].phrases_scrambled == v["strains"].phrases_scrambled


def test_unique_outputs_collide_with_nothing(spark):
    p = spark.createDataFrame([(f"e{i}", [f"{c}{d}"]) for i, (c, d) in enumerate((c, d) for c in "bcdf" for d in "0123456789")], "example_id string, phrases array<string>")
    out = va.unique_outputs(p, 1).collect()
    made = [r.dst for r in out]
    assert len(made) == len(set(made)) and not set(made) & {r.src for r in out}


def test_unique_outputs_account_for_every_example(spark):
    # ten one-digit phrases reserve each other; twelve examples share nine free forms
    rows = [(f"d{i}", [str(i)]) for i in range(10)] + [(f"e{i:02d}", ["strain 1"]) for i in range(12)] + [("none", [])]
    out = va.unique_outputs(spark.createDataFrame(rows, "example_id string, phrases array<string>"), 2).collect()
    reason = {}
    for x in out:
        assert (x.reason is None) == (x.dst is not None) == (x.attempt is not None)
        assert x.example_id not in reason
        reason[x.example_id] = x.reason
    assert set(reason) == {i for i, _ in rows} - {"none"}
    assert all(reason[f"d{i}"] == "scramble_reserved_exhausted" for i in range(10))
    made = [x.dst for x in out if x.dst]
    # all free forms are found, some by later tries
    assert len(made) == len(set(made)) == 9 and max(x.attempt for x in out if x.dst) > 0


def test_unique_variants_have_reference_reasons(spark):
    labels = ["O", "O", "O"]
    index = spark.createDataFrame(
        [("e1", "Homo sapiens 7", labels, ["7"]), ("e2", "Homo sapiens K12b", labels, ["K12b"]), ("e3", "Homo sapiens ran", labels, []), *((f"x{i}", f"Homo sapiens {i}", labels, [str(i)]) for i in range(10))],
        "example_id string, text string, labels_raw array<string>, scramble_phrases array<string>",
    ).withColumns({"checksum": F.lit("c"), "s": F.lit(0), "e": F.lit(2), "triggers": F.lit(None).cast("string"), "entities": F.lit(None).cast("string")})
    known = spark.createDataFrame([(r.example_id, "Homo sapiens", 0) for r in index.collect()], "example_id string, name string, ord int")
    pool = spark.createDataFrame([("Felis catus",)], "name string")
    got = {(r.example_id, r.variant): r for r in va.materialise_variants(index, known, pool, seed=1, unique=True, align=False).collect()}
    assert got["e1", "all"].drop_reason == got["e1", "strains"].drop_reason == "scramble_reserved_exhausted" and got["e1", "all"].text is None
    assert got["e1", "species"].drop_reason is None and got["e3", "all"].text == "Felis catus ran"
    e2 = got["e2", "all"]
    assert e2.drop_reason is None and e2.text == f"Felis catus {e2.phrases_scrambled[0]}" and e2.phrases_scrambled[0] != "K12b"
    assert got["e2", "strains"].phrases_scrambled == e2.phrases_scrambled


def test_unknown_variant_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown variant"):
        _bundle(spark, SF, variants=("none", "odd"))


def test_forced_species_and_empty_pool(spark):
    index = spark.createDataFrame([("e1", "Homo sapiens ran", ["O", "O", "O"], []), ("e2", "Homo sapiens sat", ["O", "O", "O"], [])], "example_id string, text string, labels_raw array<string>, scramble_phrases array<string>")
    for name, kind in (("checksum", "string"), ("entities", "array<string>"), ("triggers", "array<string>")):
        index = index.withColumn(name, F.lit(None).cast(kind))
    index = index.withColumns({"s": F.lit(0), "e": F.lit(2)})
    lex = spark.createDataFrame([("Homo sapiens",), ("Pan paniscus",)], "name string")
    known = lx.known_mentions(index, lex, id_col="example_id")
    forced = spark.createDataFrame([("e1", "Canis lupus")], "example_id string, representative string")
    got = {(r.example_id, r.variant): r for r in va.materialise_variants(index, known, lex, seed=1, forced=forced).collect()}
    assert got["e1", "species"].text == "Canis lupus ran" and got["e1", "species"].species_forced_target == "Canis lupus"
    none = va.materialise_variants(index, known, lex.limit(0), seed=1).where("variant = 'all'").collect()
    assert {r.drop_reason for r in none} == {"switch_pool_empty"}


def test_split_specs_and_apportionment():
    with pytest.raises(ValueError):
        st.split_specs({"splits": {"a": {"fraction": 0.5}, "b": {"fraction": 0.4}}})
    with pytest.raises(ValueError):
        st.split_specs({"splits": {"a": {"fraction": 1.0, "coverage": {"min_articles_per_category": 2}}}})
    specs = st.split_specs({"train_fraction": 0.5})
    assert st.apportion(3, specs) == {"train": 2, "test": 1}


def test_licence_policy_fails_when_asked(spark):
    licensed = spark.createDataFrame([("a", "ALL-RIGHTS-RESERVED")], "article_id string, license_id string")
    with pytest.raises(Exception, match="licence policy rejects a"):
        lc.filter_by_license(licensed, {"mode": "fail"}).collect()
    warned = lc.filter_by_license(licensed, {"mode": "warn"}).first()
    assert warned.kept and warned.would_exclude
    with pytest.raises(ValueError):
        lc.policy_of({"mode": "odd"})


def test_conll_round_trip(spark, tmp_path):
    ex = spark.createDataFrame([("a", ["x", "y"], ["O", "B-P"]), ("b", ["z"], ["O"]), ("c", [], [])], "example_id string, tokens array<string>, labels array<string>")
    conll.write_conll(ex.coalesce(1), str(tmp_path / "out"))
    back = [(r.tokens, r.labels) for r in conll.read_conll(spark, str(tmp_path / "out")).orderBy("path", "idx").collect()]
    assert sorted(back) == [(["x", "y"], ["O", "B-P"]), (["z"], ["O"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.set").write_text("a O\nnolabel\nb B-P extra\n \n\n\nc O")
    back = [(r.idx, r.tokens, r.labels) for r in conll.read_conll(spark, str(tmp_path / "in")).collect()]
    assert back == [(0, ["a", "b"], ["O", "B-P extra"]), (1, ["c"], ["O"])]
    bad = spark.createDataFrame([("a", ["x"], [])], "example_id string, tokens array<string>, labels array<string>")
    with pytest.raises(Exception, match="differ in length"):
        bad.select(conll.conll_text(F.col("tokens"), F.col("labels"))).collect()


def test_examples_with_metadata(spark, tmp_path):
    d = tmp_path / "t1" / "set1" / "train"
    d.mkdir(parents=True)
    (d / "all.set").write_text("a O\n\nb B-P\n")
    (d / "all.meta.jsonl").write_text('{"example_id": "e1", "category": "relevant"}\n\n{"example_id": "e2"}\n')
    (d / "none.set").write_text("c O\n")
    got = {r.example_id: r for r in jsonl.with_metadata(spark, str(tmp_path)).collect()}
    assert set(got) == {"e1", "e2", "ex_00000000"} and got["e1"].category == "relevant" and got["e1"].tokens == ["a"]
    found = {(r.task, r["set"], r.split, r.variant) for r in jsonl.discover_sets(spark, str(tmp_path), variants=("all",)).collect()}
    assert found == {("t1", "set1", "train", "all")}
    assert jsonl.file_digests(spark, str(tmp_path)).count() == 3
    (d / "none.meta.jsonl").write_text("{}\n{}\n")
    with pytest.raises(Exception, match="differ in number"):
        jsonl.with_metadata(spark, str(tmp_path)).collect()


def test_jsonl_sorted_keys(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", 1)], "z string, a int")
    jsonl.write_jsonl(rows, str(tmp_path / "j"), order_by="z")
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"a":1,"z":"a"}', '{"a":null,"z":"b"}']
    assert jsonl.read_jsonl(spark, str(tmp_path / "j")).count() == 2
    assert jsonl.stable_rows(rows.withColumn("example_id", F.lit("x"))).columns == list(jsonl.STABLE)


def test_run_metrics(spark, tmp_path):
    d = tmp_path / "runs" / "m" / "set1" / "seed_1" / "all"
    d.mkdir(parents=True)
    point = {"precision": 0.5, "recall": 0.5, "f1": 0.5, "loss": 1.0}
    doc = {"task": "t", "set": "set1", "seed": 1, "model_id": "m", "train_variant": "all", "metrics": {"u": {**point, "per_epoch": [{"epoch": 1, **point}, {"epoch": 2.0, **point, "f1": 0.7}, {"epoch": 2, **point, "f1": 0.8}]}, "bad": {"f1": None}}}
    (d / "metrics.json").write_text(json.dumps(doc))
    final = runs.read_metrics(spark, str(tmp_path)).collect()
    assert [(r.eval_set, r.epoch, r.effective_epoch, r.eval_split) for r in final] == [("u", "final", 2, "test")]
    assert runs.read_metrics(spark, str(tmp_path), "all").count() == 3
    assert [r.f1 for r in runs.read_metrics(spark, str(tmp_path), 2).collect()] == [0.8]
    runs.write_csv(runs.read_metrics(spark, str(tmp_path)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().f1 == "50.0"
    assert runs.table_text(runs.read_metrics(spark, str(tmp_path)), ["task", "f1"]).first().line.split() == ["t", "0.5000"]


def test_stream_equals_batch(spark, tmp_path):
    from loomtext.streaming import scrambled_stream

    rows = _phrases(spark, SF).where(F.size("phrases") > 0).select(F.col("doc_id").cast("string").alias("example_id"), "text", "phrases")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scrambled_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5)
    q = stream.select("example_id", "scrambled").writeStream.format("memory").queryName("scrambled_rows").start()
    q.processAllAvailable()
    q.stop()
    got = {r.example_id: r.scrambled for r in spark.table("scrambled_rows").collect()}
    want = {r.example_id: r.scrambled for r in va.scramble(rows, 5).collect()}
    assert got == want and got


def test_ranks_are_dense(spark):
    d = fx.table(spark, SF, "documents").select("doc_id")
    got = [(r.doc_id, r["rank"]) for r in lx._ranked(d, "doc_id").orderBy("doc_id").collect()]
    assert [r for _, r in got] == list(range(len(got)))


def test_ranks_are_dense_at_volume(spark):
    n, old = 600_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        wide = spark.range(n, numPartitions=24).select(F.col("id").cast("string").alias("example_id"), F.lit("irrelevant").alias("category"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide"))
        got = lx._ranked(wide.withColumn("h", F.md5("wide")), "h", "example_id").agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.count_distinct("wide")).first()
        assert tuple(got) == (n, n, 0, n - 1, n)
        assert sa.ablation_mix(wide, 43, 7).count() == int(n * (1 - 43 / 100))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_config_documents_and_rules(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"qa": {"rules": [{"pattern": "a*"}]}}')
    assert config.load_config(spark, str(tmp_path / "c.json"))["qa"]["rules"][0]["pattern"] == "a*"
    rows = config.qa_rules(spark, [{"pattern": "x", "max_tokens": 3, "require_categories": "a, b,"}, {"name": "n", "pattern": "y"}]).collect()
    assert [(r.name, r.max_tokens, r.require_categories) for r in rows] == [("rule_1", 3, ["a", "b"]), ("n", None, [])]
    for bad in ({}, {"rules": 3}, [1], [{"name": "no pattern"}]):
        with pytest.raises(ValueError):
            config.qa_rules(spark, bad)


def test_interval_csv_and_binary_evaluation(spark, tmp_path):
    rows = fx.run_metrics(spark, SF)
    out = rp.report_intervals(rows, point="median", n_bootstrap=20)
    assert out.where("percentile_lo > percentile_hi or n_runs <= 0").count() == 0
    runs.write_interval_csv(out, str(tmp_path / "csv"), rp.GROUP)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == out.select(*rp.GROUP).distinct().count() and "f1_basic_hi" in back.columns
    pairs = fx.classified_pairs(spark, SF)
    for cfg, n in (({"strategy": "clt"}, 4), ({"n_bootstrap": 30, "methods": ("percentile", "basic")}, 8)):
        got = me.evaluate_binary(pairs, cfg).collect()
        assert len(got) == n and all(r.lo <= r.hi for r in got)
    got = me.evaluate_binary(pairs, {"strategy": "custom", "n_bootstrap": 10}, lambda point, values, config: {"all": [min(values), max(values)]}).collect()
    assert {(r.metric, r.method) for r in got} == {(m, "all") for m in me.METRICS}
    with pytest.raises(ValueError):
        me.evaluate_binary(pairs, {"strategy": "none"})


def test_stable_rows_as_arrow_and_claims_of_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("b", ["x"]), ("a", ["y", "z"])], "example_id string, tokens array<string>")
    assert jsonl.to_arrow(rows).column("example_id").to_pylist() == ["a", "b"]
    lineage = tmp_path / "t1" / "set1"
    lineage.mkdir(parents=True)
    (lineage / "splits.json").write_text(json.dumps({"train_checksums": ["a1", "b1"], "test_checksums": ["c1"]}))
    digest = claims.split_digests(spark.createDataFrame([("l", "s", x) for x in ("a1", "b1")], "lineage string, split string, article_id string")).first().digest
    (lineage / "manifest.json").write_text(json.dumps({"splits": {"train_checksums_sha256": digest, "test_checksums_sha256": "other"}}))
    found = commands.verify_root(spark, str(tmp_path), tasks=("t1",)).collect()
    assert [(r.profile, r.task, r.check, r.context) for r in found] == [("flat", "t1", "split_hash", "set1/test")]
    assert commands.claims_summary(commands.verify_root(spark, str(tmp_path), tasks=("t1",))).where("profile is null").first().n == 1


def test_repair_by_lineage_equals_the_whole_loop(spark):
    import random

    rng, rows, cats, want, trace = random.Random(3), [], [], {}, {}
    for lineage in range(8):
        members = {f"{lineage}-{i}": rng.choice(["train"] * 5 + ["eval"] * 2 + ["test"] * (1 + lineage % 3)) for i in range(30)}
        own = {i: {c for c in "abcdefgh" if rng.random() < (0.9 if lineage == 7 else 0.12)} for i in members}
        rows += [(lineage, i, s) for i, s in members.items()]
        cats += [(i, c) for i, each in own.items() for c in each]
        want[lineage], trace[lineage] = st.repair(members, own, "test")
    assigned = spark.createDataFrame(rows, "lineage int, article_id string, split string")
    moved, decided = st.repair_coverage(assigned, spark.createDataFrame(cats, "article_id string, category string"), ["test"])
    assert {(r.lineage, r.id): r.split for r in moved.collect()} == {(k, i): s for k, each in want.items() for i, s in each.items()}
    assert {(r.lineage, r.step, r.action, r.donor, r.swapped_out) for r in decided.collect()} == {(k, t[0], t[1], t[4], t[6]) for k, each in trace.items() for t in each}
    assert any(trace.values()) and not all(trace.values())
