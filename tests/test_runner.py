from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomtext import fixtures as fx
from loomtext.functions.budget import Counter, token_count
from loomtext.operators.variants import augment_articles
from loomtext.plans import commands, runner

POINT = {"precision": 0.5, "recall": 0.5, "f1": 0.5, "loss": 1.0}
SF = "/root/testdata/sf0.001"


def job(seed, variant="all"):
    return {"task": "t", "set": "set1", "model": "m", "seed": seed, "train_variant": variant, "eval_split": "test", "eval_sets": ["u"]}


def test_matrix_resumes_archives_and_fails(tmp_path):
    calls = []
    backend = lambda j: calls.append(j["seed"]) or {"u": POINT}
    jobs = [job(1), job(2)]
    assert [r["status"] for r in runner.run_matrix(jobs, backend, tmp_path)] == ["completed"] * 2
    assert [r["status"] for r in runner.run_matrix(jobs, backend, tmp_path)] == ["skipped"] * 2 and calls == [1, 2]
    runner.run_matrix(jobs[:1], backend, tmp_path, extra={"v": 2})
    folder = runner.run_dir(tmp_path, jobs[0])
    assert (folder / "attempts" / "001-rerun" / "metrics.json").exists() and (folder / "STATUS_completed").exists()
    with pytest.raises(ValueError, match="no metrics for u"):
        runner.run_matrix([job(3)], lambda j: {}, tmp_path)
    assert (runner.run_dir(tmp_path, job(3)) / "STATUS_failed").exists()
    assert runner.profile_ids([{"name": "A b"}, {"name": "a-B"}, {}]) == ["a-b", "a-b-2", "model"]
    assert runner.with_epochs({"training": {"models": [{"name": "m"}]}}, {"m": 3})["training"]["models"][0]["hparams"] == {"epochs": 3}


def test_commands_over_runs_and_sets(spark, tmp_path):
    runner.run_matrix([job(s, v) for s in (1, 2, 3) for v in ("all", "none")], lambda j: {"u": {**POINT, "f1": j["seed"] / 10, "per_epoch": [{"epoch": 1, **POINT}]}}, tmp_path)
    got = commands.report(spark, str(tmp_path), point="median", train_variant=["all"], since="2000-01-01").collect()
    assert [(r.train_variant, r.n_runs, round(r.f1, 6)) for r in got] == [("all", 3, 0.2)]
    assert commands.calibrate(spark, str(tmp_path), objective="unaugmented_f1").count() == 0
    for name, text in (("a", "x O\n\ny B-P\nz I-P\n"), ("b", "x O\n\ny B-Q\nz I-Q\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.set").write_text(text)
        (tmp_path / name / "s.meta.jsonl").write_text('{"example_id":"1","types_raw":[]}\n{"example_id":"2","types_raw":["P"]}\n')
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert [(r.example_id, r.changed_labels) for r in commands.inspect(spark, a, b, changed_only=True).collect()] == [("2", True)]
    assert {(r.group_key, r.shown) for r in commands.sample(spark, a, 1, 0).collect()} == {("O-only", "x"), ("P", "y (B-P) z (I-P)")}
    assert commands.validate(spark, a, max_tokens=2, required_raw_types=("P",)).count() == 0
    assert {r.label for r in commands.stats(spark, a).collect()} == {"O", "B-P", "I-P"}
    rules = spark.createDataFrame([(0, "any", "*")], "ord int, name string, pattern string")
    assert commands.qa(spark, a, rules).first().rule == "any"


def test_token_budget(spark):
    d = spark.createDataFrame([("Ab cd",), (None,)], "t string")
    counters = [Counter(), Counter(load=lambda: list, lower=True, overhead=2)]
    assert [r[0] for r in d.select(token_count(F.col("t"), counters)).collect()] == [7, 2]
    assert [r[0] for r in d.select(token_count(F.col("t"))).collect()] == [2, 0]


def test_articles_are_augmented(spark):
    d = fx.labelled(spark, SF).where("article_id < 40")
    rows = augment_articles(d, fx.spans(spark, SF).where("article_id < 40"), fx.lexicon(spark, SF), seed=1, maxlen=50, max_final=60).collect()
    assert rows and {r.variant for r in rows} == {"none", "species", "strains", "all"}
    assert all(len(r.text.split()) == len(r.labels) for r in rows)


def test_roots_manifests_and_provenance(spark, tmp_path):
    has = lambda *roots: lambda root, job: root in roots
    profiles = {"p1": "/p1", "p2": "/p2", "p3": "/p3"}
    assert runner.source_root("/a", profiles, {"profile_id": "p2"}, has("/p2", "/p3")) == "/p2"
    assert runner.source_root("/a", profiles, {"profile_id": "p2"}, has("/p3")) == "/p3"
    with pytest.raises(ValueError):
        runner.source_root("/a", profiles, {}, has("/p1", "/p3"))
    with pytest.raises(FileNotFoundError):
        runner.source_root("/a", profiles, {}, has())
    stats = {"set1": {"variants": {"none": {"n_examples": 5, "label_counts": {"O": 3}}}}, "set2": {"all": {"n_examples": 2, "label_counts": {"B-X": 1}}}}
    (tmp_path / "m.json").write_text(json.dumps({"dataset_stats": {"train": stats}}))
    got = {(r.field, r["value"]): r.delta for r in commands.manifest_compare(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("n_examples", ""): 3, ("n_tokens_total", ""): 0, ("label_counts", "O"): 3, ("label_counts", "B-X"): -1}
    with pytest.raises(ValueError):
        runner.variant_stats({"dataset_stats": {"train": {"a": {"x": {}}, "b": {"x": {}}}}}, "x")
    found = runner.provenance({"a": 1}, ("pyspark", "no-such-package"))
    assert found["packages"]["pyspark"] and found["packages"]["no-such-package"] is None and len(found["config_sha256"]) == 64


def test_subwords_counters_and_policies(spark):
    from loomtext.functions import budget
    from loomtext.operators import matrix as mx
    from loomtext.operators import variants as va
    from loomtext.operators import windows as wn

    def load():
        def encode(words):
            pieces = [(w[i : i + 2], k) for k, w in enumerate(words) for i in range(0, len(w), 2)]
            return [1, *(10 + len(p) for p, _ in pieces)], [None, *(k for _, k in pieces)]

        return encode

    ex = spark.createDataFrame([("a", ["abc", "d"], ["B-X", "O"]), ("b", ["abcdefgh"] * 2, ["O", "B-X"])], "example_id string, tokens array<string>, labels array<string>")
    got = {r.example_id: r for r in mx.prepared_subwords(ex, {"O": 0, "B-X": 1}, load, max_length=6).collect()}
    assert got["a"].labels == [-100, 1, -100, 0] and not got["a"].truncated
    assert got["b"].labels == [-100, 0, -100, -100, -100, 1] and got["b"].truncated and got["b"].n_full == 9
    with pytest.raises(Exception, match="max_length"):
        mx.prepared_subwords(ex, {"O": 0, "B-X": 1}, load, max_length=6, fail_on_truncation=True).collect()
    loader = lambda c: (lambda t: list(t.lower() if c["fold"] else t))
    counters = budget.counters_of([{"name_or_path": "x", "fold": True}, {"name_or_path": "x", "fold": False}, {}, {"name_or_path": "y", "fold": False, "overhead": 2}], loader)
    assert [(c.lower, c.overhead) for c in counters] == [(True, 0), (False, 2)]
    assert spark.range(1).select(budget.token_count(F.lit("AB c"), counters)).first()[0] == 6
    rows = spark.createDataFrame([(1, "Aa bb"), (2, "Aa bb")], "example_id int, text string")
    known = spark.createDataFrame([(1, "Aa bb", 0), (2, "Aa bb", 0)], "example_id int, name string, ord int")
    pool = spark.createDataFrame([("Cc dd",), ("Ee ff",)], "name string")
    got = va.switch_species(rows, known, pool, 1, sampler=lambda seed, row: row.cast("bigint")).collect()
    assert {r.switched for r in got} == {"Cc dd", "Ee ff"}
    tokens = spark.createDataFrame([(1, list("abcdef"))], "article_id int, tokens array<string>")
    spans = spark.createDataFrame([(1, 0, "SPEC/x", "SPEC", 3, 1, 4)], "article_id int, ord int, source_key string, label4 string, start int, length int, end_excl int")
    one = lambda loc, sents, n, key, **_: F.struct(loc.alias("s"), loc.alias("e"))
    assert [(r.s, r.e) for r in wn.windows(tokens, spans, grow=one).collect()] == [(3, 3)]
