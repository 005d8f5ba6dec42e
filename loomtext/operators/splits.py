"""Article splits: apportionment, assignment, coverage repair."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, heapreplace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.rng import draw
from loomtext.shared import materialise


@dataclass(frozen=True)
class SplitSpec:
    name: str
    fraction: float
    min_articles_per_category: int = 0


def split_specs(config: dict) -> list[SplitSpec]:
    """Specs of ``{"train_fraction": f}`` (train and a covered test) or of named ``{"splits": {name: {...}}}``."""
    named = config.get("splits")
    if named:
        specs = []
        for name, value in named.items():
            coverage = value.get("coverage") or {}
            specs.append(SplitSpec(str(name), _fraction(value.get("fraction")), int(coverage.get("min_articles_per_category", 0))))
    else:
        train = _fraction(config.get("train_fraction", 0.8))
        specs = [SplitSpec("train", train), SplitSpec("test", 1.0 - train, 1)]
    if abs(sum(s.fraction for s in specs) - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to 1")
    if any(s.min_articles_per_category not in (0, 1) for s in specs):
        raise ValueError("min_articles_per_category must be 1")
    return specs


def _fraction(x) -> float:
    f = float(x)
    if not 0.0 <= f <= 1.0:
        raise ValueError(f"split fraction out of range: {x}")
    return f


def apportion(n: int, specs: list[SplitSpec]) -> dict[str, int]:
    """Articles of each split by largest remainders, ties in the order of the specs."""
    exact = [n * s.fraction for s in specs]
    counts = [math.floor(x) for x in exact]
    order = sorted(range(len(specs)), key=lambda i: -(exact[i] - counts[i]))
    for i in order[: n - sum(counts)]:
        counts[i] += 1
    return {s.name: c for s, c in zip(specs, counts, strict=True)}


def apportioned(sizes: DataFrame, specs: list[SplitSpec], *keys: str) -> DataFrame:
    """(keys, split, n_articles): :func:`apportion` of the column ``n`` of every group; a group has as many rows as there are specs."""
    parts = F.array(*(F.struct(F.lit(s.name).alias("split"), F.lit(s.fraction).alias("fraction")) for s in specs))
    exact = F.col("n") * F.col("p.fraction")
    rows = sizes.select(*keys, "n", F.posexplode(parts).alias("ord", "p")).withColumns({"k": F.floor(exact), "rest": exact - F.floor(exact)})
    group = Window.partitionBy(*keys)
    more = F.row_number().over(group.orderBy(F.desc("rest"), "ord")) <= F.col("n") - F.sum("k").over(group)
    return rows.select(*keys, "p.split", (F.col("k") + more.cast("bigint")).alias("n_articles"))


def categories(spans: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    """Distinct (id, category): the tag of the span key."""
    return spans.select(id_col, F.split_part("source_key", F.lit("/"), F.lit(1)).alias("category")).distinct()


def category_counts(cats: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    return cats.groupBy("category").agg(F.countDistinct(id_col).alias("n_articles"))


def assign(articles: DataFrame, specs: list[SplitSpec], seed: int, *, id_col: str = "article_id") -> DataFrame:
    """(id, split): articles in the order of their draws, cut at the cumulative counts."""
    from loomtext.operators.lexicon import _ranked

    distinct = articles.select(id_col).distinct()
    counts = apportion(distinct.count(), specs)
    ranked = _ranked(distinct.withColumn("h", draw(seed, "split", id_col)), "h", id_col)
    case, at = F.lit(None).cast("string"), sum(counts.values())
    for s in reversed(specs):
        at -= counts[s.name]
        case = F.when(F.col("rank") >= at, F.when(F.col("rank") < at + counts[s.name], s.name).otherwise(case)).otherwise(case)
    return ranked.select(id_col, case.alias("split"))


TRACE = "step int, action string, missing string, donor_split string, donor string, donor_cover int, swapped_out string, redundancy int, irrelevant boolean"


class Groups:
    """Articles of a lineage by (split, categories): how many, and as many smallest ids as a repair can move."""

    def __init__(self, rows) -> None:
        """``rows``: (split, categories, number, smallest ids in order)."""
        self.sizes: Counter[str] = Counter()
        self.count: dict[str, Counter[str]] = {}
        self.ids: dict[tuple[str, frozenset[str]], list[str]] = {}
        for split, cats, n, ids in rows:
            cats = frozenset(cats)
            self.sizes[split] += n
            self.ids[split, cats] = sorted(ids)
            for c in cats:
                self.count.setdefault(split, Counter())[c] += n

    def move(self, article: str, cats: frozenset[str], old: str, new: str) -> None:
        heappop(self.ids[old, cats])
        if not self.ids[old, cats]:
            del self.ids[old, cats]
        heappush(self.ids.setdefault((new, cats), []), article)
        for split, n in ((old, -1), (new, 1)):
            self.sizes[split] += n
            for c in cats:
                self.count.setdefault(split, Counter())[c] += n

    def repair(self, target: str, every: set[str], sizes: dict[str, int] | None = None) -> tuple[list[tuple[str, str]], list[tuple]]:
        """(moves in turn, trace) that bring ``every`` category to ``target``, or as many as there are."""
        sizes = sizes or {s: n for s, n in self.sizes.items() if n}
        donors = sorted((s for s in sizes if s != target), key=lambda s: (s != "train", -sizes[s], s))
        rank = {s: i for i, s in enumerate(donors)}
        count = self.count.setdefault(target, Counter())
        missing = {c for c in every if not count[c]}
        # what an article covers only shrinks: an old value is a bound, and is looked at again when it comes first
        options = [(-len(cats & missing), rank[s], ids[0], s, cats) for (s, cats), ids in self.ids.items() if s != target and cats & missing]
        heapify(options)
        moves, trace = [], []
        while missing:
            named, best = ",".join(sorted(missing)), None
            while options and best is None:
                bound, place, article, split, cats = options[0]
                now = (-len(cats & missing), place, self.ids[split, cats][0] if (split, cats) in self.ids else None)
                if not now[0] or now[2] is None:
                    heappop(options)
                elif now != (bound, place, article):
                    heapreplace(options, (*now, split, cats))
                else:
                    best = options[0]
            if best is None:
                trace.append((len(trace), "unresolved_missing", named, None, None, None, None, None, None))
                break
            cover, _, article, donor, cats = best
            out = self._spare(target, count)
            self.move(article, cats, donor, target)
            moves.append((article, target))
            if out:
                relevant, redundancy, gone, held = out
                self.move(gone, held, target, donor)
                moves.append((gone, donor))
                trace.append((len(trace), "swap", named, donor, article, -cover, gone, -redundancy, not relevant))
            else:
                trace.append((len(trace), "add", named, donor, article, -cover, None, None, None))
            missing = {c for c in missing if not count[c]}
        return moves, trace

    def _spare(self, target: str, count: Counter[str]):
        """(whether it has categories, minus its redundancy, id, categories) of the article to give back."""
        bare = self.ids.get((target, frozenset()))
        if bare:
            return False, 0, bare[0], frozenset()
        out = [(True, -sum(count[c] - 1 for c in cats), ids[0], cats) for (s, cats), ids in self.ids.items() if s == target and all(count[c] > 1 for c in cats)]
        return min(out, key=lambda x: x[:3], default=None)


def repair(members: dict[str, str], cats: dict[str, set[str]], target: str, sizes: dict[str, int] | None = None) -> tuple[dict[str, str], list[tuple]]:
    """Greedy coverage repair of one split: (article -> split, decision trace).

    Until every category stands in ``target``: take the article that covers most
    missing categories (then train before other splits, larger ones first, then
    the smaller id), and give back the article whose categories all stay covered
    (without categories first, then the most redundant, then the smaller id), or
    none if there is none. ``sizes`` of the splits, where ``members`` are only some.
    Articles of one split and the same categories differ by id alone, so steps
    look at such groups and counts by category, not at articles.
    """
    by: dict[tuple[str, frozenset[str]], list[str]] = {}
    for a, s in members.items():
        by.setdefault((s, frozenset(cats.get(a, ()))), []).append(a)
    every = set().union(*cats.values()) if cats else set()
    moves, trace = Groups((s, c, len(ids), ids) for (s, c), ids in by.items()).repair(target, every, sizes)
    return members | dict(moves), trace


def repair_coverage(assigned: DataFrame, cats: DataFrame, targets: list[str], *, id_col: str = "article_id", lineage_col: str = "lineage") -> tuple[DataFrame, DataFrame]:
    """(lineage, id, split) after repair, and the decision trace.

    A lineage whose target splits lack no category has nothing to repair and
    stays in SQL. Of the others Spark counts the articles of each split and set of
    categories and keeps their smallest ids, as many as there are categories and
    targets: a step covers a missing category and takes at most one article from
    a group. Python gets these groups, however many articles there are, and
    gives back moves and decisions.
    """
    kind = assigned.schema[lineage_col].dataType.simpleString()
    own = cats.groupBy(id_col).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    rows = assigned.join(own, id_col, "left").select(F.col(lineage_col).alias("lineage"), F.col(id_col).cast("string").alias("id"), "split", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))
    rows = materialise(rows, "assigned")
    per = rows.select("lineage", "split", F.explode("categories").alias("category")).groupBy("lineage", "category").agg(F.collect_set("split").alias("splits"))
    lack = per.withColumn("lacks", ~F.forall(F.array(*(F.lit(t) for t in targets)), lambda t: F.array_contains("splits", t)))
    lack = materialise(lack.groupBy("lineage").agg(F.bool_or("lacks").alias("lacks"), (F.count("*") * len(targets)).cast("int").alias("most")).where("lacks").drop("lacks"), "missing")
    asked = rows.join(lack, "lineage")
    # smallest ids of a group, first in each of many parts, then of these
    group = ["lineage", "split", "categories"]
    part = F.pmod(F.xxhash64("id"), F.lit(256)).alias("part")
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    few = asked.select(*group, "id", "most", part).withColumn("k", first([*group, "part"])).where("k <= most").withColumn("k", first(group)).where("k <= most")
    small = few.groupBy(*group).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    groups = asked.groupBy(*group).agg(F.count("*").alias("n")).join(small, group)
    fields = [c.split()[0] for c in TRACE.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held = Groups(zip(pdf["split"], pdf["categories"], pdf["n"].tolist(), pdf["ids"], strict=True))
        every = {c for each in pdf["categories"] for c in each}
        before = {i: s for s, ids in zip(pdf["split"], pdf["ids"], strict=True) for i in ids}
        now, out = {}, []
        for t in targets:
            moves, more = held.repair(t, every)
            now |= dict(moves)
            out += [(key[0], None, None, t, *x) for x in more]
        out += [(key[0], i, s, None, *[None] * len(fields)) for i, s in sorted(now.items()) if s != before[i]]
        return pd.DataFrame(out, columns=["lineage", "id", "split", "target", *fields]).astype(object)

    done = materialise(groups.groupBy("lineage").applyInPandas(run, f"lineage {kind}, id string, split string, target string, {TRACE}"), "repaired")
    moves = done.where("target is null").select("lineage", "id", F.col("split").alias("now"))
    moved = rows.join(moves, ["lineage", "id"], "left").select("lineage", "id", F.coalesce("now", "split").alias("split"))
    return moved, done.where("target is not null").drop("id", "split")


def removable(assigned: DataFrame, cats: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    """(id, split, redundancy) of articles whose categories all stay covered in their split without them."""
    rows = assigned.join(cats, id_col, "left")
    n = F.count("category").over(Window.partitionBy("split", "category"))
    rows = rows.withColumn("n", F.when(F.col("category").isNotNull(), n))
    out = rows.groupBy(id_col, "split").agg(F.coalesce(F.min("n"), F.lit(2)).alias("least"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundancy"))
    return out.where("least > 1").select(id_col, "split", "redundancy")
