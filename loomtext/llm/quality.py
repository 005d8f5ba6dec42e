"""Quality classifier: regularised quadratic discriminant over document statistics.

:func:`document_statistics` computes transformed statistics of every whole text
once; they are kept in the shared folder. :func:`fit` sums each class's count,
mean and scatter by a distributed aggregation over all rows that it is given,
shrinks the class covariances towards the pooled one and towards a scaled
identity, and caches their Cholesky factors. :func:`apply_model` scores by the
difference of Mahalanobis log densities. :func:`score_documents` fits on all
labelled rows, whose statistics it has anyway; :func:`keep_good` on those of
about ``FIT_IDS`` ids, so that no text but theirs is read twice.

Defined cases: a null or empty text has all-zero statistics and gets a score;
null labels, null ids and labels other than 0 and 1 teach nothing; a repeated
label counts as often as it is given; with a class missing from training every
score is the share of label 1 (0.5 without any label); repeated documents each
get their score; very long texts are read whole; other columns are ignored, or
passed through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import bounded_batches, materialise, sampled

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "upper", "digit", "punctuation",
    "symbol", "exclaim", "pipe", "newlines", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "non_ascii",
)
#: Shrinkage of a class covariance to the pooled one, and of the result to a scaled identity.
POOL_SHRINK, IDENTITY_SHRINK = 0.1, 0.02
#: Labelled ids that :func:`keep_good` learns from, about; chosen by hash.
FIT_IDS = 50_000
#: Standardised statistics are clipped here when they are scored, so one odd text can't outweigh a class.
CLIP = 8.0

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b".,;:'\"()-?"
_SYMBOLS = b"#$%&*@^~<>=[]{}\\/_`+"
_KEEP = {
    name: bytes(b for b in range(256) if b not in chars)
    for name, chars in (("upper", _UPPER), ("digit", _DIGIT), ("marks", _MARKS), ("symbols", _SYMBOLS), ("wide", bytes(range(128, 256))))
}


def statistics_of(text: str | None) -> list[float]:
    """The statistics named in :data:`FEATURES`, each transformed to a bounded or logarithmic scale."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    only = lambda name: len(raw.translate(None, _KEEP[name]))
    root = lambda x, total: (x / total) ** 0.5
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), np.int32, w)
    pairs = w - 1 - len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(n), np.log1p(w), np.log1p(lengths.mean()), root((lengths > 14).sum(), w), root((lengths < 4).sum(), w),
        root(only("upper"), n), root(only("digit"), n), root(only("marks"), n), root(only("symbols"), n), root(raw.count(b"!"), n),
        root(raw.count(b"|"), n), root(raw.count(b"\n"), n), root(len(counts), w), root(max(counts.values()), w), root(pairs, w),
        root(len(lines) - len(set(lines)), max(1, len(lines))), root(only("wide"), n),
    ]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, the ``carry`` columns and ``stats array<double>``. Map-only over whole texts."""
    bounded_batches(docs.sparkSession)
    kept = [id_col, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", stats array<double>"

    def run(batches):
        for batch in batches:
            stats = [statistics_of(t) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(stats, pa.list_(pa.float64()))], names=[*kept, "stats"])

    return docs.select(*kept, text_col).mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray  # of all training rows, for standardising
    scale: np.ndarray
    prior: float  # share of label 1
    centres: np.ndarray | None = None  # [2, d]
    factors: np.ndarray | None = None  # [2, d, d] inverse Cholesky factors
    log_det: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.centres is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        log = [-0.5 * (np.square((z - c) @ f.T).sum(1) + d) for c, f, d in zip(self.centres, self.factors, self.log_det, strict=True)]
        # per dimension, so that scores stay apart from 0 and 1; the decision at 0.5 is the same
        odds = (log[1] - log[0] + np.log(self.prior / (1 - self.prior))) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(labelled: DataFrame, *, label_col: str = "label", stats_col: str = "stats", pool: float = POOL_SHRINK, identity: float = IDENTITY_SHRINK) -> Model:
    """Fit on every row of ``labelled`` (label 0 or 1, statistics).

    Each task reduces its rows to one count, sum and scatter for each class; the
    driver gets their totals only, whose size doesn't depend on the rows.
    """
    d = len(FEATURES)

    def partial(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k in (0, 1):
            if total[k, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([k] * total.shape[1], pa.int32()), pa.array(range(total.shape[1]), pa.int32()), pa.array(total[k])], names=["k", "i", "v"])

    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int"), stats_col)
    got = rows.mapInArrow(partial, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for k, i, v in got:
        total[k, i] = v
    n = total[:, 0]
    if n.sum() == 0 or n.min() < 2:
        return Model(np.zeros(d), np.ones(d), float(n[1] / n.sum()) if n.sum() else 0.5)
    sums, squares = total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)
    mean = sums.sum(0) / n.sum()
    spread = np.diag(squares.sum(0)) / n.sum() - mean**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    centres = (sums / n[:, None] - mean) / scale
    scatter = np.stack([s / c - np.outer(m, m) for s, c, m in zip(squares, n, sums / n[:, None], strict=True)]) / np.outer(scale, scale)
    pooled = (scatter * n[:, None, None]).sum(0) / n.sum()
    model = Model(mean, scale, float(n[1] / n.sum()), centres, np.empty_like(scatter), np.empty(2))
    for k in (0, 1):
        cov = (1 - pool) * scatter[k] + pool * pooled
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        root = np.linalg.cholesky(cov)
        model.factors[k] = np.linalg.inv(root)
        model.log_det[k] = 2 * np.log(np.diag(root)).sum()
    return model


def apply_model(stats: DataFrame, model: Model, *, stats_col: str = "stats") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""
    others = [f for f in stats.schema.fields if f.name != stats_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", score double, predicted int"
    names = [f.name for f in others]

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(len(names)).to_pylist(), np.float64).reshape(batch.num_rows, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return stats.select(*names, stats_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc id, held_out, score, predicted for every document.

    Only the small statistics are joined with the labels; texts aren't shuffled.
    """
    stats = materialise(document_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    known = labels.select(F.col(id_col), F.col(label_col).alias("label")).where(~held_out(id_col))
    model = fit(stats.join(known, id_col).select("label", "stats"))
    return apply_model(stats.withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "stats"), model)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_ids: int = FIT_IDS) -> DataFrame:
    """Documents that are not rejected (predicted 1), with the columns of ``docs``.

    The statistics are computed beside each whole row, so the verdict needs no
    join back to the texts. The rows of the ids to learn from are found by a
    broadcast of these ids, whose number ``fit_ids`` bounds.
    """
    known = labels.select(F.col(id_col), F.col(label_col).alias("label")).where(~held_out(id_col) & F.col(label_col).isin(0, 1))
    known = materialise(known.join(F.broadcast(sampled(known.select(id_col), fit_ids)), id_col, "left_semi"), "labels")
    rows = docs.select(id_col, text_col).join(F.broadcast(known.select(id_col).distinct()), id_col, "left_semi")
    # written, so that no task has two Python workers, which the executor would keep
    stats = materialise(document_statistics(rows, id_col=id_col, text_col=text_col), "statistics")
    model = fit(stats.join(known, id_col).select("label", "stats"))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            s = model.scores(np.array([statistics_of(t) for t in batch.column(at).to_pylist()], np.float64).reshape(batch.num_rows, len(FEATURES)))
            yield batch.filter(pa.array(s >= 0.5))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
