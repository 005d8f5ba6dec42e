"""Language of web pages by Bayesian fusion of evidence.

Text gives a log likelihood for each language by a multinomial model of hashed
byte trigrams, fitted on a bounded sample of labelled documents. Pages declare a
language in their markup, and their address has a suffix (a language segment at
the start of the path, else the top-level domain). Hosts have priors, smoothed
to their registered domain's and that to the global one. Priors and the
likelihoods of declarations and suffixes are grouped sums of the pages' text
posteriors; a page's own share is taken out of all of them but the global prior.
The posterior of a language is proportional to

    prior(language | host) * P(text | language) * P(declared | language) * P(suffix | language)

Defined cases: a null html or url is an empty one; pages without text have a flat
likelihood and rest on the other evidence; a missing declaration or suffix is a
value of its own; ties go to the language that sorts first; repeated pages each
get a row; very long pages are read whole, in linear time whatever their markup;
columns other than the named ones are ignored, whatever their names; without
labelled documents every language is null and the posterior 0.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import bounded_batches, materialise, sampled, skew_join, slices, utf8_column

#: Ids of labelled documents that the text model is fitted on, about; chosen by hash.
SAMPLE = 5_000
BUCKETS = 1 << 13
SMOOTH = 0.5
#: Trigrams overlap, so a text counts as this many independent ones at most.
TEXT_WEIGHT = 60.0
#: Pseudo-pages by which a host leans to its domain, and a domain to all.
KAPPA = 5.0
BROADCAST_ROWS = 200_000

_HIDDEN = re.compile(rb"<(script|style|noscript)\b")
_CLOSE = {name: re.compile(rb"</" + name + rb"\s*>") for name in (b"script", b"style", b"noscript")}
_HTML = re.compile(rb"<html\b")
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([a-z]{2,3})")
#: Character references beyond all code points, which aren't worth a conversion.
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_URL = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)[^/?#]*(?:/([a-z]{2})(?=[/?#]|$))?")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 96 and b < 123 or b >= 128 else 32 for b in range(256))
_SPACES = re.compile(rb" +")


def visible(page: str | None) -> str:
    """Text of a page without comments, scripts, styles and tags, each of them a space.

    One scan: what has no end is looked for once, so the time is linear. A
    comment or script without an end is a tag; a ``<`` without ``>`` is text.
    """
    raw = (page or "").encode("utf-8", "replace")
    low, out, at = raw.lower(), [], 0
    endless: set[bytes] = set()
    while (start := low.find(b"<", at)) >= 0:
        end = low.find(b">", start) + 1
        if not end:
            break
        if low.startswith(b"<!--", start) and b"--" not in endless:
            close = low.find(b"-->", start + 4)
            if close < 0:
                endless.add(b"--")
            else:
                end = close + 3
        elif (m := _HIDDEN.match(low, start)) and m[1] not in endless:
            close = _CLOSE[m[1]].search(low, end)
            if close:
                end = close.end()
            else:
                endless.add(m[1])
        out += [raw[at:start], b" "]
        at = end
    text = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", text))


def declared_in(page: str | None) -> str:
    """Primary language subtag that an ``html`` tag declares, or an empty text."""
    low = (page or "").encode("utf-8", "replace").lower()
    at = 0
    while m := _HTML.search(low, at):
        at = low.find(b">", m.end())
        at = len(low) if at < 0 else at
        if lang := _LANG.search(low, m.end(), at):
            return lang[1].decode()
    return ""


def address(url: str | None) -> tuple[str, str, str]:
    """(host, registered domain, suffix) of an address; the domain is its last two labels."""
    m = _URL.match(url or "")
    if not m or not m[1]:
        return "", "", ""
    host = m[1].lower().rstrip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), f"/{m[2].lower()}" if m[2] else f".{labels[-1]}"


def fold(texts: list[str]) -> pa.Array:
    return pa.array([_SPACES.sub(b" ", t.encode("utf-8", "replace").translate(_FOLD)) for t in texts], pa.binary())


def trigram_counts(column: pa.Array):
    """Yield the hashed byte-trigram counts of each row of a folded column."""
    data, offsets = utf8_column(column)
    for a, b in slices(offsets, 4_000_000):
        d = data[offsets[a] : offsets[b]].astype(np.uint32)
        h = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761)) >> np.uint32(19) if len(d) > 2 else np.zeros(0, np.uint32)
        for x, y in zip((offsets[a:b] - offsets[a]).tolist(), (offsets[a + 1 : b + 1] - offsets[a]).tolist(), strict=True):
            yield np.bincount(h[x : max(x, y - 2)], minlength=BUCKETS)


def fit_text_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [BUCKETS, languages]) of the sampled labelled documents."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = sampled(labelled.select(id_col), sample)
    rows = labelled.join(F.broadcast(chosen), id_col, "left_semi").select(lang_col, text_col)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, c in zip(b.column(0).to_pylist(), trigram_counts(fold(b.column(1).to_pylist())), strict=True):
                total[lang] = total.get(lang, 0) + c
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * BUCKETS), pa.array(range(BUCKETS), pa.int32()), pa.array(c.astype(np.int64))], names=["lang", "i", "n"])

    got = rows.mapInArrow(count, "lang string, i int, n bigint").groupBy("lang", "i").agg(F.sum("n").alias("n")).where("n > 0").collect()
    langs = sorted({r[0] for r in got})
    counts = np.full((BUCKETS, len(langs)), SMOOTH)
    for lang, i, n in got:
        counts[i, langs.index(lang)] += n
    return langs, np.log(counts / counts.sum(0))


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: host, domain, suffix, declared and the text log likelihoods. Map-only."""
    langs, log_p = model
    bounded_batches(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    names = [id_col, "host", "domain", "suffix", "declared", "text_log"]

    def run(batches):
        for b in batches:
            where = [address(u) for u in b.column(1).to_pylist()]
            sources = b.column(2).to_pylist()
            declared = [declared_in(s) for s in sources]
            logs = []
            for c in trigram_counts(fold([visible(s) for s in sources])):
                n = c.sum()
                log = c @ log_p * (min(1.0, TEXT_WEIGHT / n) if n else 0.0)
                logs.append(log - log.max() if len(log) else log)
            cols = [pa.array([w[i] for w in where], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64()))], names=names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {id_type}, host string, domain string, suffix string, declared string, text_log array<double>")


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", **columns) -> DataFrame:
    """Per page: id, host, declared, suffix, text_lang, lang, posterior."""
    langs, log_p = fit_text_model(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return evidence(pages, (langs, log_p), id_col=id_col, **columns).select(id_col, "host", "declared", "suffix", none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("posterior"))
    k = len(langs)
    rows = evidence(pages, (langs, log_p), id_col=id_col, **columns)
    mass = F.aggregate("text_log", F.lit(0.0), lambda a, x: a + F.exp(x))
    rows = materialise(rows.withColumn("p", F.transform("text_log", lambda x: F.exp(x) / mass)), "evidence")

    def sums(*keys: str, name: str) -> DataFrame:
        each = [F.sum(F.col("p")[i]) for i in range(k)]
        return rows.groupBy(*keys).agg(F.array(*each).alias(name), F.count("*").alias(f"n_{name}"))

    total = rows.agg(*(F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k)), F.count("*")).first()
    pages_total = max(1, total[k])
    prior = F.array(*(F.lit((total[i] + 1) / (pages_total + k)) for i in range(k)))

    def attached(out: DataFrame, table: DataFrame, key: str, count: str, *by: str) -> DataFrame:
        """``out`` with the row of its key; a hot host or suffix is no task of its own."""
        table = materialise(table, "sums")
        if table.count() <= BROADCAST_ROWS:
            return out.join(F.broadcast(table), key)
        return skew_join(out, table, key, count, pages_total, F.struct(*by))

    domains = sums("domain", name="of_domain")
    hosts = attached(sums("host", "domain", name="of_host"), domains, "domain", "n_of_domain", "host").drop("domain")
    out = attached(rows, hosts, "host", "n_of_host", id_col, "text_log")
    logs = []
    for key in ("declared", "suffix"):
        out = attached(out, sums(key, name=f"of_{key}"), key, f"n_of_{key}", id_col, "text_log")
        values = max(1, rows.select(key).distinct().count())
        # log P(key | language) of the other pages, smoothed by one page over all values
        logs.append(F.array(*(F.log((F.greatest(F.col(f"of_{key}")[i] - F.col("p")[i], F.lit(0.0)) + 1.0) / (F.greatest(F.lit(total[i]) - F.col("p")[i], F.lit(0.0)) + F.lit(values))) for i in range(k))))
    out = out.withColumns({"log_declared": logs[0], "log_suffix": logs[1]})
    others = lambda n, i: F.greatest(n - F.col("p")[i], F.lit(0.0))
    domain_prior = F.transform("of_domain", lambda n, i: (others(n, i) + KAPPA * prior[i]) / (F.col("n_of_domain") - 1 + KAPPA))
    out = out.withColumn("domain_prior", domain_prior)
    out = out.withColumn("host_prior", F.transform("of_host", lambda n, i: (others(n, i) + KAPPA * F.col("domain_prior")[i]) / (F.col("n_of_host") - 1 + KAPPA)))
    log = F.transform("text_log", lambda x, i: x + F.log(F.col("host_prior")[i]) + F.col("log_declared")[i] + F.col("log_suffix")[i])
    out = out.withColumn("log", log).withColumn("top", F.array_max("log"))
    share = 1 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return out.select(id_col, "host", "declared", "suffix", best("text_log").alias("text_lang"), best("log").alias("lang"), share.alias("posterior"))
