"""Personal data and secrets: regular expressions propose, checksums confirm, context scores.

Base kinds, leftmost and non-overlapping per kind: ``email``, ``ip`` (parts at
most 255), ``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits).
Matches that fail their validator are dropped and not retried. Further kinds:
``iban`` (ISO 13616: the length of its country, mod-97; for a country without a
listed length the longest run of whole tokens that holds), ``local_phone``
(national numbers) and ``secret`` (keys and tokens of any length: runs of letters
and digits of high entropy, with the segments that dots join to them, and private
key blocks up to their last line). National numbers and unmarked
secrets are reported only when nearby context words lift their score to the
threshold.

Every span has a score: the prior of its kind, raised by whole context words in the
``CONTEXT_CHARS`` code points before it or after it. Base spans are kept
whatever their score.

Defined cases: a null text is empty; empty texts have no spans; rows are
independent, so repeated rows each get their result; very long texts are read
whole, in linear time; columns other than id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm.common import bounded_batches

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "local_phone", "secret")
CONTEXT_CHARS = 40
THRESHOLD = 0.5

# Possessive runs and the look-behind leave the matches as they are and keep long digit runs linear.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of a country's IBAN, fixed values.
_IBAN_LENGTH = {
    c: n
    for n, each in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in each.split()
}
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?<![0-9]\x20)\(?0?[0-9]{2,4}\)?[\x20/-][0-9]{3,4}[\x20-][0-9]{3,4}(?![\x20-]?[0-9]|-)")

#: Tokens with a known head whose segments are joined by dots, and long runs that could be keys, with the segments that follow them; an equals sign pads them at the end only.
_SECRET = re.compile(
    r"(?<![A-Za-z0-9_+/.-])(?:((?:eyJ[A-Za-z0-9_-]*+|SG|ya29)(?:\.{1,2}[A-Za-z0-9_+/-]++)++)|([A-Za-z0-9_+/-]{20,}+)(?:\.[A-Za-z0-9_+/-]++)*+)={0,2}(?![A-Za-z0-9_+/-])"
)
#: Heads of well-known keys and tokens, fixed values.
_MARKED = re.compile(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|glpat-|npm_|eyJ|SG\.|ya29\.")
#: A block's header lines and base 64, line ends as such or escaped, up to its last line.
_KEY_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----(?:\s*+(?:Proc-Type|DEK-Info|Comment|Version):[^\n]*+)*+[A-Za-z0-9+/=\s\\]*+(?:-----END (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----)?"
)
#: Least bits a character of a secret.
ENTROPY = 2.8

PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "karte", "kreditkarte", "tarjeta", "carte"),
    "phone": ("phone", "telephone", "telefon", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "local_phone": ("phone", "telephone", "telefon", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "api[ _-]?key", "apikey", "access[ _-]?key", "private[ _-]?key", "key", "bearer", "credential", "auth", "authorization"),
}
_CONTEXT = {k: re.compile(r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(v) + r")s?(?![A-Za-z0-9])") for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ibans(text: str):
    """Valid ones from left to right; after a failed proposal the next one may begin inside it."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        length = _IBAN_LENGTH.get(m[0][:2])
        ends = [m.end()] + [i for i in range(m.end() - 1, m.start(), -1) if text[i] == " "]  # token ends, long to short
        for end in ends:
            iban = text[m.start() : end].replace(" ", "")
            if (len(iban) == length if length else 15 <= len(iban) <= 34) and mod97(iban):
                yield m.start(), end
                at = end
                break


def _emails(text: str):
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def propose(text: str) -> list[tuple[str, int, int]]:
    """Confirmed base spans by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_part(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and (not p or int(p) <= 255)


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, moved half of the way to 1 by a context word nearby."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]
    p = PRIOR[kind]
    return p + (1 - p) / 2 if _CONTEXT[kind].search(near) else p


def entropy(s: str) -> float:
    """Bits a character, by the characters of ``s``."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _secrets(text: str):
    """(start, end, whether it is marked as a secret by itself), from left to right."""
    found = [(m.start(), m.end(), True) for m in _KEY_BLOCK.finditer(text)] if "PRIVATE KEY-----" in text else []
    free = _Free((s, e) for s, e, _ in found)
    for m in _SECRET.finditer(text):
        s = m[1] or m[2]
        if len(s) < 20 or not free(m.start(), m.end()) or not (any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s)) or entropy(s) < ENTROPY:
            continue
        found.append((m.start(), m.end(), bool(_MARKED.match(s))))
    return sorted(found)


class _Free:
    """Whether a range meets none of the given ones; one lookup each."""

    def __init__(self, ranges) -> None:
        self.starts, self.ends = [], []
        for s, e in sorted(ranges):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i < 0 or self.ends[i] <= start


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by kind as listed, then start."""
    if not text:
        return []
    base = propose(text)
    ibans = [("iban", s, e) for s, e in _ibans(text)]
    out = [(k, s, e, score(text, k, s, e)) for k, s, e in base + ibans]
    free = _Free((s, e) for _, s, e in base + ibans)
    for m in _LOCAL_PHONE.finditer(text):
        if free(m.start(), m.end()) and (p := score(text, "local_phone", m.start(), m.end())) >= THRESHOLD:
            out.append(("local_phone", m.start(), m.end(), p))
    free = _Free((s, e) for k, s, e in base + ibans if k in ("email", "iban"))
    for s, e, marked in _secrets(text):
        p = score(text, "secret", s, e)
        p = max(p, 0.9) if marked else p
        if p >= THRESHOLD and free(s, e):
            out.append(("secret", s, e, p))
    return out


def joined(spans) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of base kinds, digest of base spans, all spans, their number, and each with its score. Map-only."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "details"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                spans = spans_of(text)
                base = [x for x in spans if x[0] in BASE]
                for c, k in zip(cols, BASE, strict=False):
                    c.append(sum(x[0] == k for x in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(spans))
                cols[6].append(len(spans))
                cols[7].append([dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    schema = f"`{id_col}` {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint, details {SPAN}"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(text: str, spans) -> str:
    """``text`` with every span replaced by ``<KIND>``; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
