"""Text expressions: sentence ends, species mentions, substitution, scrambling, licences, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.let import let
from loomtext.functions.rng import draw

#: Abbreviations that don't end a sentence, fixed values.
NON_STOPS = ("fig.", "al.", "sp.", "spp.", "e.g.", "pv.", "eg.")
#: Candidate species mentions, a fixed value.
SPECIES = r"[A-Z](?:[a-z]+|\.)\s[a-z]+"
SENTINEL = "\x01"
#: Words of a phrase that scrambling leaves alone, fixed values.
CONSERVED = (
    "strain", "subsp", "subspecies", "isolate", "pathovar", "serovar", "serotype", "genotype", "ecotype", "sequence",
    "mutant", "wild-type", "complementation", "complemented", "pv", "wt", "type", "sp",
)
SKIPPED = ("δ", "Δ")
_VOWELS = "aeiouy"
_CONSONANTS = "".join(c for c in map(chr, range(97, 123)) if c not in _VOWELS)
_GREEK = "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2)
#: Characters that are permuted among themselves.
CLASSES = ("0123456789", _VOWELS, _CONSONANTS, _VOWELS.upper(), _CONSONANTS.upper(), _GREEK, _GREEK.upper())


def words(text: Column) -> Column:
    """White-space separated tokens; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def is_stop(token: Column, non_stops: tuple[str, ...] = NON_STOPS) -> Column:
    """Whether a token ends a sentence."""
    return token.endswith(".") & ((token == "].") | ((F.length(token) >= 3) & ~F.lower(token).isin(*[x.lower() for x in non_stops])))


def mentions(text: Column) -> Column:
    """Candidate species mentions in order."""
    return F.regexp_extract_all(text, F.lit(SPECIES), F.lit(0))


def is_abbreviated(name: Column) -> Column:
    return F.substring(name, 2, 1) == "."


def abbreviation(name: Column) -> Column:
    """``G. epithet`` of a two-word name."""
    return F.concat(F.left(name, F.lit(1)), F.lit(". "), F.split_part(name, F.lit(" "), F.lit(2)))


def species_key(name: Column) -> Column:
    """struct(initial, epithet) of a two-word name, else null."""
    parts = F.split(F.trim(name), " ")
    return F.when(F.size(parts) == 2, F.struct(F.left(parts[0], F.lit(1)).alias("initial"), parts[1].alias("epithet")))


def quoted(x: Column) -> Column:
    """A string as a literal inside a regular expression."""
    return F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def replace_all(text: Column, replacements: Column) -> Column:
    """One-pass substitution by a map: longest key first, replaced text isn't searched again."""
    return let(replacements, lambda m: _replace_all(text, m))


def _replace_all(text: Column, replacements: Column) -> Column:
    keys = F.array_sort(F.map_keys(replacements), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    pattern = F.concat(F.lit("("), F.array_join(F.transform(keys, quoted), "|"), F.lit(")"))
    marked = F.regexp_replace(text, pattern, F.lit(f"{SENTINEL}$1{SENTINEL}"))
    pieces = F.split(marked, SENTINEL)
    swapped = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(replacements, p), p)).otherwise(p))
    return F.when(F.size(replacements) == 0, text).otherwise(F.array_join(swapped, ""))


def permutation(seed: int | str, key: Column, force_diff: bool = False) -> tuple[Column, Column]:
    """(from, to) strings for ``translate``: each character class permuted by the draw of (key, character).

    With ``force_diff`` every class is permuted without fixed points.
    """
    sources, targets = [], []
    for chars in CLASSES:
        own = F.array(*(F.lit(c) for c in sorted(set(chars) - set(SKIPPED))))
        mixed = F.transform(F.array_sort(F.transform(own, lambda c: F.struct(draw(seed, "perm", key, c).alias("h"), c.alias("c")))), lambda x: x["c"])
        if force_diff:
            sources.append(F.array_join(F.concat(F.slice(mixed, F.lit(2), F.size(mixed) - 1), F.slice(mixed, 1, 1)), ""))
        else:
            sources.append(F.array_join(own, ""))
        targets.append(F.array_join(mixed, ""))
    return F.concat(*sources), F.concat(*targets)


def translated(text: Column, source: Column, target: Column) -> Column:
    return F.call_function("translate", text, source, target)


def scramble_phrase(phrase: Column, source: Column, target: Column, conserved: tuple[str, ...] = CONSERVED) -> Column:
    """A phrase with its words permuted, conserved words as they are."""

    def one(w: Column) -> Column:
        plain = F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
        return F.when(plain.isin(*conserved), w).otherwise(translated(w, source, target))

    return F.trim(F.array_join(F.transform(F.split(phrase, " "), one), " "))


def replace_in_turn(text: Column, pairs: Column) -> Column:
    """Sequential replacement by array<struct<src,dst>>, each over the result of those before."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["src"], p["dst"]))


def phrase_order(phrases: Column) -> Column:
    """Distinct non-empty phrases from long to short, then by text."""
    kept = F.array_distinct(F.filter(phrases, lambda p: p.isNotNull() & (p != "")))
    return F.array_sort(kept, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def phrases_present(text: Column, phrases: Column) -> Column:
    """Phrases that stand in the text as whole words, in phrase order."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return phrase_order(let(padded, lambda t: F.filter(phrases, lambda p: F.contains(t, F.concat(F.lit(" "), p, F.lit(" "))))))


def slug(text: Column, fallback: str = "item", most: int = 80) -> Column:
    """Lower-case words joined by dashes, at most ``most`` characters."""
    s = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")
    s = F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(most))
    return F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(s)


def stable_seed(seed: int, key: Column) -> Column:
    """``seed`` XOR the first 32 bits of the key's SHA-1."""
    return F.lit(seed).cast("bigint").bitwiseXOR(F.conv(F.left(F.sha1(key.cast("binary")), F.lit(8)), 16, 10).cast("bigint"))


def profile_label(name: Column) -> Column:
    return F.left(F.sha1(name.cast("binary")), F.lit(8))


def percent(metric: Column, value: Column) -> Column:
    """Precision, recall and F1 in percent; other metrics as they are."""
    return F.when(metric.isin("precision", "recall", "f1"), value * 100.0).otherwise(value)


def short_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm dd/MM/yy")


# ---------------------------------------------------------------- licences

# Markers, licence ids, policy words and reasons below are fixed values.
_CC = (
    # marker of the address and of the short names, licence; in the order of precedence
    ("by-nc-nd", "CC-BY-NC-ND-4.0"),
    ("by-nc-sa", "CC-BY-NC-SA-4.0"),
    ("by-nd", "CC-BY-ND-4.0"),
    ("by-sa", "CC-BY-SA-4.0"),
    ("by-nc", "CC-BY-NC-4.0"),
)
PERMISSIVE = ("CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-NC-SA-4.0", "MIT", "CC0-1.0")


def license_id(raw: Column) -> Column:
    """Normalised licence of a free text; ``UNKNOWN`` for a blank one, the trimmed text if nothing matches."""
    raw = F.coalesce(raw, F.lit(""))
    s = F.replace(F.lower(F.trim(raw)), F.lit("_"), F.lit("-"))
    has = lambda *xs: F.lit(False) if not xs else s.contains(xs[0]) | has(*xs[1:])
    nc, nd, sa = has("noncommercial", "non-commercial"), has("noderivatives", "no derivatives", "no-derivatives"), has("sharealike", "share alike", "share-alike")
    cc = s.contains("creative commons")
    out = (
        F.when(s == "", "UNKNOWN")
        .when(s.contains("all rights reserved"), "ALL-RIGHTS-RESERVED")
        .when(has("creativecommons.org/publicdomain/zero", "cc0"), "CC0-1.0")
        .when(cc & nc & nd, "CC-BY-NC-ND-4.0")
        .when(cc & nc & sa, "CC-BY-NC-SA-4.0")
        .when(cc & nd, "CC-BY-ND-4.0")
        .when(cc & sa, "CC-BY-SA-4.0")
        .when(cc & nc, "CC-BY-NC-4.0")
        .when(cc & s.contains("attribution"), "CC-BY-4.0")
    )
    for marker, name in _CC:
        out = out.when(has(f"creativecommons.org/licenses/{marker}/4.0", f"cc {marker}", f"cc-{marker}"), name)
    out = out.when(has("creativecommons.org/licenses/by/4.0", "cc by 4.0", "cc-by-4.0"), "CC-BY-4.0")
    return out.when((s == "mit") | s.startswith("mit "), "MIT").otherwise(F.trim(raw))


def license_flags(lid: Column) -> Column:
    """struct(attribution_required, redistribution_allowed, derivative_allowed, policy_status)."""
    lid = F.upper(F.trim(F.coalesce(lid, F.lit("UNKNOWN"))))
    barred = (lid == "ALL-RIGHTS-RESERVED") | lid.contains("-ND")
    allowed = ~barred & lid.isin(*PERMISSIVE)
    return F.struct(
        (lid.contains("-ND") | (allowed & ~lid.isin("MIT", "CC0-1.0"))).alias("attribution_required"),
        allowed.alias("redistribution_allowed"),
        allowed.alias("derivative_allowed"),
        F.when(barred, "disallowed").when(allowed, "allowed").otherwise("unknown").alias("policy_status"),
    )


def license_reasons(lid: Column, policy: dict, allowed: Column) -> Column:
    """Sorted reasons against a licence under a policy; ``allowed`` is an array of licence ids."""
    lid = F.upper(F.trim(F.coalesce(lid, F.lit("UNKNOWN"))))
    on = lambda key, default: F.lit(bool(policy.get(key, default)))
    unknown = F.lit(str(policy.get("unknown", "allow")).lower() in ("exclude", "fail"))
    reasons = F.array(
        F.when(~F.array_contains(allowed, lid), "license_not_in_allowed_set"),
        F.when(on("disallow_all_rights_reserved", True) & (lid == "ALL-RIGHTS-RESERVED"), "all_rights_reserved_disallowed"),
        F.when(on("disallow_no_derivatives", True) & lid.contains("-ND"), "no_derivatives_disallowed"),
        F.when(~on("allow_noncommercial", True) & lid.contains("-NC"), "noncommercial_disallowed"),
        F.when(~on("allow_share_alike", True) & lid.contains("-SA"), "share_alike_disallowed"),
    )
    known = F.array_sort(F.filter(reasons, lambda r: r.isNotNull()))
    none = F.array().cast("array<string>")
    return F.when(lid == "UNKNOWN", F.when(unknown, F.array(F.lit("unknown_license"))).otherwise(none)).otherwise(known)


def is_checksum(x: Column) -> Column:
    return x.rlike("(?i)^[a-f0-9]{8,128}$")
