"""Vectorised word and shingle hashing of Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. A text's set holds its distinct
shingles of ``size`` consecutive words as 64-bit hashes; a text of fewer words,
but not none, has its whole word sequence as its one shingle.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and the rows' offsets into them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    run = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, run)
    power = np.cumprod(np.full(int(run.max()), _BASE, np.uint64))
    value = (_LOWER[data[starts[0] :]] + np.uint64(1)) * power[place]
    value[space[starts[0] :]] = 0
    hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.searchsorted(starts, offsets)


def hash_shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    keys = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(0, np.uint64)
    if len(words) >= size:
        m = len(words) - size + 1
        total = words[:m] * keys[0]
        for k in range(1, size):
            total = mix(total) + words[k : k + m] * keys[k]
        full = mix(total)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(full[a : b - size + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        elif b > a:
            total = np.uint64(b - a)
            for k in range(b - a):
                total = mix(np.array([total], np.uint64))[0] + words[a + k] * keys[k]
            out.append(mix(np.array([total ^ np.uint64(0x5BF03635)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, slices):
    """Yield the shingle set of each row in turn; ``slices`` bounds the rows hashed at once."""
    with np.errstate(over="ignore"):
        for a, b in slices(offsets, SLICE_BYTES):
            part = data[offsets[a] : offsets[b]]
            words, at = hash_words(part, offsets[a : b + 1] - offsets[a])
            yield from hash_shingles(words, at, size)
