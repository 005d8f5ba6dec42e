"""Cuckoo filters over 128-bit keys, filled and emptied in bulk."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Buckets of a filter (a power of two), and the keys it is meant for: three quarters of its slots.
BUCKETS = 1 << 13
KEYS = SLOTS * BUCKETS * 3 // 4
KICKS = 500


def _spread(fp: np.ndarray) -> np.ndarray:
    """A bucket difference for each fingerprint."""
    with np.errstate(over="ignore"):
        h = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64)


class Cuckoo:
    """Each distinct key is added once and may be removed once; 16-bit fingerprints in one of two buckets.

    ``contains`` holds for every key that was added and for a few others, which
    an exact table must tell apart.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def empty(cls, buckets: int = BUCKETS) -> Cuckoo:
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def write(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of rows of two uint64."""
        fp = np.maximum((keys[:, 1] >> np.uint64(48)).astype(np.uint16), 1)
        first = (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (_spread(fp) & (len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(1)

    def _settle(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; those that found none."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        rank = np.arange(len(order)) - np.searchsorted(bucket, bucket)
        free = self.table[bucket] == 0
        ok = rank < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(order)), np.minimum(rank, SLOTS - 1)]
        self.table[bucket[ok], slot[ok]] = fp[order[ok]]
        return order[~ok]

    def add(self, keys: np.ndarray) -> bool:
        """Add keys that aren't in; false if the filter is too full, when it must be built anew."""
        fp, at, other = self._places(keys)
        left = self._settle(fp, at)
        fp, at = fp[left], other[left]
        for kick in range(KICKS):
            left = self._settle(fp, at)
            if not len(left):
                return True
            fp, at = fp[left], at[left]
            # one fingerprint a bucket takes the place of another, which goes to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = (kick + np.arange(len(one))) % SLOTS
            bucket = at[one]
            out = self.table[bucket, slot].copy()
            self.table[bucket, slot] = fp[one]
            fp[one], at[one] = out, self._other(bucket, out)
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that were added."""
        for fp, a, b in zip(*self._places(keys), strict=True):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == fp)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
