"""Counter-based randomness: a draw depends on its key only, so results hold at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, purpose: str, *keys) -> Column:
    """Lower-case hex MD5 of ``seed:purpose:key...``."""
    parts = [F.lit(f"{seed}:{purpose}"), *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def as_integer(h: Column) -> Column:
    """The first 32 bits of a draw."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def coin(h: Column) -> Column:
    """A fair coin from a draw."""
    return F.substring(h, 1, 1) < "8"
