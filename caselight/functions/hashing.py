"""Seeded, repeatable randomness from row keys.

Every draw is a function of (key, seed) alone, so a retried task, another
partitioning or another cluster gives the same rows. MD5 is used because any
SQL engine can recompute it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 12  # 48 bits: exact in a double


def seeded_hash(seed: int, *parts: Column | str) -> Column:
    """32 hex digits of ``part:part:...:seed``."""
    pieces = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *pieces, F.lit(str(seed))).cast("binary"))


def _digits(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, _HEX_DIGITS), 16, 10).cast("bigint")


def unit_draw(digest: Column, start: int = 1) -> Column:
    """A number in [0, 1) from 12 hex digits of a hash."""
    return _digits(digest, start).cast("double") / F.lit(float(16**_HEX_DIGITS))


def int_draw(digest: Column, bound: Column | int, start: int = 1) -> Column:
    """A whole number in [0, bound) from 12 hex digits of a hash."""
    bound = F.lit(bound) if isinstance(bound, int) else bound
    return F.pmod(_digits(digest, start), bound.cast("bigint"))


def prefix_digits(partitions: int) -> int:
    """How many leading hash digits split rows into several blocks per partition."""
    return max(2, math.ceil(math.log(4 * max(1, partitions), 16)))
