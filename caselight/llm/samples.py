"""Which documents a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 4; NULL for a NULL key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def held_out(key: str) -> Column:
    """Rows no model has learned from: fold 2. A row without a key is not one of
    them, but is not learned from either."""
    return F.coalesce(fold(key) == 2, F.lit(False))


def learnable(df: DataFrame, key: str) -> DataFrame:
    return df.where(fold(key) != 2)


def about(df: DataFrame, key: str, share: Column) -> DataFrame:
    """A share of the rows (0 to 1), the same ones for any layout."""
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
