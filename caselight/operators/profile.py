"""Counts, shares, column statistics and standardising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns")
    )


def _counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Occurrences of each value, most frequent first; NULL is not counted."""
    return _counts(df, column).orderBy(F.desc("count"), column)


def class_share(df: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with each value's share of all counted rows."""
    counts = _counts(df, column)
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total).orderBy(F.desc("count"), column)


def _number(name: str) -> Column:
    """A feature as double, with NaN taken as missing."""
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


def _tall(wide: DataFrame, columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn one row of ``<stat>_<i>`` columns into one row per feature."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), *[F.col(f"{s}_{i}").alias(s) for s in stats]
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def describe_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean and sample variance of every column, in one pass."""
    wide = df.agg(
        *[
            f(_number(c)).alias(f"{name}_{i}")
            for i, c in enumerate(columns)
            for name, f in (("count", F.count), ("mean", F.avg), ("variance", F.var_samp))
        ]
    )
    return _tall(wide, columns, ["count", "mean", "variance"])


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of every column; a constant
    column gets 1, so that scaling it gives 0."""
    wide = df.agg(
        *[
            f(_number(c)).alias(f"{name}_{i}")
            for i, c in enumerate(columns)
            for name, f in (("mean", F.avg), ("sd", F.stddev_pop))
        ]
    )
    stats = _tall(wide, columns, ["mean", "sd"])
    return stats.withColumn("sd", F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")))


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Replace each column named in ``stats`` by (x - mean) / sd.

    ``stats`` has one row per feature column and enters the projection as
    literals, so scaling adds no join.
    """
    known = {r["feature"]: r for r in stats.collect()}
    return df.select(
        *[
            ((_number(c) - F.lit(known[c]["mean"])) / F.lit(known[c]["sd"])).alias(c)
            if c in known
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
