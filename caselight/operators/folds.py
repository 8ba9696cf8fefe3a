"""Stratified folds and what is reported about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.operators.ordering import hash_index


def stratified_folds(
    df: DataFrame, label: str, k: int, seed: int, key: str, fold: str = "fold"
) -> DataFrame:
    """Add ``fold`` in 0..k-1, dealt round-robin over rows ordered by class and
    then by seeded hash of ``key``. Sizes differ by at most one, in total and
    within each class."""
    if k < 2:
        raise ValueError("k must be at least 2")
    index = "_index"
    numbered = hash_index(df.drop(fold), label, key, seed, index, across_groups=True)
    return numbered.withColumn(fold, (F.col(index) % k).cast("int")).drop(index)


def fold_split(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validation) for fold ``k``."""
    return df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)


def split_report(df: DataFrame, k: int, label: str, fold: str = "fold") -> DataFrame:
    """Rows, share of all rows and positive rate of both sides of fold ``k``."""
    sides = (
        df.withColumn("side", F.when(F.col(fold) == k, "valid").otherwise("train"))
        .groupBy("side")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg((F.col(label) == 1).cast("double")).alias("positive_rate"),
        )
    )
    total = sides.agg(F.sum("rows")).scalar()
    return sides.select("side", "rows", (F.col("rows") / total).alias("share"), "positive_rate")
