"""Column selection, appending, first and last rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def select_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Keep columns by 0-based position, in the order given."""
    return df.select([_quoted(df.columns[i]) for i in positions])


def feature_subset(names: Sequence[str], positions: Sequence[int] = ()) -> list[str]:
    """Feature names at the given 0-based positions; all of them when none are given."""
    return [names[i] for i in positions] if positions else list(names)


def split_label(df: DataFrame, label: str) -> tuple[list[str], str]:
    """Feature names and the label name. Both stay columns of the one frame,
    since rows have no position to match them up again by."""
    if label not in df.columns:
        raise ValueError(f"no column {label}")
    return [c for c in df.columns if c != label], label


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop named columns; a name that is not there is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Append tables by column name. Copies stay; differing columns are an error."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def first_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def last_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(n)
