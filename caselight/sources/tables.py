"""Tables in and out: CSV or Parquet inputs, Parquet tables, CSV scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caselight.operators.ordering import row_index


def read_tables(
    spark: SparkSession,
    paths: Sequence[str],
    schema: StructType | str,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read files of one shape as one table. The schema is declared, never inferred."""
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.options(**options).load(list(paths))


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: StructType | str,
    **options: str,
) -> DataFrame:
    return read_tables(spark, [path], schema, fmt, **options)


def genes_df(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    """A literal gene list as a one-column table."""
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def table_path(base: str, name: str) -> str:
    """``main.demo`` -> ``<base>/main_demo``: the library name becomes a prefix,
    so tables of two libraries never clash in one folder."""
    return f"{base.rstrip('/')}/{name.replace('.', '_')}"


def write_table(df: DataFrame, base: str, name: str, mode: str = "errorifexists") -> str:
    path = table_path(base, name)
    df.write.mode(mode).parquet(path)
    return path


def read_saved(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(base, name))


def write_scores(
    df: DataFrame,
    path: str,
    row_id: bool = False,
    order_by: Sequence[str] = ("var1", "var2"),
    mode: str = "errorifexists",
) -> None:
    """Write a score table as CSV with a header.

    ``row_id=True`` puts a leading column 1..n in the given order, as a row-name
    column would be.
    """
    if row_id:
        df = row_index(df, [F.col(c) for c in order_by], "row_id").select(
            (F.col("row_id") + 1).alias("row_id"), *df.columns
        )
    df.write.mode(mode).option("header", True).csv(path)
