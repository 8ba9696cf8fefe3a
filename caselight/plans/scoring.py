"""Pair files -> signal scores -> CSV, and the prior fitted to the same pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from caselight.operators.columns import rename_positional, union_tables
from caselight.operators.prior import fit_prior, squash
from caselight.operators.signals import THETA_INIT, Theta, disproportionality, signal_scores
from caselight.sources.tables import read_table, write_scores
from caselight.storage import scoped, written

# Column names of a pair table, in order.
PAIR_COLUMNS = ("id", "var1", "study_drug", "var2")


def pair_table(tables: Sequence[DataFrame]) -> DataFrame:
    """Append pair tables of one shape and name their columns."""
    return rename_positional(union_tables(tables), PAIR_COLUMNS)


def read_pairs(
    spark: SparkSession, paths: Sequence[str], schema: StructType | str, fmt: str = "csv"
) -> DataFrame:
    return pair_table([read_table(spark, p, fmt, schema) for p in paths])


def thin_pairs(pairs: DataFrame) -> DataFrame:
    """Count pairs, then thin those seen once and those seen twice."""
    counted = disproportionality(pairs)
    return squash(squash(counted), count=2, bin_size=10)


def prior_of(pairs: DataFrame, theta_init: Theta = THETA_INIT) -> DataFrame:
    """The prior that fits the thinned pairs; reported only, scores use
    ``theta_init`` unless told otherwise."""
    with scoped(pairs.sparkSession):
        return fit_prior(written(thin_pairs(pairs), "thinned"), theta_init)


def score_pairs(
    pairs: DataFrame, path: str, theta: Theta = THETA_INIT, row_id: bool = False
) -> DataFrame:
    """Score and write as CSV; returns what was written. No table of the stages
    between is left."""
    spark = pairs.sparkSession
    with scoped(spark):
        scores = written(signal_scores(pairs, theta), "scores")
        write_scores(scores, path, row_id)
    first = [StructField("row_id", LongType())] if row_id else []
    return read_table(spark, path, "csv", StructType([*first, *scores.schema.fields]))
