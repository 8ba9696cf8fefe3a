"""From raw documents to token digests of the clean ones, in five stages.

Each stage takes what its predecessor kept, whole, as a table that was written
and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from caselight.llm.queries import VOCABULARY, table
from caselight.storage import delete, scoped, scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the folds it may see, does
    not call toxic."""
    model = toxicity.Model.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = line_dedup.fresh(docs, "score", "predicted")
    scored = toxicity.score(docs, model, out=score, predicted=predicted)
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each passage of lines where it stands first only."""
    return line_dedup.line_dedup(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of fingerprints, that of least doc_id."""
    return simhash.representatives(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with number of tokens, and digests of ids and of the decoded text."""
    return bpe.digests(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", one_of_each),
    ("decontamination", without_test_items),
    ("bpe", token_digests),
]

# Neither the classifier nor the tokenizer is SQL; tests/llm compares the stages
# with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage writes on its way is
    deleted when its result is stored, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scoped(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
