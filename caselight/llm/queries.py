"""One query per corpus operator, over its whole table, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import (
    bpe,
    collocations,
    conversation_trie,
    decontaminate,
    html_text,
    language_id,
    line_dedup,
    quality,
    samples,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from caselight.storage import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# The rules that pages are judged by.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of lines that an earlier place has."""
    cleaned = line_dedup.line_dedup(table(spark, sf_dir, "documents"), removed="n_removed")
    return cleaned.select(
        "doc_id", "n_removed", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.Model.fit(docs)
    asked = docs.select("doc_id", "text", samples.held_out("doc_id").alias("held_out"))
    return language_id.identify(asked, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.Model.fit(docs, table(spark, sf_dir, "labels"))
    asked = docs.select("doc_id", "text", samples.held_out("doc_id").alias("held_out"))
    return toxicity.score(asked, model).select("doc_id", "held_out", "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds to four fifths or more."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of line-first cleaning."""
    return quality.measures(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block or allow for every page, shared among equivalent urls."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match pieces of every document's text."""
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)
    return counted.select("doc_id", "n_pieces")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without strings of 200 bytes that start elsewhere too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.without_repeats(docs)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words meet most above their parts."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    turns = written(conversation_trie.turns_of(table(spark, sf_dir, "conversations")), "turns")
    return conversation_trie.trie(*conversation_trie.rebuilt(turns))


OPERATORS = (
    op1_line_dedup,
    op2_language_id,
    op3_bpe,
    op4_toxicity,
    op5_decontaminate,
    op6_simhash,
    op7_quality,
    op8_url_filter,
    op9_html_text,
    op10_token_counts,
    op11_suffix_dedup,
    op12_collocations,
    op13_conversation_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}
