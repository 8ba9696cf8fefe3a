"""Gene over-representation: which terms share more genes with a list than chance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from caselight.functions.special import ln_hypergeom
from caselight.operators.ordering import running
from caselight.storage import written

_LAMBDA = 0.05  # p-values from here on estimate the share of true nulls


def map_ids(df: DataFrame, id_map: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target`` from ``id_map``. A row without a match is dropped; one
    with several is repeated."""
    pairs = id_map.select(source, target).dropna().distinct()
    return df.join(pairs, source)


def unmapped_ids(df: DataFrame, id_map: DataFrame, source: str) -> DataFrame:
    """The rows ``map_ids`` drops."""
    known = id_map.filter(F.col(source).isNotNull()).select(source)
    return df.join(known, source, "left_anti")


def _tail_terms(k: np.ndarray, big_m: np.ndarray, big_n: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The tail that leads away from the mean, in units of its largest term; all
    rows go on side by side, each until a term no longer counts."""
    share = big_m / big_n
    spread = np.sqrt(n * share * (1 - share) * (big_n - n) / np.maximum(big_n - 1, 1))
    up = k > n * share
    x = np.where(up, k, k - 1)
    last = np.minimum(np.where(up, np.minimum(n, big_m) - k, k - 1), np.ceil(9 * spread) + 60)
    rest = big_n - big_m - n
    out = np.zeros(len(k))
    rows, term, total, i = np.arange(len(k)), np.ones(len(k)), np.zeros(len(k)), 0
    while len(rows):
        total = total + np.where(i <= last, term, 0)
        more = np.where(up, (big_m - x) * (n - x), x * (rest + x))
        term = term * more / np.where(up, (x + 1) * (rest + x + 1), (big_m - x + 1) * (n - x + 1))
        x = np.where(up, x + 1, x - 1)
        i += 1
        if i % 32 == 0 or i > last.max():
            # Terms fall, so those behind one that is lost in rounding are too.
            left = (i <= last) & (term > total * 1e-17)
            out[rows[~left]] = total[~left]
            rows, term, total, x, last, up, rest, big_m, n = (
                v[left] for v in (rows, term, total, x, last, up, rest, big_m, n)
            )
    return out


@F.pandas_udf(DoubleType())
def _tail(k: pd.Series, big_m: pd.Series, big_n: pd.Series, n: pd.Series) -> pd.Series:
    rows = np.column_stack([v.to_numpy(float) for v in (k, big_m, big_n, n)])
    k, big_m, big_n, n = rows.T
    asked = (k <= np.minimum(n, big_m)) & (k > np.maximum(0, n + big_m - big_n))
    distinct, back = np.unique(rows[asked], axis=0, return_inverse=True)
    out = np.full(len(rows), np.nan)
    out[asked] = _tail_terms(*distinct.T.copy())[back.ravel()]
    return pd.Series(out)


def hypergeom_sf(k: str, big_m: str, big_n: str, n: str) -> Column:
    """P(X >= k) where X marked items are among n drawn from big_n that hold
    big_m marked ones. Above the largest possible number it is 0, at the smallest
    and below it 1; NULL for a NULL.

    The tail that leads away from the mean is summed, from its largest term on,
    each term from the one before. X is a sum of independent trials, so past nine
    standard deviations and sixty terms less than 1e-17 of it is left; a row costs
    that many terms, however large the numbers are. As they may be thousands, they
    are summed for all rows of an Arrow batch at a time.
    """
    missing = " or ".join(f"{x} is null" for x in (k, big_m, big_n, n))
    terms = _tail(*[F.expr(f"cast({x} as double)") for x in (k, big_m, big_n, n)])
    upper = F.expr(f"exp({ln_hypergeom(k, big_m, big_n, n)})") * terms
    lower = F.expr(f"exp({ln_hypergeom(f'{k} - 1', big_m, big_n, n)})") * terms
    return (
        F.when(F.expr(missing), None)
        .when(F.expr(f"{k} > least({n}, {big_m})"), 0.0)
        .when(F.expr(f"{k} <= greatest(0, {n} + {big_m} - {big_n})"), 1.0)
        .when(
            F.expr(f"{k} > cast({n} as double) * (cast({big_m} as double) / cast({big_n} as double))"),
            F.least(upper, F.lit(1.0)),
        )
        .otherwise(F.greatest(1 - lower, F.lit(0.0)))
    )


def bh_adjust(df: DataFrame, pvalue: str, name: str = "p_adjust") -> DataFrame:
    """Add Benjamini-Hochberg adjusted p-values.

    Equal p-values get equal results, so the work is on distinct values: their
    ranks are running counts and the adjustment is a running minimum from the
    largest p down. A NULL p stays NULL and is not counted.
    """
    value, n = "_p", "_n"
    # Written once: the total, the block borders and both passes read it.
    counts = written(
        df.filter(F.col(pvalue).isNotNull())
        .groupBy(F.col(pvalue).alias(value))
        .agg(F.count(F.lit(1)).alias(n)),
        "p-value-counts",
    )
    total = counts.agg(F.sum(n)).scalar()
    raw = running(counts, value, sums=[n], keep_blocks=True).withColumn(
        "_raw", F.col(value) * total / F.col(f"running_sum_{n}")
    )
    adjusted = running(raw, value, mins=["_raw"], descending=True).select(
        value, F.col("running_min__raw").alias(name)
    )
    return df.join(adjusted, F.col(pvalue) == F.col(value), "left").drop(value)


def q_value(
    df: DataFrame, pvalue: str, adjusted: str = "p_adjust", name: str = "q_value"
) -> DataFrame:
    """Add q-values: the adjusted p times the share of true nulls, estimated
    from the p-values of ``_LAMBDA`` and more. NULL when that share is zero."""
    share = df.agg(
        F.least(F.lit(1.0), F.avg((F.col(pvalue) >= _LAMBDA).cast("double")) / (1 - _LAMBDA))
    ).scalar()
    return df.withColumn(
        name, F.when(share > 0, F.col(adjusted) * share)
    )


def enrich(
    genes: DataFrame,
    gene_sets: DataFrame,
    p_cut: float = 0.05,
    q_cut: float = 0.2,
    min_size: int = 10,
    max_size: int = 500,
) -> DataFrame:
    """Over-representation table of a gene list (``gene_id``) against
    ``gene_sets(term_id, description, gene_id)``.

    The background is every gene in any set. Terms of ``min_size`` to
    ``max_size`` genes that share at least one gene with the list are tested,
    and only these enter the adjustment. Gene lists are gathered for terms that
    pass, so no list is longer than ``max_size``.
    """
    members = written(
        gene_sets.select("term_id", "description", "gene_id")
        .dropna(subset=["term_id", "gene_id"])
        .groupBy("term_id", "gene_id")
        .agg(F.min("description").alias("description")),
        "gene-sets",
    )
    query = genes.select("gene_id").dropna().distinct()
    hits = written(
        members.select("term_id", "gene_id").join(query, "gene_id", "left_semi"), "hits"
    )
    background = members.agg(F.count_distinct("gene_id")).scalar()
    drawn = hits.agg(F.count_distinct("gene_id")).scalar()
    sizes = (
        members.groupBy("term_id")
        .agg(F.count(F.lit(1)).alias("big_m"), F.min("description").alias("description"))
        .filter(F.col("big_m").between(min_size, max_size))
    )
    overlap = hits.groupBy("term_id").agg(F.count(F.lit(1)).alias("k"))
    tested = written(
        overlap.join(sizes, "term_id")
        .select("*", drawn.alias("n"), background.alias("big_n"))
        .withColumn("pvalue", hypergeom_sf("k", "big_m", "big_n", "n")),
        "enrichment",
    )
    scored = q_value(bh_adjust(tested, "pvalue"), "pvalue")
    passing = scored.filter(
        (F.col("pvalue") <= p_cut)
        & (F.col("p_adjust") <= p_cut)
        & (F.col("q_value").isNull() | (F.col("q_value") <= q_cut))
    )
    table = F.struct(*[c for c in passing.columns if c != "term_id"])
    return (
        hits.join(passing.select("term_id", table.alias("t")), "term_id")
        .groupBy("term_id")
        .agg(F.first("t").alias("t"), F.sort_array(F.collect_list("gene_id")).alias("genes"))
        .select("term_id", "t.*", "genes")
        .select(
            "term_id", "description",
            F.concat_ws("/", "k", "n").alias("gene_ratio"),
            F.concat_ws("/", "big_m", "big_n").alias("bg_ratio"),
            "k", "n", "big_m", "big_n", "pvalue", "p_adjust", "q_value", "genes",
            F.col("k").alias("count"),
        )
    )


def export_genes(enriched: DataFrame) -> DataFrame:
    """The gene list as one slash-joined text, for files without arrays."""
    return enriched.withColumn("genes", F.concat_ws("/", "genes"))


def set_readable(
    enriched: DataFrame, gene_map: DataFrame, source: str = "entrez_id", target: str = "symbol"
) -> DataFrame:
    """Put names for ids inside each term's gene list, in place and order.
    An id without a name stays; one with several gets the first by name."""
    names = (
        gene_map.dropna(subset=[source, target])
        .groupBy(F.col(source).alias("_gene"))
        .agg(F.min(target).alias("_name"))
    )
    others = [c for c in enriched.columns if c not in ("term_id", "genes")]
    return (
        enriched.select("term_id", *others, F.posexplode_outer("genes").alias("_at", "_gene"))
        .join(names, "_gene", "left")
        .groupBy("term_id")
        .agg(
            *[F.first(c).alias(c) for c in others],
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("_gene").isNotNull(),
                        F.struct("_at", F.coalesce("_name", F.col("_gene").cast("string")).alias("name")),
                    )
                )
            ).alias("_named"),
        )
        .withColumn("genes", F.col("_named.name"))
        .select(*enriched.columns)
    )


def top_terms(enriched: DataFrame, k: int) -> DataFrame:
    """The k terms with the smallest p-values."""
    return enriched.orderBy("pvalue", "term_id").limit(k)


def term_gene_edges(
    enriched: DataFrame, k: int = 5, size_by: str = "count"
) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the gene-term network of the top k terms.

    A term's size is its gene count or its p-value, a gene's the number of
    shown terms it is in.
    """
    if size_by not in ("count", "pvalue"):
        raise ValueError("size_by is 'count' or 'pvalue'")
    shown = top_terms(enriched, k)
    edges = shown.select("term_id", F.explode("genes").alias("gene_id"))
    terms = shown.select(
        F.col("term_id").cast("string").alias("node_id"),
        F.lit("term").alias("kind"),
        F.col(size_by).cast("double").alias("size"),
    )
    genes = (
        edges.groupBy(F.col("gene_id").cast("string").alias("node_id"))
        .agg(F.count(F.lit(1)).cast("double").alias("size"))
        .select("node_id", F.lit("gene").alias("kind"), "size")
    )
    return edges, terms.unionByName(genes)
