"""Gene symbols -> disease enrichment and the data behind its charts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from caselight.operators.enrichment import (
    enrich,
    map_ids,
    set_readable,
    term_gene_edges,
    top_terms,
    unmapped_ids,
)
from caselight.storage import written

# Genes looked up, and terms shown in bars and networks.
SAMPLE_GENES = ("CD247", "TNFRSF9")
BAR_TERMS, WIDE_TERMS, ROUND_TERMS, DEFAULT_TERMS = 35, 35, 30, 5


@dataclass
class GeneReport:
    unmapped: DataFrame
    enrichment: DataFrame
    readable: DataFrame
    bars: DataFrame
    edges: DataFrame
    nodes: DataFrame


def gene_report(
    genes: DataFrame,
    gene_map: DataFrame,
    gene_sets: DataFrame,
    shown: int = DEFAULT_TERMS,
    size_by: str = "count",
    **cuts: float,
) -> GeneReport:
    """``genes(symbol)``, ``gene_map(symbol, entrez_id)``,
    ``gene_sets(term_id, description, gene_id)``."""
    ids = map_ids(genes, gene_map, "symbol", "entrez_id").selectExpr("entrez_id as gene_id")
    table = written(enrich(ids, gene_sets, **cuts), "enriched")
    readable = set_readable(table, gene_map)
    edges, nodes = term_gene_edges(readable, shown, size_by)
    return GeneReport(
        unmapped=unmapped_ids(genes, gene_map, "symbol"),
        enrichment=table,
        readable=readable,
        bars=top_terms(table, BAR_TERMS).select("term_id", "description", "count", "p_adjust"),
        edges=edges,
        nodes=nodes,
    )
