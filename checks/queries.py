"""One query per operator, each over whole driver tables."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.operators import (
    boosting,
    columns,
    enrichment,
    folds,
    metrics,
    neighbors,
    neural,
    ordering,
    prior,
    profile,
    signals,
)
from caselight.operators.smote import smote
from caselight.plans import classify, scoring
from caselight.plans.classify import FOLD_SEED
from caselight.plans.loading import load_extracts
from caselight.sources import tables
from caselight.sources.fixed_width import (
    CUT,
    ERROR,
    load_report,
    parse_fixed_width,
    read_fixed_width,
)
from caselight.sources.layouts import LAYOUTS, make_layout
from caselight.storage import scratch_path, written
from checks import loads

THETAS = (
    signals.THETA_INIT,
    signals.Theta(1.0, 1.0, 1.0, 2.0, 0.5),
    signals.Theta(0.5, 0.25, 3.0, 2.0, 0.1),
)
EMBEDDED = [f"f{i}" for i in range(64)]
FIVE = [EMBEDDED[i] for i in neural.SUBSETS[0]]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- inputs shared by several queries ---------------------------------------


def brand_type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair table: orders as reports, part brand and part type as variables."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("id"),
        F.col("p_brand").alias("var1"),
        F.col("p_name").alias("study_drug"),
        F.col("p_type").alias("var2"),
    )


def part_supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_partkey").alias("var1"),
        F.col("l_suppkey").alias("var2"),
    )


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(scoring.thin_pairs(part_supplier_pairs(spark, sf_dir)), "thinned")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose score is a function of text length."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id").selectExpr(
        "doc_id",
        "label",
        "n_chars / (n_chars + 1000) as score",
        "cast(n_chars / (n_chars + 1000) >= 0.5 as int) as prediction",
    )


def _vectors(spark: SparkSession, sf_dir: str, names=EMBEDDED) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") == 0).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)],
    )


GENE_TERMS = (
    "concat('brand:', p_brand)",
    "concat('type:', p_type)",
    "concat('size:', cast(p_size as string))",
    "concat('name:', p_name)",
    "concat('brand-size:', p_brand, ':', cast(p_size as string))",
)


def _gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by what they have in common."""
    terms = _table(spark, sf_dir, "part").selectExpr(
        f"explode(array({', '.join(GENE_TERMS)})) as term_id", "p_partkey as gene_id"
    )
    return terms.selectExpr("term_id", "concat('parts of ', term_id) as description", "gene_id")


def _listed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the first type, and of one brand."""
    parts = _table(spark, sf_dir, "part")
    first = parts.agg(F.min("p_type")).scalar()
    chosen = parts.filter((F.col("p_type") == first) | (F.col("p_brand") == "Brand#13"))
    return chosen.select(F.col("p_partkey").alias("gene_id"))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(
        enrichment.enrich(_listed_genes(spark, sf_dir), _gene_sets(spark, sf_dir)), "enriched"
    )


def _flat(enriched: DataFrame) -> DataFrame:
    return _rounded(enrichment.export_genes(enriched), 9, "pvalue", "p_adjust", "q_value")


def _gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey as entrez_id", "concat(p_name, ' ', p_partkey) as symbol"
    )


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "round(o_totalprice / (o_totalprice + 3000000), 4) as pvalue"
    )


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- fixed-width -------------------------------------------------------------

_ORDER_LAYOUT = make_layout("check.orders", "orders.txt", "key:11# customer:11# status:1 day:8 note:16")
_ORDER_RECORD = """concat(lpad({key}, 11, ' '), lpad(string(o_custkey), 11, ' '),
    o_orderstatus, replace(substr(string(o_orderdate), 1, 10), '-', ''), {note})"""


def _order_records(spark, sf_dir, key="string(o_orderkey)", note="rpad(o_orderpriority, 16, ' ')"):
    record = _ORDER_RECORD.format(key=key, note=note)
    return _table(spark, sf_dir, "orders").select(F.expr(record).alias("value"))


def fixed_width_parse(spark, sf_dir):
    return parse_fixed_width(_order_records(spark, sf_dir), _ORDER_LAYOUT).drop(ERROR, CUT)


def fixed_width_errors(spark, sf_dir):
    bad = "if(o_orderstatus = 'P', concat(o_orderkey, 'x'), string(o_orderkey))"
    records = _order_records(spark, sf_dir, key=bad)
    return load_report(parse_fixed_width(records, _ORDER_LAYOUT), "orders")


def fixed_width_short_missing(spark, sf_dir):
    records = _order_records(spark, sf_dir, note="o_orderpriority")
    return parse_fixed_width(records, _ORDER_LAYOUT, "missing")


def fixed_width_short_truncate(spark, sf_dir):
    records = _order_records(spark, sf_dir, note="o_orderpriority")
    return parse_fixed_width(records, _ORDER_LAYOUT, "truncate")


def fixed_width_latin1(spark, sf_dir):
    """Two-byte letters count as two positions when the bytes are Latin-1."""
    path = scratch_path(spark, "latin1")
    text = "concat(rpad(concat('é', p_brand), 11, ' '), rpad(p_type, 12, ' '))"
    _table(spark, sf_dir, "part").select(F.expr(text).alias("value")).write.text(path)
    layout = make_layout("check.part", "part.txt", "brand:12 type:12")
    return read_fixed_width(spark, path, layout, charset="ISO-8859-1").drop(ERROR, CUT)


def load_extracts_report(spark, sf_dir):
    """The whole load of all 41 tables: parse, store, count."""
    folder = scratch_path(spark, "extracts")
    for layout in LAYOUTS.values():
        library = layout.table.split(".")[0]
        source = _table(spark, sf_dir, loads.source_of(layout))
        record = loads.record_sql(layout)
        loads.write_lines(source.select(F.expr(record).alias("value")), f"{folder}/{library}/{layout.file}")
    folders = {library: f"{folder}/{library}" for library in ("main", "sub", "who")}
    return load_extracts(spark, folders, scratch_path(spark, "loaded"), list(LAYOUTS.values()))


# --- other sources and sinks --------------------------------------------------


def read_table_csv(spark, sf_dir):
    path = scratch_path(spark, "part-csv")
    part = _table(spark, sf_dir, "part")
    part.write.option("header", True).csv(path)
    return tables.read_table(spark, path, "csv", part.schema)


def _six_parts(lines: DataFrame) -> list[DataFrame]:
    """Lines by return flag and status: six tables that make up the whole."""
    return [
        lines.filter((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status))
        for flag in ("A", "N", "R")
        for status in ("F", "O")
    ]


def read_tables_six(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    paths = []
    for part in _six_parts(lines):
        paths.append(scratch_path(spark, "pairs"))
        part.write.parquet(paths[-1])
    return tables.read_tables(spark, paths, lines.schema)


def write_table_round_trip(spark, sf_dir):
    base = scratch_path(spark, "library")
    tables.write_table(_table(spark, sf_dir, "supplier"), base, "main.supplier")
    return tables.read_saved(spark, base, "main.supplier")


def write_scores_row_id(spark, sf_dir):
    path = scratch_path(spark, "scores")
    pairs = signals.disproportionality(brand_type_pairs(spark, sf_dir))
    tables.write_scores(pairs.select("var1", "var2", "N"), path, row_id=True)
    return tables.read_table(spark, path, "csv", "row_id bigint, var1 string, var2 string, N bigint")


def genes_literal(spark, sf_dir):
    """A literal list looked up in a driver table."""
    brands = tables.genes_df(spark, ["Brand#1", "Brand#2"])
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return enrichment.map_ids(
        brands, parts.selectExpr("p_brand as symbol", "p_partkey as entrez_id"), "symbol", "entrez_id"
    )


# --- columns and rows -----------------------------------------------------------


def select_positions(spark, sf_dir):
    return columns.select_positions(_table(spark, sf_dir, "part"), [0, 2, 3, 5])


def drop_columns(spark, sf_dir):
    return columns.drop_columns(_table(spark, sf_dir, "part"), ["p_name", "p_retailprice"])


def split_label(spark, sf_dir):
    df = _table(spark, sf_dir, "labels")
    names, label = columns.split_label(df, "quality")
    return df.select(*names, F.col(label).alias("label"))


def feature_subset(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    names = columns.feature_subset(df.columns, [4, 5, 7])
    return _rounded(df.select("l_orderkey", *names), 4, *names)


def union_rename(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey", "l_linestatus"
    )
    parts = [p.drop("l_linestatus") for p in _six_parts(lines)]
    return columns.rename_positional(columns.union_tables(parts), scoring.PAIR_COLUMNS)


def first_n(spark, sf_dir):
    return columns.first_n(_table(spark, sf_dir, "orders"), 5, ["o_orderkey"])


def last_n(spark, sf_dir):
    return columns.last_n(_table(spark, sf_dir, "orders"), 2, ["o_orderkey"])


def dense_row_id(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.row_index(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], "row_id")


def running_sum(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n")
    )
    return ordering.running(counts, "l_quantity", sums=["n"])


def running_min_backwards(spark, sf_dir):
    least = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("least")
    )
    keyed = least.withColumn("customer", F.col("o_custkey").cast("double"))
    return ordering.running(keyed, "customer", mins=["least"], descending=True)


# --- profile ---------------------------------------------------------------------


def shape(spark, sf_dir):
    return profile.shape(_table(spark, sf_dir, "lineitem"))


def value_counts(spark, sf_dir):
    return profile.value_counts(_table(spark, sf_dir, "labels"), "quality")


def class_share(spark, sf_dir):
    return _rounded(profile.class_share(_table(spark, sf_dir, "labels"), "quality"), 9, "share")


def describe_features(spark, sf_dir):
    stats = profile.describe_features(_table(spark, sf_dir, "lineitem"), _LINE_NUMBERS)
    return _rounded(stats, 4, "mean", "variance")


def fit_scaler(spark, sf_dir):
    return _rounded(profile.fit_scaler(_table(spark, sf_dir, "lineitem"), _LINE_NUMBERS), 4, "mean", "sd")


def standardize(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_NUMBERS)
    scaled = profile.apply_scaler(lines, profile.fit_scaler(lines, _LINE_NUMBERS))
    return _rounded(scaled, 5, *_LINE_NUMBERS)


# --- folds -----------------------------------------------------------------------


def _folded(spark, sf_dir, k=4):
    return folds.stratified_folds(
        _table(spark, sf_dir, "labels"), "quality", k, FOLD_SEED, "doc_id"
    )


def stratified_folds(spark, sf_dir):
    return _folded(spark, sf_dir)


def stratified_folds_five(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return folds.stratified_folds(orders, "o_orderstatus", 5, FOLD_SEED, "o_orderkey")


def fold_split_train(spark, sf_dir):
    return folds.fold_split(_folded(spark, sf_dir), 0)[0]


def fold_split_valid(spark, sf_dir):
    return folds.fold_split(_folded(spark, sf_dir), 0)[1]


def split_report(spark, sf_dir):
    report = folds.split_report(_folded(spark, sf_dir), 0, "quality")
    return _rounded(report, 9, "share", "positive_rate")


# --- signals -----------------------------------------------------------------------


def disproportionality(spark, sf_dir):
    return _rounded(signals.disproportionality(brand_type_pairs(spark, sf_dir)), 6, "E")


def disproportionality_parts(spark, sf_dir):
    pairs = signals.disproportionality(part_supplier_pairs(spark, sf_dir), digits=6)
    return _rounded(pairs, 9, "E")


def mixture_weight(spark, sf_dir):
    pairs = signals.disproportionality(brand_type_pairs(spark, sf_dir))
    return _rounded(signals.mixture_weight(pairs).select("var1", "var2", "qn"), 6, "qn")


def ebgm(spark, sf_dir):
    pairs = signals.disproportionality(brand_type_pairs(spark, sf_dir))
    return signals.ebgm(pairs, digits=4).select("var1", "var2", "EBGM")


def posterior_quantile(spark, sf_dir):
    pairs = signals.disproportionality(brand_type_pairs(spark, sf_dir))
    median = signals.posterior_quantile(pairs, signals.THETA_INIT, 50.0, "median", digits=4)
    return median.select("var1", "var2", "median")


def signal_scores(spark, sf_dir):
    return _rounded(signals.signal_scores(brand_type_pairs(spark, sf_dir)), 6, "E")


def squash_once(spark, sf_dir):
    pairs = signals.disproportionality(part_supplier_pairs(spark, sf_dir))
    return _rounded(prior.squash(pairs), 9, "E")


def squash(spark, sf_dir):
    return _rounded(_thinned(spark, sf_dir), 9, "E")


def neg_log_lik(spark, sf_dir):
    found = prior.neg_log_lik(_thinned(spark, sf_dir), THETAS)
    return _rounded(found, 4, "neg_log_lik").select("theta_id", "neg_log_lik")


def _word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair table: documents as reports, where a text is from, and its words."""
    return _table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id",
        "concat(source, '/', lang) as var1",
        "explode(filter(split(text, '[ \\n]+'), w -> w <> '')) as var2",
    )


def _thinned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(scoring.thin_pairs(_word_pairs(spark, sf_dir)), "thinned")


def prior_slopes(spark, sf_dir):
    """Value and slopes of the likelihood at the starting prior."""
    told = prior.slopes(_thinned(spark, sf_dir), signals.THETA_INIT)
    told = _rounded(told, 4, "value")
    return _rounded(told, 1, *[f"slope_{i}" for i in range(5)]).select("value", *[f"slope_{i}" for i in range(5)])


def fit_prior(spark, sf_dir):
    """The start value, which SQL can say, and that the fit has settled lower, in range."""
    thinned = _thinned_words(spark, sf_dir)
    start = prior.neg_log_lik(thinned, [signals.THETA_INIT]).select("neg_log_lik").scalar()
    fitted = prior.fit_prior(thinned)
    return fitted.select(
        F.round(start, 4).alias("start"),
        (F.col("neg_log_lik") < start).alias("lower"),
        (F.col("converged") & (F.col("gradient") <= 1e-6)).alias("settled"),
        F.expr("least(alpha1, beta1, alpha2, beta2) > 0 and p > 0 and p < 1").alias("in_range"),
    )


def fit_prior_improves(spark, sf_dir):
    """One optimum from every start: value to 4 digits, for each start."""
    thinned = _thinned_words(spark, sf_dir)
    fits = [prior.fit_prior(thinned, theta).first() for theta in THETAS]
    least = min(f["neg_log_lik"] for f in fits)
    rows = [(i, abs(f["neg_log_lik"] - least) <= 1e-6 * least) for i, f in enumerate(fits)]
    return spark.createDataFrame(rows, "theta_id int, same boolean")


# --- genes ---------------------------------------------------------------------------


def _nations_outside_africa(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").filter("n_regionkey <> 0")
    return nations.selectExpr("n_nationkey as s_nationkey", "n_name")


def map_ids(spark, sf_dir):
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return enrichment.map_ids(
        suppliers, _nations_outside_africa(spark, sf_dir), "s_nationkey", "n_name"
    )


def unmapped_ids(spark, sf_dir):
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return enrichment.unmapped_ids(
        suppliers, _nations_outside_africa(spark, sf_dir), "s_nationkey"
    )


def enrich(spark, sf_dir):
    return _flat(_enriched(spark, sf_dir))


def enrich_all_tested(spark, sf_dir):
    table = enrichment.enrich(
        _listed_genes(spark, sf_dir), _gene_sets(spark, sf_dir), p_cut=1.0, q_cut=1.0
    )
    return _flat(table)


def hypergeom_sf(spark, sf_dir):
    """Chance that a supplier has at least as many lines of status O as it has."""
    lines = _table(spark, sf_dir, "lineitem")
    total = lines.agg(F.count(F.lit(1))).scalar()
    drawn = lines.agg(F.count_if(F.col("l_linestatus") == "O")).scalar()
    per = lines.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("big_m"), F.count_if(F.col("l_linestatus") == "O").alias("k")
    )
    counted = per.select("l_suppkey", "k", "big_m", total.alias("big_n"), drawn.alias("n"))
    tail = enrichment.hypergeom_sf("k", "big_m", "big_n", "n")
    return counted.select("l_suppkey", F.round(tail, 6).alias("pvalue"))


def hypergeom_edges(spark, sf_dir):
    """The tail at, below and above the ends of what is possible, for every part
    as an urn of its size."""
    urns = _table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size as big_n", "p_size div 2 as big_m", "p_size - p_size div 3 as n",
        "explode(array(-1, 0, 1, p_size div 2, p_size div 2 + 1, p_size + 1, null)) as k",
    )
    return urns.withColumn("pvalue", F.round(enrichment.hypergeom_sf("k", "big_m", "big_n", "n"), 9))


def hypergeom_large(spark, sf_dir):
    """Tails of a million marked ones and a million drawn, about the mean."""
    urns = _table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "4000000L as big_n", "1000000L as big_m", "1000000L as n", "250000L + (p_size - 25) * 40 as k"
    )
    tail = enrichment.hypergeom_sf("k", "big_m", "big_n", "n")
    return urns.select("p_partkey", "k", F.round(tail, 6).alias("pvalue"))


def bh_adjust(spark, sf_dir):
    return _rounded(enrichment.bh_adjust(_p_values(spark, sf_dir), "pvalue"), 9, "p_adjust")


def q_value(spark, sf_dir):
    adjusted = enrichment.bh_adjust(_p_values(spark, sf_dir), "pvalue")
    return _rounded(enrichment.q_value(adjusted, "pvalue"), 9, "p_adjust", "q_value")


def set_readable(spark, sf_dir):
    named = enrichment.set_readable(_enriched(spark, sf_dir), _gene_names(spark, sf_dir))
    return enrichment.export_genes(named).select("term_id", "genes")


def top_terms(spark, sf_dir):
    top = enrichment.top_terms(_enriched(spark, sf_dir), 35).select("term_id", "count", "p_adjust")
    return _rounded(top, 9, "p_adjust")


def term_gene_edges(spark, sf_dir):
    return enrichment.term_gene_edges(_enriched(spark, sf_dir), 5)[0]


def term_gene_nodes(spark, sf_dir):
    nodes = enrichment.term_gene_edges(_enriched(spark, sf_dir), 30, "pvalue")[1]
    return _rounded(nodes, 9, "size")


def _enriched_sizes(spark, sf_dir):
    """Terms of a list of all parts of the forty smallest sizes: more terms pass
    than a chart shows."""
    listed = _table(spark, sf_dir, "part").where("p_size <= 40").selectExpr("p_partkey as gene_id")
    return written(enrichment.enrich(listed, _gene_sets(spark, sf_dir)), "enriched")


def top_terms_cut(spark, sf_dir):
    top = enrichment.top_terms(_enriched_sizes(spark, sf_dir), 35).select("term_id", "count", "p_adjust")
    return _rounded(top, 9, "p_adjust")


def term_gene_edges_cut(spark, sf_dir):
    return enrichment.term_gene_edges(_enriched_sizes(spark, sf_dir), 5)[0]


def term_gene_nodes_cut(spark, sf_dir):
    nodes = enrichment.term_gene_edges(_enriched_sizes(spark, sf_dir), 30, "pvalue")[1]
    return _rounded(nodes, 9, "size")


# --- metrics -----------------------------------------------------------------------------


def accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(_quality(spark, sf_dir)), 9, "accuracy")


def classification_report(spark, sf_dir):
    report = metrics.classification_report(_quality(spark, sf_dir))
    return _rounded(report, 9, "accuracy", "precision", "recall", "f1")


def prediction_share(spark, sf_dir):
    return _rounded(metrics.prediction_share(_quality(spark, sf_dir)), 9, "share")


def log_loss(spark, sf_dir):
    return _rounded(metrics.log_loss(_quality(spark, sf_dir)), 9, "log_loss")


def evaluate(spark, sf_dir):
    return _rounded(metrics.evaluate(_quality(spark, sf_dir)), 9, "log_loss", "accuracy")


def measures_with_missing(spark, sf_dir):
    """All documents, most of them without a label, some without a score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    pred = docs.join(labels, "doc_id", "left").selectExpr(
        "label",
        "if(lang = 'fr', null, n_chars / (n_chars + 1000)) as score",
        "if(lang = 'de', null, cast(n_chars >= 1000 as int)) as prediction",
    )
    both = metrics.evaluate(pred)
    report = metrics.classification_report(pred).select("tp", "fp", "fn", "tn")
    auc = metrics.roc_auc(pred).scalar()
    loss = metrics.log_loss(pred).scalar()
    told = both.select("accuracy", F.col("log_loss"), loss.alias("loss_again"), auc.alias("roc_auc"))
    return _rounded(told, 9, "accuracy", "log_loss", "loss_again", "roc_auc").crossJoin(report)


def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(_quality(spark, sf_dir)), 9, "roc_auc")


def pr_curve(spark, sf_dir):
    curve = metrics.pr_curve(_quality(spark, sf_dir))
    return _rounded(curve, 9, "threshold", "precision", "recall")


def auprc(spark, sf_dir):
    return _rounded(metrics.auprc(_quality(spark, sf_dir)), 9, "auprc")


# --- oversampling and models ---------------------------------------------------------------


def knn_within_class(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    near = neighbors.knn_within_class(vectors, EMBEDDED, "label", "vec_id", 5)
    return _rounded(near, 6, "distance")


def knn_lsh_recall(spark, sf_dir):
    """What share of the exact neighbours random projections find, by their rank."""
    vectors = written(_vectors(spark, sf_dir), "vectors")
    both = [
        neighbors.knn_within_class(vectors, EMBEDDED, "label", "vec_id", 5, method=method) for method in ("exact", "lsh")
    ]
    found = both[1].select("key", "neighbour", F.lit(1).alias("found"))
    joined = both[0].join(found, ["key", "neighbour"], "left")
    return joined.groupBy("slot").agg(F.round(F.count("found") / F.count("*"), 4).alias("recall"))


def smote_rows(spark, sf_dir):
    made = smote(_vectors(spark, sf_dir), EMBEDDED, "label", "vec_id")
    return _rounded(made, 6, *EMBEDDED)


def smote_balance(spark, sf_dir):
    made = smote(_vectors(spark, sf_dir), EMBEDDED, "label", "vec_id")
    return made.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def smote_missing_is_refused(spark, sf_dir):
    """Minority rows that a lost first feature would make unusable, and whether
    oversampling says so."""
    vectors = _vectors(spark, sf_dir)
    holed = vectors.withColumn("f0", F.expr("if(label = 1 and f1 > 0, null, f0)"))
    lost = holed.where("f0 is null").agg(F.count("*").alias("rows"))
    try:
        smote(holed, EMBEDDED, "label", "vec_id").count()
        refused = False
    except (PySparkException, Py4JError) as error:
        refused = "feature f0 is missing" in str(error)
    return lost.withColumn("refused", F.lit(refused))


# Depth, rate and folds are the job's own; rounds are few, for time.
_FEW_ROUNDS = boosting.BoostParams(rounds=20)


def gbt_scores(spark, sf_dir):
    vectors = written(_vectors(spark, sf_dir), "vectors")
    model = boosting.fit_gbt(vectors, EMBEDDED, "label", _FEW_ROUNDS)
    return boosting.score(model, vectors, EMBEDDED).select("vec_id", "score", "prediction")


def grid_search_gbt(spark, sf_dir):
    vectors = written(_vectors(spark, sf_dir), "vectors")
    grid = {"rounds": [3], "rate": [0.01, 0.1]}
    return boosting.grid_search(
        vectors, EMBEDDED, "label", "vec_id", grid, _FEW_ROUNDS, k=classify.SEARCH_FOLDS
    )[1]


def grid_search_within_fold(spark, sf_dir):
    vectors = written(_vectors(spark, sf_dir), "vectors")
    return boosting.grid_search(
        vectors, EMBEDDED, "label", "vec_id", {"rounds": [3]}, _FEW_ROUNDS, k=classify.SEARCH_FOLDS,
        oversample="within_fold",
    )[1]


def feature_importance(spark, sf_dir):
    vectors = written(_vectors(spark, sf_dir), "vectors")
    model = boosting.fit_gbt(vectors, EMBEDDED, "label", _FEW_ROUNDS)
    return boosting.feature_importance(model, vectors, EMBEDDED)


def _scaled_folds(spark, sf_dir, k):
    vectors = _vectors(spark, sf_dir)
    scaled = profile.apply_scaler(vectors, profile.fit_scaler(vectors, EMBEDDED))
    return written(folds.stratified_folds(scaled, "label", k, FOLD_SEED, "vec_id"), "scaled")


def mlp_sweep(spark, sf_dir):
    return neural.sweep(_scaled_folds(spark, sf_dir, 5), EMBEDDED, "label", 5, key="vec_id")


def mlp_history(spark, sf_dir):
    """Which measures were taken when, and that the training loss falls."""
    train, valid = folds.fold_split(_scaled_folds(spark, sf_dir, 5), 0)
    history = neural.fit_mlp(train, FIVE, "label", valid, history_every=2, key="vec_id")[1]
    before = F.lag("value").over(Window.partitionBy("side", "metric").orderBy("step"))
    falls = F.when((F.col("side") == "train") & (F.col("metric") == "loss"), F.col("value") < before)
    return history.select("step", "side", "metric", falls.alias("falls"))


def mlp_final(spark, sf_dir):
    """Loss on each side, trained and untrained, as ranks: the trained network is
    better on the side it has learned from."""
    train, valid = folds.fold_split(_scaled_folds(spark, sf_dir, 5), 0)
    losses = []
    for steps in (neural.EPOCHS, 0):
        model, _ = neural.fit_mlp(train, FIVE, "label", max_iter=steps, key="vec_id")
        scored = neural.score_both_sides(model, train, valid, FIVE)
        on_train = scored.where("side = 'train'")
        losses.append(metrics.log_loss(on_train).first()[0])
    rows = scored.groupBy("side").agg(F.count("*").alias("rows"))
    return rows.withColumn("better", F.lit(losses[0] < losses[1]))


def mlp_forward(spark, sf_dir):
    """Scores of a network whose weights are given: one hidden unit that adds up
    the features of the subset, and an output that takes its double."""
    vectors = _vectors(spark, sf_dir)
    weights = [1.0] * len(FIVE) + [0.5] + [0.0, 2.0] + [0.25, -0.25]
    model, _ = neural.fit_mlp(
        vectors, FIVE, "label", hidden=(1,), max_iter=0, key="vec_id", initial_weights=weights
    )
    scored = boosting.score(model, vectors, FIVE).select("vec_id", "score", "prediction")
    return _rounded(scored, 9, "score")


def mlp_untrained(spark, sf_dir):
    train, valid = folds.fold_split(_scaled_folds(spark, sf_dir, 5), 0)
    model, _ = neural.fit_mlp(train, FIVE, "label", max_iter=0, key="vec_id")
    return metrics.prediction_share(neural.score_both_sides(model, train, valid, FIVE))


def _sound(scored: DataFrame, *names: str) -> DataFrame:
    """Which rows were scored, and that score and prediction go together."""
    return scored.select(
        *names,
        F.expr("score between 0 and 1 and (prediction = 1) = (score > 0.5)").alias("sound"),
    )


def gbt_scores_sound(spark, sf_dir):
    vectors = written(_vectors(spark, sf_dir), "vectors")
    model = boosting.fit_gbt(vectors, EMBEDDED, "label", _FEW_ROUNDS)
    return _sound(boosting.score(model, vectors, EMBEDDED), "vec_id", "label")


def mlp_final_sound(spark, sf_dir):
    """The final network scores every row of both sides of fold 0."""
    train, valid = folds.fold_split(_scaled_folds(spark, sf_dir, 5), 0)
    model, _ = neural.fit_mlp(train, FIVE, "label", key="vec_id")
    scored = neural.score_both_sides(model, train, valid, FIVE)
    return _sound(scored, "vec_id", "side", "fold")


def boosted_measures(spark, sf_dir):
    """The boosted job end to end, few rounds: one row of measures."""
    vectors = written(_vectors(spark, sf_dir), "vectors")
    judged = classify.boosted(vectors, EMBEDDED, "label", "vec_id", {"rounds": [3]}, _FEW_ROUNDS)
    one = {c: judged.measures[c].select(c).scalar() for c in ("roc_auc", "auprc")}
    return judged.measures["report"].select(
        "tp", "fp", "fn", "tn", "f1", *[v.alias(c) for c, v in one.items()]
    )


def _feature_file(spark, sf_dir, before: int, features: int) -> tuple[str, str]:
    """A written CSV: columns before the label, the label, features; and its schema."""
    names = [f"x{i}" for i in range(features)]
    if before == 2:  # the boosted job's table has two columns that are dropped
        names[3:5] = classify.BOOST_DROPPED
    lead = ["vec_id", "spare"][:before]
    table = _table(spark, sf_dir, "embeddings").select(
        *[F.col("vec_id").alias(c) for c in lead],
        (F.col("label") == 0).cast("int").alias("Label"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    path = scratch_path(spark, "features")
    table.write.option("header", True).csv(path)
    return path, table.schema


def feature_file_boosted(spark, sf_dir):
    """File to features of the boosted job: positions, dropped columns, label."""
    path, schema = _feature_file(spark, sf_dir, 2, 26)
    table, names = classify.read_features(
        spark, path, schema, "vec_id", classify.BOOST_COLUMNS, dropped=classify.BOOST_DROPPED
    )
    return _rounded(profile.describe_features(table, ["Label", *names]), 4, "mean", "variance")


def feature_file_neural(spark, sf_dir):
    """File to features to folds of the neural job."""
    path, schema = _feature_file(spark, sf_dir, 1, 47)
    table, names = classify.read_features(spark, path, schema, "vec_id", classify.NEURAL_COLUMNS)
    if len(names) != 47:
        raise AssertionError(names)
    folded = folds.stratified_folds(table, "Label", 5, FOLD_SEED, "vec_id")
    return _rounded(folds.split_report(folded, 0, "Label"), 9, "share", "positive_rate")


STUMPED = ["half", "wide", "long", "brand"]


def _stumped(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "cast(p_size + 3 * length(p_type) + p_partkey % 13 > 52 as int) as label", "p_size div 2 as half",
        "length(p_type) as wide", "length(p_name) as long", "int(replace(p_brand, 'Brand#', '')) % 25 as brand",
    )


def gbt_stump(spark, sf_dir):
    """One round of one split: feature and leaves can be said in SQL."""
    parts = _stumped(spark, sf_dir)
    model = boosting.fit_gbt(parts, STUMPED, "label", boosting.BoostParams(rounds=1, depth=1))
    scored = boosting.score(model, parts, STUMPED).select("p_partkey", "score", "prediction")
    return _rounded(scored, 9, "score")


def gbt_two_rounds(spark, sf_dir):
    """Two rounds of one split: the second one learns what the first has left."""
    parts = written(_stumped(spark, sf_dir), "parts")
    model = boosting.fit_gbt(parts, STUMPED, "label", boosting.BoostParams(rounds=2, depth=1, rate=0.5))
    scored = boosting.score(model, parts, STUMPED).select("p_partkey", "score", "prediction")
    return _rounded(scored, 6, "score")


def grid_search_stump(spark, sf_dir):
    """Mean accuracy over folds, of one round of one split."""
    parts = written(_stumped(spark, sf_dir), "parts")
    base = boosting.BoostParams(rounds=1, depth=1)
    found = boosting.grid_search(
        parts, STUMPED, "label", "p_partkey", {"rate": [0.1, 0.5]}, base, k=5, oversample="none"
    )[1]
    return _rounded(found, 9, "accuracy").select("rounds", "rate", "accuracy", "best")


def feature_importance_stump(spark, sf_dir):
    """How often each feature splits, of one split."""
    parts = written(_stumped(spark, sf_dir), "parts")
    model = boosting.fit_gbt(parts, STUMPED, "label", boosting.BoostParams(rounds=1, depth=1))
    return boosting.feature_importance(model, parts, STUMPED)


def _given_weights() -> list[float]:
    return [1.0] * len(FIVE) + [0.5] + [0.0, 2.0] + [0.25, -0.25]


def mlp_sweep_given(spark, sf_dir):
    """The sweep's measures of a network whose weights are given."""
    folded = written(folds.stratified_folds(_vectors(spark, sf_dir), "label", 5, FOLD_SEED, "vec_id"), "folded")
    found = neural.sweep(
        folded, EMBEDDED, "label", 5, max_iter=0, key="vec_id", hidden=(1,), initial_weights=_given_weights()
    )
    return _rounded(found, 9, "value")


def mlp_untrained_given(spark, sf_dir):
    """What a network that has not learned predicts, from given weights."""
    vectors = _vectors(spark, sf_dir)
    model, _ = neural.fit_mlp(
        vectors, FIVE, "label", hidden=(1,), max_iter=0, key="vec_id", initial_weights=_given_weights()
    )
    return _rounded(metrics.prediction_share(boosting.score(model, vectors, FIVE)), 9, "share")


_QUERIES = (
    fixed_width_parse, fixed_width_errors, fixed_width_short_missing, fixed_width_short_truncate,
    fixed_width_latin1, load_extracts_report,
    read_table_csv, read_tables_six, write_table_round_trip, write_scores_row_id, genes_literal,
    select_positions, drop_columns, split_label, feature_subset, union_rename, first_n, last_n,
    dense_row_id, running_sum, running_min_backwards,
    shape, value_counts, class_share, describe_features, fit_scaler, standardize,
    stratified_folds, stratified_folds_five, fold_split_train, fold_split_valid, split_report,
    disproportionality, disproportionality_parts, mixture_weight, ebgm, posterior_quantile,
    signal_scores, squash_once, squash, neg_log_lik, prior_slopes, fit_prior, fit_prior_improves,
    map_ids, unmapped_ids, enrich, enrich_all_tested, hypergeom_sf, bh_adjust, q_value,
    hypergeom_edges, hypergeom_large, set_readable, top_terms, term_gene_edges, term_gene_nodes,
    top_terms_cut, term_gene_edges_cut, term_gene_nodes_cut,
    accuracy, classification_report, prediction_share, log_loss, evaluate, measures_with_missing, roc_auc, pr_curve, auprc,
    knn_within_class, knn_lsh_recall, smote_rows, smote_balance, smote_missing_is_refused,
    gbt_scores, grid_search_gbt, grid_search_within_fold, feature_importance,
    gbt_scores_sound, boosted_measures, gbt_stump, gbt_two_rounds, grid_search_stump, feature_importance_stump, feature_file_boosted, feature_file_neural,
    mlp_sweep, mlp_history, mlp_final, mlp_untrained, mlp_final_sound, mlp_forward,
    mlp_sweep_given, mlp_untrained_given,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES} | loads.queries()
