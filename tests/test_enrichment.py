import math
import random

import pytest
from pyspark.sql import functions as F

from caselight.operators import enrichment
from caselight.plans.genes import SAMPLE_GENES, gene_report
from caselight.sources.tables import genes_df


def tail(k, big_m, big_n, n):
    return sum(
        math.comb(big_m, i) * math.comb(big_n - big_m, n - i) for i in range(k, min(n, big_m) + 1)
    ) / math.comb(big_n, n)


def bh(ps):
    m = len(ps)
    order = sorted(range(m), key=lambda i: -ps[i])
    out, least = [0.0] * m, 1.0
    for back, i in enumerate(order):
        least = min(least, ps[i] * m / (m - back))
        out[i] = least
    # Equal p-values share the smallest of their results.
    return [min(out[j] for j in range(m) if ps[j] == ps[i]) for i in range(m)]


def test_hypergeom(spark):
    cases = [(1, 5, 20, 4), (4, 5, 20, 4), (10, 10, 40, 25), (3, 500, 2000, 60), (60, 500, 2000, 60),
             (18, 20, 30, 28), (1, 1, 10, 1)]
    df = spark.createDataFrame(cases, "k int, m int, nn int, d int")
    for r in df.select("*", enrichment.hypergeom_sf("k", "m", "nn", "d").alias("p")).collect():
        assert r["p"] == pytest.approx(tail(r["k"], r["m"], r["nn"], r["d"]), rel=1e-9)


def test_bh_and_q(spark):
    rnd = random.Random(2)
    ps = [round(rnd.random() ** 2, 2) for _ in range(300)] + [1.0] * 150  # a hot value
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(-1, None)], "i int, p double")
    got = enrichment.q_value(enrichment.bh_adjust(df, "p"), "p").collect()
    assert len(got) == len(ps) + 1
    want = bh(ps)
    share = min(1.0, sum(p >= 0.05 for p in ps) / len(ps) / 0.95)
    for r in got:
        if r["i"] < 0:
            assert r["p_adjust"] is None
        else:
            assert r["p_adjust"] == pytest.approx(want[r["i"]], rel=1e-12)
            assert r["q_value"] == pytest.approx(share * want[r["i"]], rel=1e-12)
    by_p = sorted((r["p"], r["p_adjust"]) for r in got if r["p"] is not None)
    assert all(a[1] <= b[1] for a, b in zip(by_p, by_p[1:]))


def test_q_is_null_without_nulls(spark):
    df = spark.createDataFrame([(0.01,), (0.02,)], "p double")
    got = enrichment.q_value(enrichment.bh_adjust(df, "p"), "p").collect()
    assert [r["q_value"] for r in got] == [None, None]


def sets(spark):
    rows = []
    for size in (9, 10, 500, 501):
        rows += [(f"t{size}", f"about {size}", str(i)) for i in range(size)]
    rows += rows[:50]  # copies do not count twice
    rows += [("far", "no overlap", str(i)) for i in range(1000, 1020)]
    rows += [("near", "all of the list", str(i)) for i in range(12)]
    return spark.createDataFrame(rows, "term_id string, description string, gene_id string")


def test_enrich_sizes_and_numbers(spark):
    genes = spark.createDataFrame([(str(i),) for i in (0, 1, 2, 3, 4, 4, 99999)], "gene_id string")
    got = {r["term_id"]: r for r in enrichment.enrich(genes, sets(spark), p_cut=1, q_cut=1).collect()}
    assert set(got) == {"t10", "t500", "near"}
    near = got["near"]
    assert (near["k"], near["n"], near["big_m"], near["big_n"]) == (5, 5, 12, 521)
    assert near["pvalue"] == pytest.approx(tail(5, 12, 521, 5))
    assert near["genes"] == ["0", "1", "2", "3", "4"] and near["count"] == 5
    assert (near["gene_ratio"], near["bg_ratio"]) == ("5/5", "12/521")
    want = bh([got[t]["pvalue"] for t in ("t10", "t500", "near")])
    for t, w in zip(("t10", "t500", "near"), want):
        assert got[t]["p_adjust"] == pytest.approx(w)
    strict = enrichment.enrich(genes, sets(spark)).collect()
    assert {r["term_id"] for r in strict} == {"t10", "near"}


def test_ids(spark):
    genes = genes_df(spark, [*SAMPLE_GENES, "NOPE"])
    table = spark.createDataFrame(
        [("CD247", "919"), ("CD247", "919"), ("TNFRSF9", "3604"), ("TNFRSF9", "0"), (None, "1")],
        "symbol string, entrez_id string",
    )
    got = sorted(tuple(r) for r in enrichment.map_ids(genes, table, "symbol", "entrez_id").collect())
    assert got == [("CD247", "919"), ("TNFRSF9", "0"), ("TNFRSF9", "3604")]
    assert [r["symbol"] for r in enrichment.unmapped_ids(genes, table, "symbol").collect()] == ["NOPE"]


def test_readable_top_and_edges(spark):
    rows = [("t1", "one", 0.01, ["9", "3", "7"], 3), ("t2", "two", 0.01, ["3"], 1), ("t3", "three", 0.5, [], 0)]
    df = spark.createDataFrame(
        rows, "term_id string, description string, pvalue double, genes array<string>, count long"
    )
    names = spark.createDataFrame([("B", "3"), ("A", "3"), ("Z", "9")], "symbol string, entrez_id string")
    got = {r["term_id"]: r["genes"] for r in enrichment.set_readable(df, names).collect()}
    assert got == {"t1": ["Z", "A", "7"], "t2": ["A"], "t3": []}
    assert enrichment.set_readable(df, names).columns == df.columns
    assert [r["term_id"] for r in enrichment.top_terms(df, 2).collect()] == ["t1", "t2"]
    edges, nodes = enrichment.term_gene_edges(df, 2)
    assert sorted(map(tuple, edges.collect())) == [("t1", "3"), ("t1", "7"), ("t1", "9"), ("t2", "3")]
    sizes = {(r["kind"], r["node_id"]): r["size"] for r in nodes.collect()}
    assert sizes["term", "t1"] == 3 and sizes["gene", "3"] == 2
    by_p = enrichment.term_gene_edges(df, 2, "pvalue")[1]
    assert by_p.filter("kind = 'term'").agg(F.max("size")).first()[0] == 0.01
    assert enrichment.export_genes(df).first()["genes"] == "9/3/7"


def test_gene_report(spark):
    table = spark.createDataFrame([(f"S{i}", str(i)) for i in range(6)], "symbol string, entrez_id string")
    genes = genes_df(spark, [f"S{i}" for i in range(5)] + ["LOST"])
    report = gene_report(genes, table, sets(spark), p_cut=1.0, q_cut=1.0)
    assert report.unmapped.count() == 1
    near = report.readable.filter("term_id = 'near'").first()
    assert near["genes"] == [f"S{i}" for i in range(5)]
    assert report.bars.columns == ["term_id", "description", "count", "p_adjust"]
    assert report.edges.count() == 15 and report.nodes.count() == 8


def test_tail_outside_what_is_possible(spark):
    rows = [(5, 4, 10, 3, 0.0), (0, 4, 10, 3, 1.0), (-2, 4, 10, 3, 1.0), (2, 8, 10, 4, 1.0), (4, 4, 4, 4, 1.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, big_m int, big_n int, n int, want double, i int")
    got = df.withColumn("p", enrichment.hypergeom_sf("k", "big_m", "big_n", "n")).collect()
    assert all(r["p"] == pytest.approx(r["want"]) for r in got)
    none = spark.createDataFrame([(None, 4, 10, 3)], "k int, big_m int, big_n int, n int")
    assert none.select(enrichment.hypergeom_sf("k", "big_m", "big_n", "n")).first()[0] is None


def test_tail_is_exact_and_its_work_bounded(spark):
    import random
    import time
    from fractions import Fraction
    from math import comb

    from caselight.operators.enrichment import hypergeom_sf

    rnd, rows = random.Random(2), []
    for _ in range(300):
        big_n = rnd.randint(1, rnd.choice([5, 20, 300, 3000]))
        big_m, n = rnd.randint(0, big_n), rnd.randint(0, big_n)
        rows.append((rnd.randint(-1, min(big_m, n) + 1), big_m, big_n, n))
    urns = spark.createDataFrame(rows, "k bigint, big_m bigint, big_n bigint, n bigint")
    for r in urns.withColumn("p", hypergeom_sf("k", "big_m", "big_n", "n")).collect():
        k, big_m, big_n, n, p = r
        ways = sum(comb(big_m, i) * comb(big_n - big_m, n - i) for i in range(max(0, k), min(big_m, n) + 1) if n - i <= big_n - big_m)
        want = float(Fraction(ways, comb(big_n, n)))
        assert p == pytest.approx(want, rel=1e-10, abs=1e-300)

    def took(scale):
        table = spark.range(400).selectExpr(
            f"{scale}L as big_m", f"1000L * {scale} as big_n", "1000000L as n", f"{scale} div 1000 + id % 3 as k"
        )
        table = table.selectExpr("big_m", "greatest(big_n, 4000000L) as big_n", "n", "greatest(k, 1L) as k")
        began = time.time()
        assert table.select(hypergeom_sf("k", "big_m", "big_n", "n").alias("p")).where("p between 0 and 1").count() == 400
        return time.time() - began

    took(10_000)
    assert took(100_000_000) < 20 * took(10_000) + 5


def test_tails_of_many_terms_are_summed_batch_by_batch(spark):
    """Thousands of terms a row, of rows that are all different, within seconds."""
    import time

    from caselight.operators.enrichment import hypergeom_sf

    urns = spark.range(20_000).selectExpr(
        "4000000L + id as big_n", "1000000L as big_m", "1000000L as n", "249000L + id div 10 as k"
    )
    urns.select(hypergeom_sf("k", "big_m", "big_n", "n")).first()
    start = time.perf_counter()
    told = urns.withColumn("p", hypergeom_sf("k", "big_m", "big_n", "n")).agg(F.min("p"), F.max("p"), F.count("p"))
    least, most, known = told.first()
    assert time.perf_counter() - start < 15
    assert 0 < least < 0.05 and 0.95 < most <= 1 and known == 20_000
