"""Every query with SQL agrees with it, exactly, on the smallest driver tables."""

import os

import pytest

from checks.compare import difference, sql_engine
from checks.oracles import oracle_sql
from checks.queries import queries

SF_DIR = "/root/testdata/sf0.001"
# Too few pairs at this size to be thinned (see test_signals), and sets of too few genes to be tested.
TOO_SMALL = {"squash_once", "squash", "neg_log_lik", "prior_slopes"}
TOO_SMALL |= {"top_terms_cut", "term_gene_edges_cut", "term_gene_nodes_cut"}
QUERIES, SQL = queries(), oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def engine():
    return sql_engine(SF_DIR)


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(SQL) - TOO_SMALL))
def test_query(spark, engine, name):
    assert difference(spark, engine, SF_DIR, name, QUERIES[name], SQL[name]) == ""
    assert engine.execute(f"select count(*) from ({SQL[name]})").fetchone()[0] > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert rows and df.columns[:3] == ["var1", "var2", "N"]
    assert [r["EBGM"] for r in rows] == sorted((r["EBGM"] for r in rows), reverse=True)
