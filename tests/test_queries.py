"""Every registered query with SQL agrees with DuckDB; the others run."""

import pytest

from compare import duck, same
from tracewalk.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_evidence_of_all_walks_is_whole(spark, con):
    """Every line of every order is in evidence, which the queries that show the limit leave out in part."""
    (walks,) = con.execute("SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey").fetchone()
    assert QUERIES["evidence_edges_all"](spark, SF).count() == 2 * walks > QUERIES["evidence_edges"](spark, SF).count()
