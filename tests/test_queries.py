"""Every query with SQL gives the rows of its SQL."""

import pytest
from oracle import spark_rows, sql_rows

from codequarry.plans import analysis_queries, answer_queries, extract_queries, index_queries  # noqa: F401  register their queries
from codequarry.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
