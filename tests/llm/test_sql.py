"""The SQL of the queries that have one, on the smallest tables."""

import sys
from pathlib import Path

import pytest

from codequarry.llm.queries import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import spark_rows, sql_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(SQL[name], SF)
