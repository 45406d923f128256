"""The pN_ queries with SQL against DuckDB on the smallest test tables."""

import os

import pytest

from notemill.llm import queries
from tests.test_queries import FOLDER, compare


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])
