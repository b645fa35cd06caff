"""Every query that SQL expresses against that SQL."""

import pytest

from folioscan.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_matches_sql(spark, name):
    d = "/root/testdata/sf0.001"
    compare(queries.QUERIES[name](spark, d), queries.ORACLE_SQL[name], d)
