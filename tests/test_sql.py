"""Every query that SQL expresses against that SQL; the others run, and give rows."""

import pytest

from folioscan.queries import load
from tests.oracle import compare

QUERIES, ORACLE = load()
D = "/root/testdata/sf0.001"
#: Searches whose words the driver tables may not hold.
MAY_BE_EMPTY = {"f2_f3_folded_search", "f4_fuzzy_search"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    compare(QUERIES[name](spark, D), ORACLE[name], D)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0 or name in MAY_BE_EMPTY
