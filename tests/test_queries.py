"""Every query of the core against its SQL, and those without SQL for running at all."""

import os

import pytest
from oracle import DATA, differences

from tallyloom.plans import core_queries, reference_queries

QUERIES = reference_queries.queries() | core_queries.queries()
SQL = reference_queries.oracle_sql() | core_queries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


# At this size not every event type occurs, and the SQL names them all.
@pytest.mark.parametrize("name", sorted(set(SQL) - {"p4_user_features"}))
def test_query_equals_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
