"""Queries of the subpackage against their SQL."""

import os

import pytest
from oracle import DATA, differences

from tallyloom.llm import queries as q

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, q.queries()[name], q.oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert q.queries()[name](spark, DATA).count() > 0
