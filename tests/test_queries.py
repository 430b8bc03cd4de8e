"""Every vector query against its SQL, over whole tables."""

import pytest

from tests.helpers import connection, same_rows
from vecmill.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), connection(SF).execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 500
    assert set(e.oracle_sql()) <= set(e.queries())
