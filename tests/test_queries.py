"""Every query with SQL against DuckDB at the smallest size."""

import pytest

from quern.catalogue import QUERIES, SQL

from compare import check


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
