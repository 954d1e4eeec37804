"""Every query with SQL against DuckDB on the smallest tables."""

import oracle
import pytest

from docharbor.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, small, name):
    assert oracle.compare(queries.QUERIES[name](spark, small), queries.SQL[name], oracle.connection(small)) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["host", "n_links", "n_distinct"]
