"""Every query with SQL gives the same rows as DuckDB."""

import pytest

from chatlake.catalog import QUERIES, SQL

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    """These have their own tests (test_properties.py, test_edges.py); here, that they give rows, and the same ones again."""
    once, again = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    # digests and decisions look back from a time after the smallest tables' last message
    assert once == again and (once or name == "m4_digest")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
