"""Every query of the graph engine against its SQL."""

import pytest

from weftgraph.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, small, same):
    same(catalogue.QUERIES[name](spark, small), catalogue.ORACLE_SQL[name])


def test_every_query_but_louvain_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"louvain"}


def test_entry_imports_and_lists_queries():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
