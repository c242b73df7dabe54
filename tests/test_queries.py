"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

import __spark_entry__ as entry
from nearfold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), duck.sql(catalog.ORACLE_SQL[name]))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
