"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from daywright import catalog
from tests.conftest import SF_SMALL
from tools.compare import connect, differences

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in SQL])
def test_query_matches_sql(spark, duck, name):
    mine = entry.queries()[name](spark, SF_SMALL).toPandas()
    assert differences(mine, duck.sql(SQL[name]).df()) == ""


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "dynamic_percentile" in out.columns


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_every_query_of_the_catalog_has_a_counterpart():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
