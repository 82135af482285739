"""Every registered query against its SQL twin on the smallest sample."""

import check_oracle
import pytest

import __spark_entry__ as entry
from pricewell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    names, rows = check_oracle.spark_rows(entry.queries()[name](spark, SF))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want_names, want = check_oracle.sql_rows(con, sql)
    assert names == want_names
    assert rows == want


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() > 0 and "ceiling" in result.columns


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
