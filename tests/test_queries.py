"""Every registered query against its check SQL, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from stallbook.plans import oracle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = queries.queries()
ORACLE = oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    from check import connect

    return connect(FOLDER)


def test_every_query_has_check_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    from check import differences

    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 50
    assert "priority" in df.columns and "total_visits" in df.columns


def test_providers_per_package_covers_every_provider(spark):
    total = QUERIES["offers"](spark, FOLDER).count()
    for key in ("providers_per_package_v1", "providers_per_package_v2"):
        assert QUERIES[key](spark, FOLDER).agg({"providers_count": "sum"}).first()[0] == total
