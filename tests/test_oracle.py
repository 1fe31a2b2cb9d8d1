"""Every query against its SQL twin."""

import pytest

import __spark_entry__ as entry_module
from workload.oracle import ORACLE
from workload.queries import QUERIES
from workload.check import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    query, sql = QUERIES[name], ORACLE[name]
    assert difference(spark, connection, SF, query, sql) == ""


def test_entry_has_rows(spark):
    result = entry_module.entry(spark)
    labels = {r["label"] for r in result.collect()}
    assert labels == {"quality", "toxic", "MACRO_AVERAGE", "MICRO_AVERAGE"}


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
