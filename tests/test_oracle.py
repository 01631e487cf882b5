"""Every registered query against its SQL, over whole tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql as every_sql, queries as every_query
from check import TABLES, compare
from murmuration.catalog.oracle import ORACLE
from murmuration.catalog.queries import QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLE


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, db, folder, name):
    got = queries()[name](spark, folder).toPandas()
    assert compare(got, db.execute(oracle_sql()[name]).df()) == "ok"


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_all_are_registered():
    assert QUERIES.items() <= every_query().items() and ORACLE.items() <= every_sql().items()


def test_both_branches_are_reached(spark, folder):
    flags = {r.resampled for r in queries()["step_report"](spark, folder).collect()}
    assert flags == {True, False}
    by_user = {r.resampled for r in queries()["step_report_grouped"](spark, folder).collect()}
    assert by_user == {True, False}


def test_entry(spark):
    assert entry(spark).count() == 5
