"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as registered
from compare import TABLES, normal

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours = registered.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(registered.oracle_sql()[name]).fetchdf()
    a, b = normal(ours), normal(theirs)
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
