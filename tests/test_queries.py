"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as registry
from sonara.plans.oracles import ORACLE_SQL
from sonara.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).count() == 1
