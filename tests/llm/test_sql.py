"""Queries with SQL give DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from panelworks.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        duck.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    rows = lambda t: sorted(tuple(map(repr, r.values())) for r in t.to_pylist())
    assert rows(got.select(columns).toArrow()) == rows(want.select(columns))
