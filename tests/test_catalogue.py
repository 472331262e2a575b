"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from panelworks.plans import catalogue, second, trades, training  # noqa: F401 - the later ones add their queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def rows(table):
    shown = lambda x: "null" if x is None or x != x else repr(x)
    return sorted(tuple(shown(x) for x in r.values()) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert rows(got.select(columns).toArrow()) == rows(want.select(columns))


def test_all_other_queries_are_tested_elsewhere():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"baseline_report", "engine_train", "engine_day", "meta_model", "model_bundle", "gbt_walkforward", "meta_bag", "nested_evaluation", "ablation", "ab_run"}


def test_a_query_reads_the_lines_of_its_bars_once(spark, monkeypatch):
    """Bars are a small table beside the lines they are made of; what is made of bars must not read the lines again."""
    from panelworks.plans import views

    made = []
    monkeypatch.setattr(views, "bars", lambda spark, d, bars=views.bars: made.append(d) or bars(spark, d))
    for build in (views.labelled, views.scores, catalogue._states, lambda *a: catalogue._learning(*a)[0], lambda *a: catalogue._learning(*a)[1]):
        made.clear()
        files = build(spark, DATA).inputFiles()
        assert len(made) == 1 and files and not any("lineitem" in f for f in files)
