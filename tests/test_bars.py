"""Bars of lines with odd keys against plain Python, and how the lines are aggregated."""

import datetime as dt
import re
from collections import defaultdict

import numpy as np
import pytest

from panelworks.sources import tables

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"


@pytest.fixture(scope="module")
def lines():
    """Few orders over ten days, some with a time of day: ties down to the last part of the key, missing keys, days and quantities."""
    rng = np.random.default_rng(5)
    some = lambda x, share: None if rng.random() < share else x
    out = []
    for _ in range(600):
        at = dt.datetime(2024, 1, 3) + dt.timedelta(days=int(rng.integers(0, 10)), hours=int(rng.choice([0, 0, 0, 7])))
        out.append((some(int(rng.integers(-3, 9)), 0.1), int(rng.integers(0, 8)), some(int(rng.integers(0, 4)), 0.1), some(int(rng.integers(1, 3)), 0.1), some(float(rng.integers(1, 5)), 0.05), float(rng.integers(1, 5)), some(at, 0.05)))
    return out


@pytest.fixture(scope="module")
def folder(spark, lines, tmp_path_factory):
    d = tmp_path_factory.mktemp("lines")
    spark.createDataFrame(lines, LINE).repartition(3).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, "ab"[k % 2] if k < 6 else None) for k in range(7)], "p_partkey long, p_brand string").write.parquet(f"{d}/part.parquet")
    return str(d)


def test_bars_of_odd_lines(spark, lines, folder):
    weeks = defaultdict(list)
    for order, part, supplier, number, quantity, price, at in lines:
        if part < 7:
            monday = None if at is None else at.date() - dt.timedelta(days=at.weekday())
            key = tuple((x is not None, x) for x in (at, order, number, price, supplier))  # missing ones first
            weeks["ab"[part % 2] if part < 6 else None, monday].append((key, None if quantity is None else price / quantity, quantity))
    want = {}
    for k, own in weeks.items():
        px, own = [x for _, x, _ in own if x is not None], sorted(own, key=lambda r: r[0])
        first, last = ({x for key, x, _ in own if key == own[at][0]} for at in (0, -1))  # equal keys may differ in quantity
        want[k] = first, max(px), min(px), last, sum(q for _, _, q in own if q is not None)
    got = tables.bars(spark, folder).collect()
    assert len(got) == len(want) == 9
    for r in got:
        first, high, low, last, volume = want[r["symbol"], r["ts"]]
        assert r["open"] in first and r["close"] in last and (r["high"], r["low"], r["volume"]) == (high, low, volume)


def test_all_lines_are_aggregated_by_hashing(spark, folder, monkeypatch):
    """An extreme by a key of several parts is aggregated by sorting: not all lines may go that way."""
    stored = []
    monkeypatch.setattr(tables, "durable", lambda df, keep=getattr(tables, "durable", None): stored.append(df) or keep(df), raising=False)
    found = tables.bars(spark, folder)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    deepest = [re.findall(r"(\w+Aggregate)\(", plan(df))[-1] for df in (*stored, found) if "LeftSemi" not in plan(df)]
    assert deepest == ["HashAggregate"]
