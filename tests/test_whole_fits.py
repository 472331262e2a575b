"""Registered queries ask for the whole fits, and fits grown side by side are those grown alone."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import boosting, models, splits
from panelworks.operators.boosting import Boosting, Fit
from panelworks.plans import catalogue, second, trades, training  # noqa: F401 - the later ones add their queries
from tests.test_boosting import D, X, Y, grown

DATA = "/root/testdata/sf0.001"


class Asked(Exception):
    """What a query asks for: fits, rounds, depth, least rows of a leaf."""


def asked(spark, monkeypatch, name):
    def fit_all(train, fits, cfg):
        raise Asked(len(fits), cfg.rounds, cfg.depth, cfg.leaf)

    monkeypatch.setattr(boosting, "fit_all", fit_all)
    with pytest.raises(Asked) as seen:
        catalogue.QUERIES[name](spark, DATA)
    return seen.value.args


@pytest.mark.parametrize("block", [100, 16_384])
def test_fits_side_by_side(spark, block):
    """Of a few rows a fit has one block and no sums to meet, of more it has several."""
    rows = [(k, float(Y[k]), float(D[k]), *(None if np.isnan(v) else float(v) for v in X[k])) for k in range(len(Y))]
    df = spark.createDataFrame(rows, "k long, y double, d double, a double, b double, c double").repartition(3)
    half, cfg = np.arange(len(Y)) < 350, Boosting(rounds=5, depth=3, rate=0.3, leaf=20, block=block, stored=2)
    every = np.ones(len(Y), bool)
    asks = [(every, Y, "y", [0, 1, 2], "log"), (half, D, "d", [0, 1, 2], "absolute"), (half, Y, "y", [0, 2], "log"), (every, D, "d", [2], "absolute")]
    parts = [(df.where("k < 350" if part is half else "true").withColumn("label", F.col(y)), Fit([("abc")[c] for c in columns], loss)) for part, _, y, columns, loss in asks]
    for (part, y, _, columns, loss), model in zip(asks, boosting.fit_each(parts, cfg), strict=True):
        want, _ = grown(X[np.ix_(part, columns)], y[part], Boosting(rounds=5, depth=3, rate=0.3, leaf=20, loss=loss))
        got = model.output([X[part, c] for c in columns])
        assert len(model.trees) == 5 and got == pytest.approx(want, abs=1e-6)


def test_bags_of_days_drawn_at_once(spark):
    days = spark.createDataFrame([(dt.date(2022, 1, 1) + dt.timedelta(days=k),) for k in range(41)], "ts date")
    asks = spark.createDataFrame([(k, k // 3, k % 3) for k in range(6)], "_fit int, _group int, _bag int")
    got = splits.hashed_bags(asks.crossJoin(days.where("ts < '2022-01-30'")).where("_group = 1").unionByName(asks.crossJoin(days).where("_group = 0"))).collect()
    for k in range(6):
        want = splits.hashed_days(days if k < 3 else days.where("ts < '2022-01-30'"), 0.8, k % 3).collect()
        assert sorted(r.ts for r in got if r._fit == k) == sorted(r.ts for r in want) and len(want) == (32 if k < 3 else 23)


def test_day_of_the_engine_is_trained_whole(spark, monkeypatch):
    assert asked(spark, monkeypatch, "engine_day") == (30, 300, 5, 200)


def test_run_of_the_engine_is_trained_whole(spark, monkeypatch):
    assert asked(spark, monkeypatch, "engine_train") == (30, 300, 5, 200)
    assert training.runs.Settings().meta == {}  # the second stage by its own defaults


@pytest.mark.parametrize("name", ["ab_run", "ablation"])
def test_compared_runs_are_trained_whole(spark, monkeypatch, name):
    assert asked(spark, monkeypatch, name) == (10, 300, 5, 200)


def test_bags_are_whole(spark, monkeypatch):
    asks = []

    def fit_classifier(train, kind, cfg, features):
        asks.append((kind, cfg.rounds, cfg.depth, cfg.leaf))
        return boosting.Model(features, [np.zeros(0)] * len(features), 0.0, "log", [])

    monkeypatch.setattr(models, "fit_classifier", fit_classifier)
    assert catalogue.QUERIES["meta_bag"](spark, DATA).columns == ["ts", "symbol", "meta_p", "spread_lo", "spread_hi"]
    assert asks == [("forest", 150, 3, 100)] * 10


def test_walk_forward_is_trained_whole(spark, monkeypatch):
    assert asked(spark, monkeypatch, "gbt_walkforward") == (5, 300, 5, 200)


@pytest.mark.parametrize(("name", "want"), [("nested_evaluation", (100, 150, 3, 100)), ("meta_model", (25, 150, 3, 100)), ("model_bundle", (5, 300, 5, 200))])
def test_second_stages_and_bundles_are_trained_whole(spark, monkeypatch, name, want):
    """Nested: four later blocks with 10 bags each, and 3 for each of 5 inner blocks."""
    assert asked(spark, monkeypatch, name) == want
