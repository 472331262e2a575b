"""The day's book, outcomes beside the first touch, bundles and second-stage models: what the SQL comparison can't show."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import daybook, evidence, labels, models, splits
from panelworks.sources.tables import as_float, computed_once, named, newest_run, scan_csv, scan_json, number, sessions, write_csv
from panelworks.operators import books

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def flat_bars(spark, later):
    """Twenty flat bars with a true range of 2 at 100, then the given (high, low, close)."""
    rows = [("a", day(i), 100.0, 101.0, 99.0, 100.0, 1.0) for i in range(20)]
    rows += [("a", day(20 + i), 100.0, h, low, c, 1.0) for i, (h, low, c) in enumerate(later)]
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


def test_outcomes_count_sessions_and_look_past_the_first_touch(spark):
    later = [(101.0, 99.5, 100.0), (103.5, 99.0, 103.0), (103.0, 97.0, 98.0), (100.0, 98.5, 99.0), (105.0, 99.0, 104.0)]
    got = labels.barrier_labels(flat_bars(spark, later)).where(F.col("ts") == day(19)).first()
    assert (got.ft_a, got.days_tp, got.days_sl) == (1.0, 2, 3)
    assert math.isclose(got.mfe, 0.05) and math.isclose(got.mae, -0.03)
    assert math.isclose(got.xr_s, -0.02)  # the wider target of 104 comes after the stop


def test_outcomes_of_untouched_barriers_are_missing(spark):
    got = labels.barrier_labels(flat_bars(spark, [(100.5, 99.5, 100.0)] * 5)).where(F.col("ts") == day(19)).first()
    assert (got.ft_a, got.days_tp, got.days_sl, got.xr_s) == (0.0, None, None, 0.0)
    last = labels.barrier_labels(flat_bars(spark, [(100.5, 99.5, 100.0)] * 5)).where(F.col("ts") == day(24)).first()
    assert (last.days_tp, last.mfe, last.xr_s) == (None, None, None)


def test_labels_for_repeated_and_unknown_keys(spark):
    keys = spark.createDataFrame([(day(19), "a"), (day(19), "a"), (day(19), "b")], "ts date, symbol string")
    assert labels.labels_for(flat_bars(spark, [(100.5, 99.5, 100.0)] * 5), keys).count() == 1


def test_expected_value_gives_the_rest_to_timeouts(spark):
    c = lambda x: F.lit(x)
    got = spark.range(1).select(daybook.expected_value(c(0.4), c(0.3), c(0.03), c(0.02), c(0.01), 0.0).alias("a"), daybook.expected_value(c(0.8), c(0.5), c(0.03), c(0.02), c(0.01), 0.0).alias("b")).first()
    assert math.isclose(got.a, 0.012 - 0.006 + 0.003) and math.isclose(got.b, 0.024 - 0.01)


def test_watchlist_without_a_true_range(spark):
    df = spark.createDataFrame([(DAY, "a", 100.0, None, 0.6, 0.6, 0.3), (DAY, "b", 50.0, 1.0, 0.5, 0.5, 2.0)], "ts date, symbol string, close double, atr double, p_raw double, confidence double, p_sl double")
    a, b = daybook.watchlist(df, 0.0).orderBy("rank").collect()
    assert (a.symbol, a.pct, a.target, a.ev_bp) == ("a", 1.0, None, None)
    assert (b.pct, b.target) == (0.5, 51.5) and math.isclose(b.ev_bp, (0.5 * 0.03 - 1.0 * 0.02 - 0.0035) * 1e4)


def test_decisions(spark):
    df = spark.createDataFrame([(DAY, k, p) for k, p in ((1, 0.6), (2, 0.2), (3, None), (4, 0.9), (6, 0.99))], "ts date, rk long, meta_p double")
    got = {r.rk: r for r in daybook.decisions(df, 0.5).collect()}
    assert [got[k].action for k in (1, 2, 3, 4, 6)] == ["TRADE", "SKIP", "SKIP", "-", "-"]
    assert math.isclose(got[1].size_x + got[2].size_x, 3.0) and got[4].size_x is None
    assert [got[k].meta_rank for k in (4, 1, 2, 3, 6)] == [1, 2, 3, 4, None]
    assert {r.action for r in daybook.decisions(df, 0.5, validated=False).collect()} == {"TRADE*", "-"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ts date, symbol string, ret1 double, rk long, meta_p double")
    assert daybook.latest_session(none).count() == daybook.decisions(none, 0.5).count() == daybook.market_state(none).count() == 0
    assert daybook.present(none, ["ret1"]).first().ret1 is False
    assert daybook.largest_difference(none, "ret1", "meta_p").first().max_difference is None


def test_kept_takes_whole_rows(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 5, "y")], "k long, t long, v string")
    assert [tuple(r) for r in daybook.kept(df, ["k"], ["t"], last=True).orderBy("k").collect()] == [(1, 2, None), (2, 5, "y")]


def test_share_counts_missing_sessions(spark):
    df = spark.createDataFrame([(day(0), 1.0), (day(1), 3.0), (day(2), 3.0), (day(3), None)], "ts date, v double")
    assert [r.s for r in daybook.share_at_most(df, "v", "s").orderBy("ts").collect()] == [0.25, 0.75, 0.75, None]


def test_densified_series_drops_other_days(spark):
    axis = spark.createDataFrame([(day(k),) for k in range(3)], "ts date")
    got = daybook.densified(spark.createDataFrame([(day(1), 2.0), (day(9), 3.0)], "ts date, v double"), axis).orderBy("ts").collect()
    assert [r.v for r in got] == [None, 2.0, None]


def test_recent_sessions_never_reach_the_day(spark):
    axis = spark.createDataFrame([(day(k),) for k in range(20)], "ts date")
    got = daybook.recent_sessions(axis, F.lit(day(15)), F.lit(day(5)), 3)
    assert sorted(r.ts for r in got.collect()) == [day(k) for k in range(6, 15)]
    assert daybook.recent_sessions(axis, F.lit(day(15)), F.lit(day(14)), 3).count() == 3


def test_evidence_means_are_means_of_days(spark):
    df = spark.createDataFrame([(day(k), s, p, 0.01 * (k + 1), float(s == "a")) for k in range(12) for s, p in (("a", 0.9), ("b", 0.1))], "ts date, symbol string, p_raw double, exit_ret double, hit double")
    got = {(r.top_n, r.measure): r for r in evidence.topn_evidence(df, (1, 3)).collect()}
    assert got[1, "hit"].mean == 1.0 and got[3, "hit"].mean == 0.5
    assert math.isclose(got[1, "net"].mean, 0.065 - 0.0035) and got[1, "net"].clears and not got[1, "hit"].clears


def test_intervals_wait_for_forty_sessions(spark):
    df = spark.createDataFrame([("x", 1.0, 0.5, 1.5, 39), ("y", 1.0, 0.5, 1.5, 40)], evidence.SCHEMA)
    got = {r.series: (r.mean, r.lo) for r in evidence.guarded_intervals(df).collect()}
    assert got == {"x": (1.0, None), "y": (1.0, 0.5)}


@pytest.fixture(scope="module")
def learning(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        for j in range(10):
            x = float(rng.uniform())
            up = bool(rng.uniform() < x)
            rows.append((day(2 * k), f"s{j}", f"{k}/{j}", x, 1.0 if up else -1.0, float(up), x, -x, (1 + j % 5) if up else None, j + 1))
    return spark.createDataFrame(rows, "ts date, symbol string, key string, x double, ft double, label double, mfe double, mae double, days_tp int, rk long").repartition(4).cache()


SMALL = models.Trees(rounds=3, depth=2, rate=0.3, leaf=5)


def test_bundle_comes_back_from_storage(spark, learning, tmp_path):
    bundle = models.fit_bundle(learning, ["x"], SMALL)
    one = models.predict_bundle(bundle, learning, ["x"]).orderBy("key").toPandas()
    models.save_bundle(bundle, str(tmp_path / "b"))
    other = models.predict_bundle(models.load_bundle(str(tmp_path / "b")), learning, ["x"]).orderBy("key").toPandas()
    assert np.array_equal(one[["raw", "p_sl", "mfe_hat", "mae_hat", "days_hat"]], other[["raw", "p_sl", "mfe_hat", "mae_hat", "days_hat"]])
    assert one["days_hat"].between(1, 5).all() and np.corrcoef(one["raw"], one["x"])[0, 1] > 0.7 and np.corrcoef(one["p_sl"], one["x"])[0, 1] < -0.7


def test_second_stage_model(spark, learning):
    fitted = models.fit_meta(learning, sessions(learning), ["x"], bags=3, oof_bags=1, blocks=2, kind="logistic", cfg=SMALL)
    got = models.predict_meta(fitted, learning, ["x"]).toPandas()
    assert got["meta_p"].between(0, 1).all() and (got["spread_lo"] <= got["spread_hi"]).all() and 0 < fitted.tau < 1
    assert abs(got["meta_p"].mean() - got["label"].mean()) < 0.1
    with pytest.raises(ValueError):
        models.fit_meta(learning.where("label = 1"), sessions(learning), ["x"], blocks=2, kind="logistic", cfg=SMALL)


def test_importance_shares(spark, learning):
    noise = learning.withColumn("z", F.lit(1.0))
    got = models.importance([models.fit_classifier(models.assembled(noise, ["x", "z"]), "gbt", SMALL)], ["x", "z"])
    assert got == [("x", 1.0), ("z", 0.0)]


def test_guard_band_and_lockbox(spark):
    axis = sessions(spark.createDataFrame([(day(k),) for k in range(40)], "ts date"))
    block = {"block": 2, "lo": day(15), "hi": day(18), "guard_lo": day(5), "guard_hi": day(28)}
    got = {r.part: r["count"] for r in splits.held_out(axis, block).groupBy("part").count().collect()}
    assert got == {"block": 4, "train": 16}
    parts = {r.part: r["count"] for r in splits.lockbox_parts(axis).groupBy("part").count().collect()}
    assert parts == {"research": 29, "gap": 5, "lockbox": 6}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, 0.1), ("r2", 2, 0.2), ("r2", 3, 0.3)], "run string, a long, b double")
    df.write.partitionBy("run").parquet(str(tmp_path / "runs"))
    assert sorted(r.a for r in newest_run(spark.read.parquet(str(tmp_path / "runs"))).collect()) == [2, 3]
    write_csv(df, str(tmp_path / "csv"))
    assert scan_csv(spark, str(tmp_path / "csv"), "run string, a long, b double").orderBy("a").collect() == df.orderBy("a").collect()
    df.write.json(str(tmp_path / "json"))
    assert scan_json(spark, str(tmp_path / "json"), "run string, a long, b double").count() == 3
    calls = []
    build = lambda: calls.append(1) or df
    for rebuild in (False, False, True):
        assert computed_once(spark, str(tmp_path / "once"), build, rebuild).count() == 3
    assert len(calls) == 2
    books.append_experiment(spark, str(tmp_path / "log"), {"a": 1})
    books.append_experiment(spark, str(tmp_path / "log"), {"a": 2})
    assert sorted(r.a for r in spark.read.json(str(tmp_path / "log")).collect()) == ["1", "2"]


def test_small_column_helpers(spark):
    assert named(["x_a", "y", "x_a", "x_b"], "x_") == ["x_a", "x_b"] and named(["ab", "cb", "d"], part="b") == ["ab", "cb"]
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "t string").select(number("t").alias("n"))
    assert [r.n for r in df.collect()] == [1.5, None, None, None]
    assert as_float(df, ["n"]).dtypes == [("n", "float")]
