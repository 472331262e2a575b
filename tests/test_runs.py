"""Runs are stored, found again and repeatable; the daily loop touches only its own dates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import analogues, daily, models, runs, splits
from panelworks.sources.tables import sessions

TINY = models.Trees(rounds=2, depth=2, rate=0.3, leaf=5)
SETTINGS = runs.Settings(folds=2, at_once=2, trees=TINY)
DAY = dt.date(2023, 1, 2)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(90):
        for j in range(8):
            x = float(rng.uniform())
            up = bool(rng.uniform() < x)
            rows.append((DAY + dt.timedelta(days=k), f"s{j}", f"{k}/{j}", x if rng.random() < 0.9 else None, 1.0 if up else float(rng.integers(-1, 1)), float(up), float(up), x / 10 if up else -x / 20, x / 10, -x / 20, float(1 + j % 5) if up else None))
    return spark.createDataFrame(rows, "ts date, symbol string, key string, x double, ft double, hit double, label double, exit_ret double, mfe double, mae double, days_tp double").repartition(3).cache()


def test_baseline_run_reads_no_lockbox_and_comes_back(spark, panel, tmp_path):
    run = runs.baseline_train(panel, ["x"], str(tmp_path), SETTINGS)
    again = runs.baseline_train(panel, ["x"], str(tmp_path), SETTINGS)
    assert run.run == again.run == runs.newest(spark, str(tmp_path), "baseline").run
    scores = run.read("scores")
    axis = [r.ts for r in sessions(panel).orderBy("ts").collect()]
    assert scores.agg(F.max("ts")).first()[0] <= axis[int(90 * 0.85) - 6]
    facts = {r.score: r for r in run.read("metrics").collect()}
    assert facts["p_raw"].auc > 0.7 and facts["p_cal"].n == scores.count() and scores.where("p_cal not between 0 and 1").count() == 0
    assert {r.fold for r in scores.select("fold").distinct().collect()} == {1, 2}
    for name in ("calibration", "thresholds", "hits", "evidence"):
        assert name == "thresholds" or run.read(name).count() > 0
    with pytest.raises(ValueError):
        runs.newest(spark, str(tmp_path), "engine")


def test_fold_tails_lie_between_fit_and_test(panel):
    axis = sessions(panel)
    parts = splits.fold_parts(axis, splits.forward_blocks(axis, 2)).orderBy("block", "ts").collect()
    for b in (1, 2):
        own = [r.part for r in parts if r.block == b]
        assert list(dict.fromkeys(own)) == ["fit", "gap", "calibrate", "embargo", "test"] and own.count("embargo") == 5 and own.count("gap") == 4


def test_engine_run_and_its_day(spark, panel, tmp_path):
    run = runs.engine_train(panel, ["x"], str(tmp_path), SETTINGS)
    assert runs.newest(spark, str(tmp_path), "engine").run == run.run
    verdicts = {r.model: r.verdict for r in run.read("classifiers").collect()} | {r.model: r.verdict for r in run.read("reliability").collect()}
    assert verdicts["TP"] == "useful" and set(verdicts) == {"TP", "SL", "MFE", "MAE", "DAYS"}
    assert [r.feature for r in run.read("importance").collect()] == ["x"]
    today = panel.where(F.col("ts") == DAY + dt.timedelta(days=89)).withColumns({"close": F.lit(10.0), "atr": F.lit(1.0)})
    scored = daily.scored_by(run, today, ["x"])
    got = scored.orderBy(F.desc("p_raw")).collect()
    assert all(0 <= r.confidence <= 1 and 1 <= r.days_hat <= 5 for r in got) and got[0].confidence >= got[-1].confidence


def view(spark, day, symbols, score):
    rows = [(day, s, k + 1, score - k / 10, 0.5, 1.0, 1.0, 1.0, 10.0, "TRADE" if k % 2 else "SKIP", 1.0, k + 1) for k, s in enumerate(symbols)]
    return spark.createDataFrame(rows, "ts date, symbol string, rank int, p_raw double, confidence double, target double, stop double, stretch double, ev_bp double, action string, size_x double, meta_rank int")


def test_ledger_by_date_and_resolution(spark, tmp_path):
    ledger, resolved = f"{tmp_path}/ledger", f"{tmp_path}/resolved"
    days = [DAY + dt.timedelta(days=k) for k in range(9)]
    outcomes = spark.createDataFrame([(d, s, 0.0135 if s == "a" else -0.0065, 1.0 if s == "a" else -1.0, 2, 3, 0.02) for d in days for s in "abcd" if (d, s) != (days[1], "c")], "ts date, symbol string, exit_ret double, ft double, days_tp int, days_sl int, xr_s double")
    assert daily.resolve(spark, ledger, resolved, outcomes) == 0  # nothing written yet
    for k in (0, 1, 2, 6):
        daily.write_day(view(spark, days[k], "abc", 0.9), ledger, "one")
    daily.write_day(view(spark, days[2], "dba", 0.9), ledger, "two")
    daily.write_day(view(spark, days[2], "dba", 0.9), ledger, "two")
    stored = spark.read.parquet(ledger)
    assert stored.count() == 12 and {r.model for r in stored.where(F.col("date") == days[2]).collect()} == {"two"}
    assert daily.resolve(spark, ledger, resolved, outcomes) == 2  # day 1 waits for its unknown outcome, day 6 for its horizon
    assert daily.resolve(spark, ledger, resolved, outcomes) == 0
    arms = {r["date"]: r for r in daily.forward_arms(spark.read.parquet(resolved)).collect()}
    assert set(arms) == {days[0], days[2]}
    net = {"a": 0.01, "b": -0.01, "c": -0.01, "d": -0.01}
    assert arms[days[0]].net == pytest.approx((0.01 - 0.02) / 3) and arms[days[0]].meta_filtered == pytest.approx(net["b"] / 3)
    assert arms[days[0]].excess == pytest.approx(arms[days[0]].net - (0.01 - 0.03) / 4)
    log = daily.trade_log(spark.read.parquet(resolved)).orderBy("date", "rank").collect()
    assert [(r.symbol, r.outcome, r.held) for r in log] == [("a", "TARGET", 2), ("b", "STOP", 3), ("c", "STOP", 3), ("d", "STOP", 3), ("b", "STOP", 3), ("a", "TARGET", 2)]


def test_live_days_replace_stored_ones(spark):
    one = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(days=1), 2.0)], "ts date, net double")
    two = spark.createDataFrame([(DAY + dt.timedelta(days=1), 5.0), (DAY + dt.timedelta(days=2), None)], "ts date, net double")
    assert [r.net for r in daily.merged_series(one, two).orderBy("ts").collect()] == [1.0, 5.0, None]


def test_cases_are_near_and_apart(spark):
    rng = np.random.default_rng(8)
    z = {(w, s): (float(rng.random()), float(rng.random())) for w in "ab" for s in range(150)}
    rows = [(w, DAY + dt.timedelta(days=s), s, *z[w, s], 1.0, 0.01 * s, 0.1, -0.1, 2.0) for w, s in z]
    df = spark.createDataFrame(rows, "symbol string, ts date, sidx int, x double, y double, ft double, exit_ret double, mfe double, mae double, days_tp double")
    sizes = analogues.Sizes(cell=30, part=20, block=4, sessions=40, leaf=4)
    got = analogues.cases(df, df.where("sidx in (3, 120, 149)"), ["x", "y"], k=4, spacing=5, sizes=sizes).collect()
    for w in "ab":
        for s in (3, 120, 149):
            far = lambda p, w=w, s=s: round(float(np.hypot(z[w, s][0] - z[p][0], z[w, s][1] - z[p][1])), 9)
            near = sorted((far(p), p[1], p[0]) for p in z if p[1] <= s - 6)
            taken = []
            for d, t, v in near:
                if v == w and len(taken) < 4 and all(abs(t - u) >= 5 for _, u, _ in taken):
                    taken.append((d, t, v))
            for scope, want in (("self", taken), ("cross", near[:4])):
                mine = sorted((r.place, r.d, r.sidx, r.who) for r in got if (r.symbol, r.ts, r.scope) == (w, DAY + dt.timedelta(days=s), scope))
                assert [m[1:] for m in mine] == want
    assert all(r.market_ret == pytest.approx(0.01 * r.sidx) for r in got)
