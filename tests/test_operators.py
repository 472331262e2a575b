"""Semantics that the SQL comparison can't show: ties, missing values, look-ahead, guards, sinks, streams, models."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.functions import average_rank, clip, content_id, equal_buckets, percentile_word, rank_by_score, verdict
from panelworks.operators import books, evaluation, evidence, labels, models, neighbours, panel_features, ranking, splits
from panelworks.sources.tables import assert_no_label_leak, name_rules, nan_to_null, session_day, sessions, with_optional

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def test_ranks_skip_missing_scores_and_break_ties_by_symbol(spark):
    df = spark.createDataFrame([(DAY, "b", 1.0), (DAY, "a", 1.0), (DAY, "c", None), (DAY, "d", 2.0)], "ts date, symbol string, p double")
    got = {r.symbol: (r.rk, r.avg) for r in df.select("symbol", rank_by_score("p", "symbol").alias("rk"), average_rank("p", "ts").alias("avg")).collect()}
    assert got == {"d": (1, 3.0), "a": (2, 1.5), "b": (3, 1.5), "c": (None, None)}


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.where("x is null").count() == 1 and df.agg(F.avg("x")).first()[0] == 1.0


@pytest.mark.parametrize("n", [1, 2, 13, 23, 57])
def test_equal_buckets_are_quantile_cuts(spark, n):
    got = [r.b for r in spark.range(1, n + 1).select("id", equal_buckets(F.col("id"), F.lit(n), 10).alias("b")).orderBy("id").collect()]
    want = (pd.qcut(np.arange(1, n + 1), 10, labels=False) + 1).tolist() if n > 1 else [1]
    assert got == want


def test_global_ranks_over_slices(spark):
    x = np.random.default_rng(1).integers(0, 50, 2000) / 7
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = {r.x: r["rank"] for r in ranking.global_average_rank(df, "x", 16).collect()}
    want = pd.Series(x).rank()
    assert all(got[v] == k for v, k in zip(x, want, strict=True))


def bars_frame(spark, n=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("x", "y"):
        price = 100.0
        for k in range(n):
            o = price * (1 + rng.normal(0, 0.02))
            c = o * (1 + rng.normal(0, 0.02))
            rows.append((s, day(k), o, max(o, c) * 1.01, min(o, c) * 0.99, c))
            price = c
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double"), rows


def test_two_label_plans_agree_and_short_symbols_have_none(spark):
    df, _ = bars_frame(spark)
    a = labels.barrier_labels(df).select("symbol", "ts", "ft_a")
    b = labels.barrier_labels_folded(df).withColumnRenamed("ft_a", "other")
    assert a.join(b, ["symbol", "ts"]).where(~F.col("ft_a").eqNullSafe(F.col("other"))).count() == 0
    assert labels.barrier_labels(df.where(F.col("ts") < day(19))).where("ft_a is not null").count() == 0


def test_labels_against_a_loop(spark):
    df, rows = bars_frame(spark)
    got = {(r.symbol, r.ts): r for r in labels.barrier_labels(df).collect()}
    own = [r for r in rows if r[0] == "x"]
    for i in range(14, len(own) - 5):
        trs = [max(own[j][3] - own[j][4], abs(own[j][3] - own[j - 1][5]), abs(own[j][4] - own[j - 1][5])) for j in range(i - 13, i + 1)]
        a = sum(trs) / 14 / own[i][5]
        touch, ret = 0.0, own[i + 5][5] / own[i][5] - 1
        for j in range(i + 1, i + 6):
            if own[j][4] / own[i][5] - 1 <= -a:
                touch, ret = -1.0, -a
                break
            if own[j][3] / own[i][5] - 1 >= 1.5 * a:
                touch, ret = 1.0, 1.5 * a
                break
        r = got["x", own[i][1]]
        assert r.ft_a == touch and math.isclose(r.xr_a, ret, rel_tol=1e-9, abs_tol=1e-12)


def test_finished_records_do_not_look_ahead(spark):
    rng = np.random.default_rng(2)
    rows = [(s, day(k), float(rng.normal())) for s in "ab" for k in range(60)]
    poisoned = [(s, t, v if t < day(30) else 1e6) for s, t, v in rows]
    schema = "symbol string, ts date, v double"
    one, two = (panel_features.shrunk_record(spark.createDataFrame(x, schema), "v").where(F.col("ts") < day(36)).orderBy("symbol", "ts").toPandas() for x in (rows, poisoned))
    pd.testing.assert_frame_equal(one.drop(columns="v"), two.drop(columns="v"))


def test_decayed_record_equals_pandas(spark):
    rng = np.random.default_rng(4)
    t = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 9, 80)), "D")
    v = np.where(rng.random(80) < 0.2, np.nan, rng.normal(size=80))
    df = nan_to_null(spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": t.date, "v": v})))
    got = panel_features.finished_record(df, "v", lag=0).orderBy("ts").toPandas()["ewm"].to_numpy(float)
    seen = pd.Series(v).notna()
    step = np.where(seen, np.r_[0, np.diff(t).astype("timedelta64[D]").astype(float)], 0).cumsum()
    want = [np.nansum((2 ** (step[: i + 1] / 365)) * np.nan_to_num(v[: i + 1]) * seen[: i + 1]) / max(((2 ** (step[: i + 1] / 365)) * seen[: i + 1]).sum(), 1e-300) for i in range(80)]
    first = seen.to_numpy().argmax()
    np.testing.assert_allclose(got[first:], want[first:], rtol=1e-9)


def test_asof_keeps_the_matched_row_even_if_its_value_is_missing(spark):
    left = spark.createDataFrame([(day(5), "a"), (day(0), "a"), (day(3), "b")], "ts date, symbol string")
    right = spark.createDataFrame([(day(1), "a", 1.0), (day(4), "a", None)], "ts date, symbol string, f double")
    got = {(r.ts, r.symbol): (r.ts_matched, r.f) for r in panel_features.asof_join(left, right).collect()}
    assert got == {(day(5), "a"): (day(4), None), (day(0), "a"): (None, None), (day(3), "b"): (None, None)}


def test_declustered_neighbours_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [("q", int(k), float(np.round(rng.random(), 3))) for k in range(60)]
    got = neighbours.declustered(spark.createDataFrame(rows, "key string, sidx long, d double"), ["key"], k=6).first().picks
    want = []
    for d, s in sorted((d, s) for _, s, d in rows):
        if len(want) < 6 and all(abs(s - u) >= 5 for _, u in want):
            want.append((d, s))
    assert [(p.d, p.sidx) for p in got] == want


def test_knn_query_takes_a_pool_of_any_size(spark):
    from panelworks.plans import catalogue

    assert catalogue.QUERIES["knn_cross"](spark, "/root/testdata/sf0.001").count() == 250


def test_knn_sharded_against_all_distances(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(90, 3)), 1)
    v[20:60] = v[20]  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (None, v[0].tolist())], "id long, v array<double>")
    got = {}
    for r in neighbours.knn_sharded(df.where("id % 5 = 0"), df, 4, shard_rows=16, block_queries=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: sorted((i for i in range(90) if i != q), key=lambda i: (round(float(np.sqrt(((v[i] - v[q]) ** 2).sum())), 9), i))[:4] for q in range(0, 90, 5)}


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int")
    assert evaluation.roc_auc(df).first().auc is None
    assert evaluation.roc_auc(df.where("p > 1")).first().auc is None


def test_bootstrap_interval_and_guard(spark):
    rng = np.random.default_rng(6)
    rows = [(day(k), float(x), 1.0 if k < 4 else None) for k, x in enumerate(rng.normal(0.5, 1, 200))]
    got = {r.series: r for r in evidence.decided(evidence.block_bootstrap(spark.createDataFrame(rows, "ts date, a double, b double"), ["a", "b"])).collect()}
    assert got["a"].lo < got["a"].mean < got["a"].hi and got["a"].verdict == "better"
    assert got["b"].lo is None and got["b"].verdict == "no clear difference" and got["b"].n_dates == 4


def test_first_loss_is_no_drawdown(spark):
    df = spark.createDataFrame([(day(0), -1.0), (day(1), 0.5), (day(2), -0.25), (day(3), -0.25)], "ts date, net double")
    r = books.curve_stats(df).first()
    assert r.max_drawdown_bp == -5000 and r.longest_losing_streak == 2


def test_empty_slots_earn_nothing(spark):
    df = spark.createDataFrame([(DAY, 1, 0.3, True, 1.0, 1)], "ts date, rk int, net double, keep boolean, size_x double, mrank int")
    assert math.isclose(books.slot_books(df).first().base, 0.1)


def test_ledger_replaces_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "ledger")
    books.write_ledger(spark.createDataFrame([(day(0), "a"), (day(1), "b")], "date date, symbol string"), path)
    books.write_ledger(spark.createDataFrame([(day(1), "c")], "date date, symbol string"), path)
    books.write_ledger(spark.createDataFrame([(day(1), "c")], "date date, symbol string"), path)
    assert sorted(r.symbol for r in spark.read.parquet(path).collect()) == ["a", "c"]


def test_streams_upsert_picks(spark, tmp_path):
    from panelworks import streaming

    schema = "date date, symbol string"
    spark.createDataFrame([(day(0), "a"), (day(1), "b")], schema).write.parquet(str(tmp_path / "in"))
    streaming.upsert_stream(streaming.picks_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_folds_leave_an_embargo(spark):
    s = sessions(spark.createDataFrame([(day(k),) for k in range(101)], "ts date"))
    folds = splits.forward_blocks(s, 4, 0.40).orderBy("block").collect()
    assert [(f.test_start - DAY).days for f in folds] == [40, 55, 70, 85]
    assert all((f.test_start - f.train_end).days == 6 for f in folds)
    assert [(r.hi - r.lo).days + 1 for r in splits.day_blocks(s).orderBy("block").collect()] == [21, 20, 20, 20, 20]


def test_walk_forward_scores_are_out_of_sample_and_calibrated_by_the_past(spark):
    rng = np.random.default_rng(7)
    rows = [(day(k), f"s{j}", float(x := rng.normal()), float(rng.random() < 1 / (1 + math.exp(-3 * x)))) for k in range(40) for j in range(10)]
    df = spark.createDataFrame(rows, "ts date, symbol string, f double, label double").withColumn("key", F.concat_ws("/", "ts", "symbol"))
    folds = splits.forward_blocks(sessions(df), 2, 0.5)
    out = models.calibrated_by_earlier_folds(models.walk_forward(df, folds, ["f"], "logistic").select("ts", "symbol", "fold", "p_raw", "label"))
    assert out.where("fold = 1 and conf_cf is not null").count() == 0
    assert out.where("fold = 2 and conf_cf between 0 and 1").count() == out.where("fold = 2").count()
    auc = evaluation.roc_auc(out.select(F.col("p_raw").alias("p"), F.col("label").cast("int").alias("y"))).first().auc
    assert auc > 0.7
    members = models.bagged(df, sessions(df), ["f"], bags=2, kind="logistic")
    got = models.bag_predictions(members, df, ["f"])
    assert got.where("spread_lo <= meta_p and meta_p <= spread_hi").count() == df.count()


def test_labels_are_no_features():
    with pytest.raises(ValueError):
        assert_no_label_leak(["D_x", "label_exit_ret"])
    got = name_rules(["timestamp", "close", "D_rsi", "GOLD_close", "X_rel_5", "MKT_vol", "INDEX_ret_1d", "label_y"])
    assert got["levels"] == ["GOLD_close"] and got["macro"] == ["X_rel_5", "MKT_vol", "INDEX_ret_1d"] and got["features"] == ["D_rsi", "X_rel_5", "MKT_vol", "INDEX_ret_1d"]


def test_small_expressions(spark):
    df = spark.createDataFrame([(95.0, -0.1, 0.2), (None, None, None)], "p double, lo double, x double")
    r, n = df.select(percentile_word(F.col("p")).alias("w"), clip(F.col("x"), 0.5, 1.5).alias("c"), verdict(F.col("lo"), F.col("x"), "b", "w").alias("v"), content_id("p").alias("i")).collect()
    assert (r.w, r.c, r.v, len(r.i)) == ("very high", 0.5, "no clear difference", 10)
    assert (n.w, n.c) == (None, None)
    assert with_optional(df, {"q": "double"}).columns[-1] == "q"
    t = spark.sql("select timestamp'2024-01-01 20:00:00' as t").select(session_day("t", "Asia/Kolkata").alias("k"), session_day("t").alias("w")).first()
    assert (t.k, t.w) == (day(1), day(0))


def test_declustered_and_unsql_queries_run(spark):
    from panelworks.plans import catalogue

    for name in ("declustered_neighbours", "block_bootstrap", "isotonic_calibrate"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
