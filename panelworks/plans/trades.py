"""More queries: outcomes, the day's book, evidence for two scores, the session axis, second-stage models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.functions import net_return
from panelworks.operators import daybook, evidence, labels, models, panel_features, ranking, splits
from panelworks.plans.catalogue import _RET, _folds, _learning, query, r, tidy
from panelworks.plans.oracle import interval_sql, sql
from panelworks.plans.views import labelled, scores, stored_bars
from panelworks.sources.tables import bars, scan, sessions

_NAMES = ("mfe", "mae", "xr_s")


@query(sql("labels", f"SELECT symbol, ts, ft_a::BIGINT AS ft, days_tp, days_sl, {r(*_NAMES)} FROM labels_all WHERE ft_a IS NOT NULL"))
def label_outcomes(spark, d):
    x = labelled(spark, d).where("ft_a is not null").withColumn("ft", F.col("ft_a").cast("long"))
    return tidy(x, "symbol", "ts", "ft", "days_tp", "days_sl", *_NAMES)


@query(sql("labels", f"SELECT symbol, ts, {r('xr_a', 'xr_b', 'xr_c', 'gap1')} FROM labels_all SEMI JOIN (SELECT p_brand AS symbol, CAST(date_trunc('week', min(l_shipdate)) AS DATE) + 210 AS ts FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand < 'Brand#3' GROUP BY p_brand) USING (symbol, ts)"))
def labels_for_keys(spark, d):
    """Labels of one wanted session a symbol, thirty weeks after its first bar, for half of the symbols."""
    b = stored_bars(spark, d)
    keys = b.where("symbol < 'Brand#3'").groupBy("symbol").agg(F.date_add(F.min("ts"), 210).alias("ts"))
    return tidy(labels.labels_for(b, keys).select("symbol", "ts", "xr_a", "xr_b", "xr_c", "gap1"))


_VALUE = "p_raw * 1.5 * atr / close - (1 - p_short) * atr / close + greatest(0.0, 1 - p_raw - (1 - p_short)) * (SELECT avg(exit_ret) FROM scores WHERE ft = 0) - 0.0035"
_BRACKET = r("close * (1 + 1.5 * atr / close)=>target", "close * (1 - atr / close)=>stop", "close * (1 + 2.0 * atr / close)=>stretch", f"({_VALUE}) * 1e4=>ev_bp")
_PCT = "1 - (rk - 1) / count(*) OVER (PARTITION BY ts)::DOUBLE=>pct"


def _candidates(s):
    s = s.withColumns({"confidence": F.col("p_raw"), "p_sl": 1 - F.col("p_short")})
    timeout = s.where("ft = 0").agg(F.avg("exit_ret").alias("timeout_mean"))
    return s.crossJoin(F.broadcast(timeout))  # one row


@query(sql("scores", f"SELECT ts, symbol, rk AS rank, {r(_PCT)}, {_BRACKET} FROM ranked"))
def expected_values(spark, d):
    """Rank percentile, brackets and expected value of every symbol and session."""
    x = daybook.watchlist(_candidates(scores(spark, d)), F.col("timeout_mean"), None)
    return tidy(x, "ts", "symbol", "rank", "pct", "target", "stop", "stretch", "ev_bp")


@query(sql("scores", f"SELECT w.ts, w.symbol, w.rank, w.target, w.stop, w.ev_bp, {r('h.net_bp=>hist_net_bp', 'h.hit=>hist_hit')} FROM (SELECT ts, symbol, rk AS rank, {_BRACKET} FROM ranked WHERE ts = (SELECT max(ts) FROM scores) AND rk <= 10) w LEFT JOIN (SELECT rk, avg(net) * 1e4 AS net_bp, avg(hit) AS hit FROM ranked GROUP BY rk) h ON h.rk = w.rank"))
def watchlist(spark, d):
    """The latest session's ten best with their brackets and the record of their rank."""
    s = scores(spark, d)
    record = ranking.rank_track_record(s).select(F.col("rk").alias("rank"), F.col("net_bp").alias("hist_net_bp"), F.col("hit").alias("hist_hit"))
    x = daybook.watchlist(daybook.latest_session(_candidates(s)), F.col("timeout_mean")).join(F.broadcast(record), "rank", "left")
    return tidy(x, "ts", "symbol", "rank", "target", "stop", "ev_bp", "hist_net_bp", "hist_hit")


_DECIDED = """
tau AS (SELECT quantile_cont(p_short, 0.3) AS tau FROM ranked WHERE rk <= 3),
de AS (SELECT *, CASE WHEN rk <= 3 THEN greatest(0.5, least(1.5, p_short / avg(CASE WHEN rk <= 3 THEN p_short END) OVER (PARTITION BY ts))) END AS w FROM ranked CROSS JOIN tau)"""


@query(sql("scores", f"SELECT ts, symbol, rk, CASE WHEN rk > 3 THEN '-' WHEN p_short >= tau THEN 'TRADE' ELSE 'SKIP' END AS action, {r('w * 3 / sum(w) OVER (PARTITION BY ts)=>size_x')}, CASE WHEN rk <= 5 THEN row_number() OVER (PARTITION BY ts, rk <= 5 ORDER BY p_short DESC NULLS LAST, rk) END AS meta_rank FROM de", _DECIDED))
def meta_decisions(spark, d):
    """The cut at the 0.3 quantile of the top three's second scores, sizes and the new ranks of the pool."""
    x = ranking.ranked(scores(spark, d))
    tau = x.where("rk <= 3").agg(F.percentile("p_short", 0.3).alias("tau"))
    return tidy(daybook.decisions(x.crossJoin(F.broadcast(tau)), F.col("tau"), meta="p_short"), "ts", "symbol", "rk", "action", "size_x", "meta_rank")


@query(sql("bars", "SELECT symbol, ts, close + 0.0 AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS back FROM bars QUALIFY back < 15"))
def last_bars(spark, d):
    return daybook.last_rows(bars(spark, d), 15).select("symbol", "ts", "close", "back")


_EVENT = "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {0}, event_id {0}) = 1"


@query(_EVENT.format("ASC"))
def keep_first(spark, d):
    x = scan(spark, d, "events", "user_id", "event_type", "ts", "event_id", "value")
    return daybook.kept(x, ["user_id", "event_type"], ["ts", "event_id"])


@query(_EVENT.format("DESC"))
def keep_last(spark, d):
    x = scan(spark, d, "events", "user_id", "event_type", "ts", "event_id", "value")
    return daybook.kept(x, ["user_id", "event_type"], ["ts", "event_id"], last=True)


@query(sql("scores", "SELECT ts, sidx FROM axis WHERE sidx < n - 1 AND (sidx >= n - 7 OR sidx > floor(n * 0.9) - 1)"))
def sessions_to_score(spark, d):
    """Before the latest session: the six before it and all after the first nine tenths."""
    axis = sessions(scores(spark, d)).withColumn("sidx", F.col("sidx").cast("long"))
    ends = axis.agg(F.max("ts").alias("day"), F.count("*").alias("n")).crossJoin(axis).where(F.col("sidx") <= F.floor(F.col("n") * 0.9) - 1).groupBy("day").agg(F.max("ts").alias("through"))
    return daybook.recent_sessions(axis.crossJoin(F.broadcast(ends)), F.col("day"), F.col("through")).select("ts", "sidx")  # one row


@query(sql("scores", f"SELECT a.ts, {r('x.net=>net')} FROM axis a LEFT JOIN (SELECT ts, avg(net) AS net FROM ranked WHERE rk <= 3 AND ft = 1 GROUP BY ts) x USING (ts)"))
def densified_series(spark, d):
    """The daily net of picks that reached their target, a row for every session."""
    s = scores(spark, d)
    hits = ranking.ranked(s).where("rk <= 3 and ft = 1").groupBy("ts").agg(F.avg(net_return()).alias("net"))
    return tidy(daybook.densified(hits, sessions(s)))


_MARKET = """
m0 AS (SELECT ts, avg(ret1) AS mk_ret1, avg((ret1 > 0)::INT) AS mk_breadth, stddev_samp(ret1) AS mk_dispersion FROM rg GROUP BY ts),
m1 AS (SELECT *, CASE WHEN count(mk_ret1) OVER f >= 10 THEN stddev_samp(mk_ret1) OVER f END AS mk_vol20 FROM m0 WINDOW f AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(sql("bars", f"SELECT ts, {r('mk_ret1', 'mk_breadth', 'mk_dispersion', 'mk_vol20', 'CASE WHEN mk_vol20 IS NOT NULL THEN count(mk_vol20) OVER (ORDER BY mk_vol20 RANGE UNBOUNDED PRECEDING) / count(*) OVER ()::DOUBLE END=>vol_share')} FROM m1", _RET + "," + _MARKET))
def market_state(spark, d):
    state = daybook.market_state(panel_features.returns_and_gaps(stored_bars(spark, d)))
    return tidy(daybook.share_at_most(state, "mk_vol20", "vol_share"))


@query(sql("labels", "SELECT bool_or(ft_a IS NOT NULL) AS ft_a, bool_or(days_tp IS NOT NULL) AS days_tp, bool_or(CASE WHEN close < 0 THEN close END IS NOT NULL) AS below FROM labels_all"))
def any_present(spark, d):
    return daybook.present(labelled(spark, d).withColumn("below", F.when(F.col("close") < 0, F.col("close"))), ["ft_a", "days_tp", "below"])


@query(sql("labels", f"SELECT count(*) AS n, {r('max(abs(xr_a - xr_b))=>max_difference')} FROM labels_all WHERE xr_a IS NOT NULL AND xr_b IS NOT NULL"))
def largest_difference(spark, d):
    return tidy(daybook.largest_difference(labelled(spark, d), "xr_a", "xr_b"))


@query(sql("scores", f"SELECT symbol, count(*) AS n, {r('avg((ft = 1)::INT)=>target_first', 'avg((ft = -1)::INT)=>stop_first', 'avg((ft = 0)::INT)=>timeout', 'avg(exit_ret)=>avg_ret', 'median(mfe)=>median_mfe', 'median(mae)=>median_mae', 'avg(days_tp) FILTER (ft = 1)=>avg_days_to_target')} FROM scores GROUP BY symbol"))
def analogue_summary(spark, d):
    return tidy(daybook.analogue_summary(scores(spark, d), ["symbol"]))


_TWO = "two AS (SELECT ts, avg(net) FILTER (rk <= 3) AS long_net, avg(net) FILTER (rs <= 3) AS short_net FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY p_short DESC NULLS LAST, symbol) AS rs FROM ranked) GROUP BY ts)"


def _two(s):
    day = Window.partitionBy("ts")
    x = ranking.ranked(s).withColumns({"rs": F.row_number().over(day.orderBy(F.col("p_short").desc_nulls_last(), "symbol")), "net": net_return()})
    return x.groupBy("ts").agg(*[F.avg(F.when(F.col(k) <= 3, F.col("net"))).alias(name) for k, name in (("rk", "long_net"), ("rs", "short_net"))])


@query(sql("scores", f"SELECT block, {r('avg(long_net)=>long_net', 'avg(short_net)=>short_net')}, avg(short_net) > avg(long_net) AS won FROM folds JOIN two ON ts BETWEEN test_start AND test_end GROUP BY block", _TWO + ", folds AS (" + _folds(0.35, 5) + ")"))
def fold_wins(spark, d):
    """Two scores on the same folds: which picks the better three?"""
    s = scores(spark, d)
    return tidy(daybook.fold_wins(_two(s), splits.forward_blocks(sessions(s)), "long_net", "short_net"))


@query(sql("scores", "SELECT CASE WHEN sidx < floor(n * 0.85) - 5 THEN 'research' WHEN sidx >= floor(n * 0.85) THEN 'lockbox' ELSE 'gap' END AS part, min(ts) AS lo, max(ts) AS hi, count(*) AS n_rows FROM scores JOIN axis USING (ts) GROUP BY 1"))
def lockbox(spark, d):
    s = scores(spark, d)
    x = s.join(F.broadcast(splits.lockbox_parts(sessions(s))), "ts")
    return x.groupBy("part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n_rows"))


@query(sql("scores", "SELECT block, count(*) FILTER (s.ts NOT BETWEEN lo - 10 AND hi + 10) AS n_train, count(*) FILTER (s.ts BETWEEN lo AND hi) AS n_block FROM scores s, (SELECT block, min(ts) AS lo, max(ts) AS hi FROM (SELECT ts, ntile(5) OVER (ORDER BY ts) AS block FROM axis) GROUP BY block) GROUP BY block"))
def block_training(spark, d):
    """For each block of days the rows outside its guard band and the rows inside."""
    s = scores(spark, d)
    parts = [splits.held_out(s, b).agg(F.lit(b["block"]).cast("long").alias("block"), F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "block").alias("n_block")) for b in splits.day_blocks(sessions(s)).collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_TOPS = "tn AS (SELECT ts, " + ", ".join(f"avg({c}) FILTER (rk <= {n}) AS {c}_{n}" for n in (1, 3, 5, 10) for c in ("hit", "net")) + " FROM ranked GROUP BY ts)"
_TOP_SERIES = ", ".join(f"{c}_{n}" for n in (1, 3, 5, 10) for c in ("hit", "net"))


@query(sql("scores", f"SELECT split_part(series, '_', 2)::BIGINT AS top_n, split_part(series, '_', 1) AS measure, n_dates, series LIKE 'net%' AND coalesce(lo > 0, false) AS clears, {r('mean', 'lo', 'hi')} FROM intervals", _TOPS + "," + interval_sql(f"SELECT name AS series, ts, value FROM (UNPIVOT tn ON {_TOP_SERIES})")))
def topn_evidence(spark, d):
    return tidy(evidence.topn_evidence(scores(spark, d)))


FEATURES = ["p_short", "ret5", "gapvol20"]


@query()
def meta_model(spark, d):
    """Second-stage scores of every labelled row, calibrated out of fold, with their band and the cut."""
    x, s = _learning(spark, d)
    x = ranking.ranked(x)
    fitted = models.fit_meta(x, sessions(s), FEATURES)
    out = models.predict_meta(fitted, x, FEATURES)
    return out.select("ts", "symbol", "meta_p", "spread_lo", "spread_hi", F.lit(fitted.tau).alias("tau"))


@query()
def model_bundle(spark, d):
    """The five models fitted on the first three quarters of the sessions, applied to the rest."""
    x, s = _learning(spark, d)
    parts = x.join(F.broadcast(splits.calibration_split(sessions(s))), "ts")
    fitted = models.fit_bundle(parts.where("part = 'fit'"), FEATURES)
    return models.predict_bundle(fitted, parts.where("part = 'calibrate'"), FEATURES).select("ts", "symbol", "raw", "p_sl", "mfe_hat", "mae_hat", "days_hat")
