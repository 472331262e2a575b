"""Queries over the driver's tables, one per operator or family, and their SQL for DuckDB.

Floats are rounded to six places on both sides, as sums in other orders differ in their last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.functions import net_return, outcome_name, percentile_word
from panelworks.operators import books, evaluation, evidence, labels, models, neighbours, panel_features, ranking, sampling, splits
from panelworks.plans.oracle import interpolated, interval_sql, isotonic_sql, sql
from panelworks.plans.views import labelled, scores, stored_bars
from panelworks.sources.durable import durable
from panelworks.sources.tables import bars, day_panel, scan, scored_docs, sessions

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Integers as long, floats rounded, the columns named in their order."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if kinds[c] in ("double", "float") or kinds[c].startswith("decimal"):
            # Adding zero turns the negative zero that rounding can give into zero.
            out.append((F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c))
    return df.select(*out)


def r(*columns: str) -> str:
    """Rounded columns in SQL; ``expression=name`` renames."""
    out = []
    for c in columns:
        e, _, name = c.rpartition("=>")
        out.append(f"round({e or name}, 6) + 0.0 AS {name}")
    return ", ".join(out)


@query(sql("bars", "SELECT symbol, ts, open, high, low, close, volume FROM bars"))
def bars_weekly(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d)


@query(sql("labels", f"SELECT symbol, ts, {r('tr + 1e-9=>tr', 'atr + 1e-9=>atr')} FROM atr"))
def atr14(spark, d):
    """A billionth on top lets ties at the sixth place go up, whichever way an engine rounds them."""
    return tidy(labels.average_true_range(bars(spark, d)).withColumns({c: F.col(c) + 1e-9 for c in ("tr", "atr")}), "symbol", "ts", "tr", "atr")


def _version(v: str):
    @query(sql("labels", f"SELECT symbol, ts, ft_{v}::BIGINT AS ft, {r(f'xr_{v}=>xr')} FROM labels_all WHERE ft_{v} IS NOT NULL"))
    def barrier_labels(spark, d):
        x = labelled(spark, d).where(F.col(f"ft_{v}").isNotNull())
        return tidy(x.select("symbol", "ts", F.col(f"ft_{v}").cast("long").alias("ft"), F.col(f"xr_{v}").alias("xr")))

    for table in (QUERIES, ORACLE_SQL):
        table[f"barrier_labels_{v}"] = table.pop("barrier_labels")


for _v in "abc":
    _version(_v)


@query(sql("labels", "SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM labels_all WHERE ft_a IS NOT NULL"))
def label_selfcheck(spark, d):
    b = stored_bars(spark, d)
    one, other = labels.barrier_labels(b).select("symbol", "ts", "ft_a"), labels.barrier_labels_folded(b).withColumnRenamed("ft_a", "ft_fold")
    return one.join(other, ["symbol", "ts"]).where("ft_a is not null or ft_fold is not null").agg(F.count("*").alias("n_rows"), F.sum((~F.col("ft_a").eqNullSafe(F.col("ft_fold"))).cast("long")).alias("n_different"))


@query(sql("scores", f"SELECT ts, {r('top_net', 'universe_net', 'top_net - universe_net=>excess')}, picks FROM (SELECT ts, avg(net) FILTER (rk <= 3) AS top_net, avg(net) AS universe_net, count(*) FILTER (rk <= 3) AS picks FROM ranked GROUP BY ts)"))
def topn_vs_universe(spark, d):
    return tidy(ranking.topn_vs_universe(scores(spark, d)))


@query(sql("scores", f"SELECT ts, symbol, rk, {r('p_raw')} FROM ranked WHERE rk <= 10"))
def daily_rank_topn(spark, d):
    return tidy(ranking.ranked(scores(spark, d)).where("rk <= 10"), "ts", "symbol", "rk", "p_raw")


@query(sql("scores", f"SELECT top_n, count(*) AS signals, count(DISTINCT ts) AS sessions, {r('avg(y)=>realised', '2 * sqrt(avg(y) * (1 - avg(y)) / count(*))=>se2', 'avg(p_raw)=>mean_score')} FROM ranked JOIN (SELECT unnest([1, 3, 5, 10])::BIGINT AS top_n) ON rk <= top_n GROUP BY top_n"))
def topn_hit_table(spark, d):
    return tidy(ranking.topn_hit_table(scores(spark, d)))


@query(sql("scores", f"SELECT rk, count(*) AS days, {r('avg(net) * 1e4=>net_bp', 'avg(net - uni) * 1e4=>excess_bp', 'avg(hit)=>hit', 'avg(xr_s - 0.0035) * 1e4=>stretch_net_bp')} FROM (SELECT *, avg(net) OVER (PARTITION BY ts) AS uni FROM ranked) WHERE rk <= 10 GROUP BY rk"))
def rank_track_record(spark, d):
    return tidy(ranking.rank_track_record(scores(spark, d)))


_RANKS = "rnk AS (SELECT ts, symbol, v, rank() OVER (PARTITION BY ts ORDER BY v) + (count(*) OVER (PARTITION BY ts, v) - 1) / 2.0 AS a, count(*) OVER (PARTITION BY ts) AS k FROM (SELECT ts, symbol, floor(value / 5) AS v FROM panel))"


@query(sql("panel", f"SELECT ts, symbol, {r('a=>avg_rank', 'a / k=>pct_rank')} FROM rnk", _RANKS))
def value_ranks(spark, d):
    p = day_panel(spark, d).withColumn("v", F.floor(F.col("value") / 5))
    return tidy(ranking.value_ranks(p, "v"), "ts", "symbol", "avg_rank", "pct_rank")


def _avg_rank(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


@query(sql("scores", f"SELECT ts, symbol, {r('(a / k + b / k) / 2=>ensemble')} FROM (SELECT ts, symbol, {_avg_rank('p_raw', 'ts')} AS a, {_avg_rank('p_short', 'ts')} AS b, count(*) OVER (PARTITION BY ts) AS k FROM scores WHERE p_short IS NOT NULL)"))
def rank_ensemble(spark, d):
    return tidy(ranking.rank_ensemble(scores(spark, d).where("p_short is not null"), ["p_raw", "p_short"]), "ts", "symbol", "ensemble")


_RHO = f"rho AS (SELECT ts, corr(a, b) AS rho, count(*) AS n FROM (SELECT ts, {_avg_rank('p_raw', 'ts')} AS a, {_avg_rank('exit_ret', 'ts')} AS b FROM scores) GROUP BY ts HAVING count(*) >= 5)"


@query(sql("scores", f"SELECT ts, {r('rho')}, n FROM rho", _RHO))
def rank_corr_by_date(spark, d):
    return tidy(ranking.rank_correlation_by_date(scores(spark, d), "p_raw", "exit_ret"))


@query(sql("scores", f"SELECT {r('avg(rho)=>rank_ic', 'median(abs(rho))=>median_abs')}, count(rho) AS sessions FROM rho", _RHO))
def rank_ic(spark, d):
    return tidy(ranking.rank_ic(scores(spark, d), "p_raw", "exit_ret"))


@query(sql("scores", f"SELECT {r('CASE WHEN count(*) >= 50 THEN corr(a, b) END=>rho')}, count(*) AS n FROM (SELECT {_avg_rank('p_raw', '1')} AS a, {_avg_rank('exit_ret', '1')} AS b FROM scores)"))
def spearman_guarded(spark, d):
    return tidy(ranking.spearman(scores(spark, d), "p_raw", "exit_ret"))


_BUCKET = "greatest(ceil((rn - 1) * {q} / (k - 1)), 1)::BIGINT"


@query(sql("docs", f"SELECT bucket, count(*) AS n, {r('avg(p)=>predicted', 'avg(y)=>realised', 'min(p)=>lo', 'max(p)=>hi', '2 * sqrt(avg(y) * (1 - avg(y)) / count(*))=>se2')} FROM (SELECT *, {_BUCKET.format(q=10)} AS bucket FROM (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS rn, count(*) OVER () AS k FROM docs)) GROUP BY bucket"))
def calibration_table(spark, d):
    return tidy(evaluation.calibration_table(scored_docs(spark, d), "p", "doc_id"))


@query(sql("scores", f"SELECT bucket, count(*) AS n, {r('avg(p_raw)=>predicted', 'avg(y)=>realised', 'avg(net) * 1e4=>net_bp')} FROM (SELECT *, {_BUCKET.format(q=5)} AS bucket FROM (SELECT *, row_number() OVER (ORDER BY p_raw, ts, symbol) AS rn, count(*) OVER () AS k FROM ranked WHERE rk <= 3)) GROUP BY bucket"))
def decile_reliability(spark, d):
    top = ranking.ranked(scores(spark, d)).where("rk <= 3").withColumns({"net": net_return(), "key": F.struct("ts", "symbol")})
    return tidy(evaluation.bucketed(top, "p_raw", "key", 5).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p_raw").alias("predicted"), F.avg("y").alias("realised"), (F.avg("net") * 1e4).alias("net_bp")))


@query(sql("docs", f"SELECT round(t, 2) AS threshold, n, {r('n / total::DOUBLE=>share', 'r=>realised', '2 * sqrt(r * (1 - r) / n)=>se2')}, r - 2 * sqrt(r * (1 - r) / n) > 0.424 AS clears, {r('r - 0.424=>margin')} FROM (SELECT t, count(*) AS n, avg(y) AS r, max(total) AS total FROM (SELECT 0.20::DOUBLE + k * 0.02::DOUBLE AS t FROM range(26) x(k)) JOIN (SELECT *, count(*) OVER () AS total FROM docs) ON p >= t GROUP BY t HAVING count(*) >= 50)"))
def threshold_sweep(spark, d):
    return tidy(evaluation.threshold_sweep(scored_docs(spark, d)))


@query(sql("docs", f"SELECT sum(y)::BIGINT AS n1, (count(*) - sum(y))::BIGINT AS n0, {r('(sum(a) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))=>auc')} FROM (SELECT y, {_avg_rank('p', '1')} AS a FROM docs)"))
def roc_auc(spark, d):
    return tidy(evaluation.roc_auc(scored_docs(spark, d)))


@query(sql("docs", f"SELECT {r('logloss', 'brier', 'base_rate', '1 - brier / (base_rate * (1 - base_rate))=>brier_skill')} FROM (SELECT avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS logloss, avg((p - y) * (p - y)) AS brier, avg(y) AS base_rate FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM docs))"))
def logloss_brier_skill(spark, d):
    return tidy(evaluation.losses(scored_docs(spark, d)))


@query(sql("scores", f"SELECT {r('avg(abs(p_raw - 0.5 - exit_ret))=>error_model', 'avg(abs(m - exit_ret))=>error_naive')}, avg(abs(p_raw - 0.5 - exit_ret)) < avg(abs(m - exit_ret)) AS better FROM (SELECT *, (SELECT median(exit_ret) FROM scores) AS m FROM scores)"))
def mae_vs_naive(spark, d):
    return tidy(evaluation.error_vs_naive(scores(spark, d).withColumn("guess", F.col("p_raw") - 0.5), "guess", "exit_ret"))


@query(sql("scores", f"""SELECT ts, symbol, rk, {r('score_z', 'gap_next', 'third - fourth=>day_gap_3_4')}, count(*) FILTER (near)::BIGINT AS top_crowding FROM (
SELECT a.ts, a.symbol, a.rk, a.score_z, a.gap_next, a.third, a.fourth, b.p_raw >= a.third * 0.99 AS near FROM st a JOIN ranked b USING (ts) WHERE a.rk <= 10) GROUP BY ALL""", "st AS (SELECT ts, symbol, rk, (p_raw - avg(p_raw) OVER d) / nullif(stddev_samp(p_raw) OVER d, 0) AS score_z, p_raw - lead(p_raw) OVER (PARTITION BY ts ORDER BY rk) AS gap_next, max(CASE WHEN rk = 3 THEN p_raw END) OVER d AS third, max(CASE WHEN rk = 4 THEN p_raw END) OVER d AS fourth FROM ranked WINDOW d AS (PARTITION BY ts))"))
def score_standing(spark, d):
    return tidy(panel_features.score_standing(scores(spark, d)), "ts", "symbol", "rk", "score_z", "gap_next", "day_gap_3_4", "top_crowding")


@query(sql("panel", "SELECT ts, symbol, rk, CASE WHEN sidx > 0 THEN coalesce(sum(CASE WHEN rk <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY sidx RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS presence FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value DESC, symbol) AS rk, dense_rank() OVER (ORDER BY ts) - 1 AS sidx FROM panel)"))
def top10_presence5(spark, d):
    return tidy(panel_features.presence(day_panel(spark, d), "value"))


def _form(w: int) -> str:
    frame = f"(ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(known) OVER {frame} >= {max(3, w // 2)} THEN avg(known) OVER {frame} END=>form_{w}"


@query(sql("scores", f"SELECT ts, {r(_form(5), _form(20), _form(60))} FROM (SELECT ts, lag(net, 6) OVER (ORDER BY ts) AS known FROM (SELECT ts, avg(net) AS net FROM ranked WHERE rk <= 3 GROUP BY ts))"))
def model_form(spark, d):
    return tidy(panel_features.model_form(scores(spark, d)))


_EWM = """
kn AS (SELECT symbol, ts, xr_a, lag(xr_a, 6) OVER w AS known, coalesce(date_diff('day', lag(ts) OVER w, ts), 0) AS days FROM labels_all WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ag AS (SELECT *, sum(CASE WHEN known IS NOT NULL THEN days ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS age FROM kn),
ew AS (SELECT symbol, ts, sum(pow(2.0, age / 365.0) * known) OVER u / sum(CASE WHEN known IS NOT NULL THEN pow(2.0, age / 365.0) END) OVER u AS ewm, count(known) OVER u AS n_known FROM ag WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
dm AS (SELECT ts, avg(xr_a) AS m FROM labels_all GROUP BY ts),
dw AS (SELECT ts, m, CASE WHEN m IS NOT NULL THEN pow(2.0, count(m) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) / 250.0) END AS w FROM dm),
pr AS (SELECT ts, lag(e, 6) OVER (ORDER BY ts) AS prior FROM (SELECT ts, sum(w * m) OVER u / sum(w) OVER u AS e FROM dw WINDOW u AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)))"""


@query(sql("labels", f"SELECT symbol, ts, {r('ewm')}, n_known FROM ew", _EWM))
def ewm_personality(spark, d):
    return tidy(panel_features.finished_record(labelled(spark, d), "xr_a"), "symbol", "ts", "ewm", "n_known")


@query(sql("labels", f"SELECT ts, {r('prior')} FROM pr", _EWM))
def market_prior(spark, d):
    return tidy(panel_features.market_prior(labelled(spark, d), "xr_a"))


@query(sql("labels", f"SELECT symbol, ts, {r('n_eff', 'shrunk', 'shrunk - prior=>vs_market')} FROM (SELECT symbol, ts, prior, least(n_known, 500) / 5.0 AS n_eff, CASE WHEN n_known >= 20 THEN (least(n_known, 500) / 5.0 * ewm + 30 * prior) / (least(n_known, 500) / 5.0 + 30) END AS shrunk FROM ew LEFT JOIN pr USING (ts))", _EWM))
def shrunk_record(spark, d):
    return tidy(panel_features.shrunk_record(labelled(spark, d), "xr_a"), "symbol", "ts", "n_eff", "shrunk", "vs_market")


_RET = """
rt AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret1, close / lag(close, 5) OVER w - 1 AS ret5, open / lag(close) OVER w - 1 AS gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
rg AS (SELECT symbol, ts, ret1, ret5, CASE WHEN count(gap) OVER f >= 10 THEN stddev_samp(gap) OVER f END AS gapvol20 FROM rt WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(sql("bars", f"SELECT symbol, ts, {r('ret1', 'ret5', 'gapvol20')} FROM rg", _RET))
def returns_gapvol(spark, d):
    return tidy(panel_features.returns_and_gaps(bars(spark, d)))


@query(sql("panel", f"SELECT l.ts, l.symbol, {r('l.value=>value')}, r.ts AS ts_matched, {r('r.feature=>feature')} FROM panel l ASOF LEFT JOIN (SELECT CAST(date_trunc('day', ts) AS DATE) AS ts, user_id AS symbol, CASE WHEN count(*) > 1 THEN max(value) END AS feature FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL) r ON l.symbol = r.symbol AND l.ts >= r.ts"))
def asof_features(spark, d):
    """Each user's day with their last day of the first event type, whose feature is missing where a day has one such event only."""
    events = scan(spark, d, "events", "ts", "user_id", "event_type", "value")
    first = events.join(F.broadcast(events.agg(F.min("event_type").alias("event_type"))), "event_type", "left_semi")  # one row
    right = first.groupBy(F.to_date("ts").alias("ts"), F.col("user_id").alias("symbol")).agg(F.when(F.count("*") > 1, F.max("value")).alias("feature"))
    return tidy(panel_features.asof_join(day_panel(spark, d), right))


@query("""WITH l AS (SELECT CAST(o_orderdate AS DATE) AS ts, o_custkey AS symbol, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
r AS (SELECT CAST(l_shipdate AS DATE) AS ts, o_custkey AS symbol, sum(l_quantity)::DOUBLE AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT l.ts, l.symbol, l.value + 0.0 AS value, r.ts AS ts_matched, r.feature FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts >= r.ts""")
def asof_shipments(spark, d):
    """The as-of join over whole tables: each customer's day of orders with their last day of shipments."""
    orders = scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("symbol", F.col("o_custkey"))
    left = orders.groupBy(F.to_date("o_orderdate").alias("ts"), "symbol").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    items = scan(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return tidy(panel_features.asof_join(left, items.groupBy(F.to_date("l_shipdate").alias("ts"), "symbol").agg(F.sum("l_quantity").cast("double").alias("feature"))))


_BENCH = "bench AS (SELECT ts, close, row_number() OVER (ORDER BY ts) AS i FROM bars WHERE symbol = 'Brand#11'), tr3 AS (SELECT *, CASE ft WHEN 1 THEN days_tp WHEN -1 THEN days_sl ELSE 5 END AS hold FROM ranked WHERE rk <= 3)"
_HEDGED = f"SELECT t.ts, t.symbol, t.rk, {r('e.close / s.close - 1=>bench', 't.net - (e.close / s.close - 1) - 0.0003=>hedged')} FROM tr3 t LEFT JOIN bench s ON t.ts = s.ts LEFT JOIN bench e ON e.i = s.i + t.hold"


def _hedged(picks, b):
    """Net of the benchmark over the sessions a trade was held: to its target, to its stop, or all five."""
    held = picks.withColumn("hold", F.when(F.col("ft") == 1, F.col("days_tp")).when(F.col("ft") == -1, F.col("days_sl")).otherwise(5))
    bench = b.where("symbol = 'Brand#11'").select("ts", "close")
    return panel_features.holding_return(held, bench).withColumn("hedged", F.col("net") - F.col("bench") - 3 / 1e4)


@query(sql("scores", _HEDGED, _BENCH))
def hold_period_hedge(spark, d):
    b = stored_bars(spark, d)
    top = ranking.ranked(scores(spark, d, b)).where("rk <= 3").withColumn("net", net_return())
    return tidy(_hedged(top, b), "ts", "symbol", "rk", "bench", "hedged")


_DAILY = "dl AS (SELECT ts, avg(net) AS net FROM ranked WHERE rk <= 3 GROUP BY ts)"


def _daily(spark, d):
    return ranking.ranked(scores(spark, d)).where("rk <= 3").groupBy("ts").agg(F.avg(net_return()).alias("net"))


@query(sql("scores", f"""SELECT (SELECT count(*) FROM c) AS days, {r('(SELECT avg(net) FROM c) * 1e4=>mean_bp', '(SELECT avg((net > 0)::INT) FROM c)=>positive_days', '(SELECT sum(net) FROM c) * 1e4=>total_bp', '(SELECT min(cum - peak) FROM c) * 1e4=>max_drawdown_bp')},
coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT net, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY net < 0 ORDER BY ts) AS g FROM c) WHERE net < 0 GROUP BY g)), 0)::BIGINT AS longest_losing_streak,
{r('(SELECT avg((m > 0)::INT) FROM mo)=>positive_months')}, (SELECT month FROM mo ORDER BY m, month LIMIT 1) AS worst_month, (SELECT month FROM mo ORDER BY m DESC, month DESC LIMIT 1) AS best_month""", _DAILY + ", c0 AS (SELECT ts, net, sum(net) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM dl), c AS (SELECT *, max(cum) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM c0), mo AS (SELECT strftime(ts, '%Y-%m') AS month, sum(net) AS m FROM dl GROUP BY 1)"))
def curve_stats(spark, d):
    return tidy(books.curve_stats(_daily(spark, d)), "days", "mean_bp", "positive_days", "total_bp", "max_drawdown_bp", "longest_losing_streak", "positive_months", "worst_month", "best_month")


@query(sql("scores", " UNION ALL ".join(f"SELECT '{u}' AS unit, CAST(date_trunc('{u}', ts) AS DATE) AS period, count(net) AS days, {r('avg(net) * 1e4=>mean_bp', 'sum(net) * 1e4=>total_bp')} FROM dl GROUP BY 2" for u in ("month", "quarter", "year")), _DAILY))
def month_quarter_year_rollup(spark, d):
    daily = _daily(spark, d)
    parts = [books.rollup(daily, u).select(F.lit(u).alias("unit"), "*") for u in ("month", "quarter", "year")]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_ARMS = """
a0 AS (SELECT *, rk <= 3 AND p_short >= 0.5 AS keep, row_number() OVER (PARTITION BY ts ORDER BY p_short DESC NULLS LAST, symbol) AS mrank FROM ranked WHERE rk <= 5),
a1 AS (SELECT *, CASE WHEN rk <= 3 THEN greatest(0.5, least(1.5, p_raw / avg(CASE WHEN rk <= 3 THEN p_raw END) OVER (PARTITION BY ts))) END AS w FROM a0),
arms AS (SELECT *, w * 3 / sum(w) OVER (PARTITION BY ts) AS size_x FROM a1)"""


def _arms(spark, d, b=None):
    """The day's five best with their universe's mean, from one pass over the scores."""
    day, top = Window.partitionBy("ts"), F.col("rk") <= 3
    pool = ranking.ranked(scores(spark, d, b)).withColumn("net", net_return()).withColumn("uni", F.avg("net").over(day)).where("rk <= 5")
    pool = pool.withColumns({"keep": top & F.coalesce(F.col("p_short") >= 0.5, F.lit(False)), "mrank": F.row_number().over(day.orderBy(F.col("p_short").desc_nulls_last(), "symbol")), "_top": F.when(top, F.col("p_raw"))})
    return books.position_sizes(pool, score="_top").drop("_top")


@query(sql("scores", f"SELECT ts, symbol, rk, {r('size_x')} FROM arms WHERE rk <= 3", _ARMS))
def position_size(spark, d):
    return tidy(_arms(spark, d).where("rk <= 3"), "ts", "symbol", "rk", "size_x")


_BOOKS = f"SELECT ts, {r('sum(CASE WHEN rk <= 3 THEN net ELSE 0 END) / 3=>base', 'sum(CASE WHEN rk <= 3 AND keep THEN net ELSE 0 END) / 3=>filtered', 'sum(CASE WHEN rk <= 3 THEN net * coalesce(size_x, 1) ELSE 0 END) / 3=>sized', 'sum(CASE WHEN mrank <= 3 THEN net ELSE 0 END) / 3=>reranked')} FROM arms GROUP BY ts"


@query(sql("scores", _BOOKS, _ARMS))
def slot_books(spark, d):
    return tidy(books.slot_books(_arms(spark, d)))


@query(sql("scores", f"SELECT rk, n_high, n_low, {r('lift_bp')} FROM (SELECT rk, count(*) FILTER (p_raw > m) AS n_high, count(*) FILTER (p_raw <= m) AS n_low, (avg(net) FILTER (p_raw > m) - avg(net) FILTER (p_raw <= m)) * 1e4 AS lift_bp FROM (SELECT *, median(p_raw) OVER (PARTITION BY rk) AS m FROM ranked WHERE rk <= 10) GROUP BY rk) WHERE n_high > 20 AND n_low > 20"))
def within_rank_lift(spark, d):
    return tidy(evaluation.within_rank_lift(ranking.ranked(scores(spark, d)).where("rk <= 10").withColumn("net", net_return())))


@query(sql("docs", f"SELECT doc_id, {r('p')}, bucket FROM (SELECT d.doc_id, d.p, b.bucket, row_number() OVER (PARTITION BY d.doc_id ORDER BY abs(b.predicted - d.p), b.bucket) AS n FROM docs d, (SELECT range AS bucket, (range - 0.5) / 10 AS predicted FROM range(1, 11)) b) WHERE n = 1"))
def nearest_bucket(spark, d):
    buckets = spark.range(1, 11).select(F.col("id").alias("bucket"), ((F.col("id") - 0.5) / 10).alias("predicted"))
    return tidy(evaluation.nearest_bucket(scored_docs(spark, d), buckets), "doc_id", "p", "bucket")


def _vectors(spark, d):
    return scan(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
x AS (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_distance(q.v, p.v), 6) AS dist FROM v q JOIN v p ON q.vec_id % 10 = 0 AND p.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank, id, dist + 0.0 AS dist FROM x QUALIFY rank <= 5""")
def knn_cross(spark, d):
    """A tenth of the rows as queries, against every row but the query's own."""
    v = _vectors(spark, d)
    return tidy(neighbours.knn_sharded(v.where("id % 10 = 0"), v, 5, digits=6))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
x AS (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_distance(q.v, p.v), 6) AS dist FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank, id, dist + 0.0 AS dist FROM x QUALIFY rank <= 5""")
def knn_all(spark, d):
    """Ids divisible by 100 against every row but the query's own."""
    v = _vectors(spark, d)
    return tidy(neighbours.knn_sharded(v.where("id % 100 = 0"), v, 5, digits=6))


#: The similarity space: eight columns known at a session's close, and two more.
_SPACE = {"p_raw": "s.p_raw", "p_short": "s.p_short", "ret1": "rg.ret1", "ret5": "rg.ret5", "gapvol20": "rg.gapvol20", "reach": "s.atr / s.close", "volume": "b.volume", "span": "(b.high - b.low) / b.close", "body": "b.close / b.open - 1", "level": "b.close"}
DIMS = [f"z{k}" for k in range(len(_SPACE))]


def _rank_sql(k: int) -> str:
    rank = f"rank() OVER (PARTITION BY ts, x{k} IS NULL ORDER BY x{k}) + (count(*) OVER (PARTITION BY ts, x{k}) - 1) / 2.0"
    return f"CASE WHEN x{k} IS NULL THEN 0 ELSE ({rank}) / count(x{k}) OVER (PARTITION BY ts) - 0.5 END AS z{k}"


def _distance(dims: int) -> str:
    return "round(sqrt(" + " + ".join(f"pow(q.z{k} - p.z{k}, 2)" for k in range(dims)) + "), 9)"


SPACE_SQL = (
    _RET
    + f""",
sx AS (SELECT s.ts, s.symbol, sidx, s.ft, s.exit_ret, s.mfe, s.mae, s.days_tp, {", ".join(f"{e} AS x{k}" for k, e in enumerate(_SPACE.values()))} FROM scores s JOIN axis USING (ts) LEFT JOIN rg ON rg.symbol = s.symbol AND rg.ts = s.ts LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = s.ts),
zz AS MATERIALIZED (SELECT ts, symbol, sidx, ft, exit_ret, mfe, mae, days_tp, {", ".join(map(_rank_sql, range(len(_SPACE))))}, {" + ".join(f"(x{k} IS NULL)::BIGINT" for k in range(len(_SPACE)))} AS missing FROM sx)"""
)
_SELF = (
    SPACE_SQL
    + f""",
ct AS (SELECT date_trunc('month', ts) AS month, min(sidx) - 6 AS cut FROM zz GROUP BY 1),
pp AS (SELECT q.symbol, q.ts, p.exit_ret AS y, p.sidx, {_distance(2)} AS d FROM zz q JOIN ct ON ct.month = date_trunc('month', q.ts) JOIN zz p ON p.symbol = q.symbol AND p.sidx <= ct.cut),
nn AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY d, sidx) AS rn, count(*) OVER (PARTITION BY symbol, ts) AS n FROM pp)"""
)


def _states(spark, d):
    """The scored rows with their session's number and their place in the similarity space, ``DIMS``."""
    b = stored_bars(spark, d)
    s = scores(spark, d, b)
    own = b.select("symbol", "ts", "volume", ((F.col("high") - F.col("low")) / F.col("close")).alias("span"), (F.col("close") / F.col("open") - 1).alias("body"), F.col("close").alias("level"))
    x = s.withColumn("reach", F.col("atr") / F.col("close")).join(panel_features.returns_and_gaps(b), ["symbol", "ts"], "left").join(own, ["symbol", "ts"], "left")
    space = panel_features.similarity_space(x, list(_SPACE))
    return durable(space.withColumnsRenamed({f"z_{c}": z for c, z in zip(_SPACE, DIMS, strict=True)}).join(F.broadcast(sessions(s)), "ts"))


@query(sql("scores", f"SELECT symbol, ts, max(n) AS n, {r('avg(d)=>dist', 'sum(y / (d + 0.1)) / sum(1 / (d + 0.1))=>mean')} FROM nn WHERE rn <= 20 AND n >= 30 GROUP BY symbol, ts", _SELF))
def knn_self_cutoff(spark, d):
    return tidy(neighbours.knn_self(_states(spark, d), DIMS[:2], "exit_ret"))


_DECLUSTERED = """
last AS (SELECT symbol, max(sidx) AS s FROM zz GROUP BY symbol),
near AS MATERIALIZED (SELECT p.symbol, p.sidx, round(sqrt(pow(p.z0 - q.z0, 2) + pow(p.z1 - q.z1, 2)), 9) AS d, row_number() OVER (PARTITION BY p.symbol ORDER BY d, p.sidx) AS i FROM zz p JOIN last ON last.symbol = p.symbol JOIN zz q ON q.symbol = p.symbol AND q.sidx = last.s WHERE p.sidx <= last.s - 6),
taken AS (SELECT symbol, 0::BIGINT AS i, []::BIGINT[] AS picks FROM last
  UNION ALL SELECT t.symbol, n.i, CASE WHEN len(picks) < 10 AND len(list_filter(picks, lambda x: abs(x - n.sidx) < 5)) = 0 THEN list_append(picks, n.sidx) ELSE picks END FROM taken t JOIN near n ON n.symbol = t.symbol AND n.i = t.i + 1),
done AS (SELECT symbol, unnest(picks) AS sidx, unnest(range(1, len(picks) + 1)) AS place FROM (SELECT symbol, arg_max(picks, i) AS picks FROM taken GROUP BY symbol))"""


@query(sql("scores", f"SELECT symbol, place, sidx, {r('d')} FROM done JOIN near USING (symbol, sidx)", _SELF + "," + _DECLUSTERED).replace("WITH ", "WITH RECURSIVE ", 1))
def declustered_neighbours(spark, d):
    z = _states(spark, d)
    q = z.groupBy("symbol").agg(F.max_by(F.struct("z0", "z1", "sidx"), "sidx").alias("q"))
    pairs = z.join(q, "symbol").where(F.col("sidx") <= F.col("q.sidx") - 6).select("symbol", F.col("sidx").cast("long").alias("sidx"), F.round(F.hypot(F.col("z0") - F.col("q.z0"), F.col("z1") - F.col("q.z1")), 9).alias("d"))
    picks = neighbours.declustered(pairs, ["symbol"]).select("symbol", F.posexplode("picks").alias("place", "pick"))
    return tidy(picks.select("symbol", (F.col("place") + 1).cast("long").alias("place"), "pick.sidx", "pick.d"))


_LEDGER = "l0 AS (SELECT ts AS date, symbol, rk FROM ranked WHERE rk <= 3)"


@query(sql("scores", f"SELECT date, symbol, rk, NULL::VARCHAR AS action FROM l0 WHERE date_part('month', date) <> 6 UNION ALL SELECT ts, symbol, rk, CASE WHEN p_raw >= 0.5 THEN 'TRADE' ELSE 'SKIP' END FROM ranked WHERE rk <= 2 AND date_part('month', ts) = 6", _LEDGER))
def ledger_upsert(spark, d):
    s = ranking.ranked(scores(spark, d)).withColumnRenamed("ts", "date")
    fresh = s.where((F.month("date") == 6) & (F.col("rk") <= 2)).select("date", "symbol", "rk", F.when(F.col("p_raw") >= 0.5, "TRADE").otherwise("SKIP").alias("action"))
    return tidy(books.upserted(s.where("rk <= 3").select("date", "symbol", "rk"), fresh), "date", "symbol", "rk", "action")


@query(sql("scores", f"SELECT ts, symbol, {r('p_raw')}, NULL::DOUBLE AS value FROM scores UNION ALL SELECT ts, symbol::VARCHAR, NULL, {r('value')} FROM panel", "panel AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS ts, user_id AS symbol, round(avg(value), 9) AS value FROM events GROUP BY ALL)"))
def union_ragged(spark, d):
    return tidy(scores(spark, d).select("ts", "symbol", "p_raw").unionByName(day_panel(spark, d).withColumn("symbol", F.col("symbol").cast("string")), allowMissingColumns=True))


@query(sql("scores", "SELECT ts FROM scores UNION SELECT CAST(date_trunc('day', ts) AS DATE) FROM events"))
def session_union(spark, d):
    return scores(spark, d).select("ts").union(scan(spark, d, "events", "ts").select(F.to_date("ts"))).distinct()


def _folds(least: float, blocks: int) -> str:
    a = f"floor(n * {least}::DOUBLE)"
    edge = lambda b: f"floor({a} + (n - {a}) * ({b}) / {blocks}.0::DOUBLE)"
    return f"""SELECT b AS block, te.ts AS train_end, t0.ts AS test_start, t1.ts AS test_end FROM (SELECT b, {edge('b - 1')}::BIGINT AS lo, {edge('b')}::BIGINT - 1 AS hi FROM (SELECT max(n) AS n FROM axis), range(1, {blocks + 1}) x(b))
JOIN axis te ON te.sidx = lo - 6 JOIN axis t0 ON t0.sidx = lo JOIN axis t1 ON t1.sidx = hi"""


@query(sql("scores", _folds(0.35, 5)))
def walk_forward_folds(spark, d):
    return splits.forward_blocks(sessions(scores(spark, d)), 5, 0.35)


@query(sql("scores", _folds(0.40, 4)))
def nested_blocks(spark, d):
    return splits.forward_blocks(sessions(scores(spark, d)), 4, 0.40)


@query(sql("scores", "SELECT block, min(ts) AS lo, max(ts) AS hi, CAST(min(ts) - INTERVAL 10 DAY AS DATE) AS guard_lo, CAST(max(ts) + INTERVAL 10 DAY AS DATE) AS guard_hi FROM (SELECT ts, ntile(5) OVER (ORDER BY ts) AS block FROM axis) GROUP BY block"))
def day_blocks(spark, d):
    return splits.day_blocks(sessions(scores(spark, d)))


@query(sql("scores", "SELECT ts, CASE WHEN sidx < floor(n * 0.75) THEN 'fit' WHEN sidx >= floor(n * 0.75) + 4 THEN 'calibrate' ELSE 'gap' END AS part FROM axis"))
def calibration_split(spark, d):
    return splits.calibration_split(sessions(scores(spark, d)))


@query(sql("scores", "SELECT bag, ts FROM (SELECT bag, ts, row_number() OVER (PARTITION BY bag ORDER BY md5(concat(ts::VARCHAR, ':', bag::VARCHAR))) AS k, n FROM axis, range(3) x(bag)) WHERE k <= floor(n * 0.8)"))
def day_bags(spark, d):
    s = sessions(scores(spark, d))
    parts = [splits.hashed_days(s, 0.8, b).select(F.lit(b).cast("long").alias("bag"), "ts") for b in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat(o_orderkey::VARCHAR, ':7')), o_orderkey LIMIT 500")
def capped_sample(spark, d):
    return sampling.capped_sample(scan(spark, d, "orders", "o_orderkey"), "o_orderkey", 500)


_SCREEN = """
feats AS (SELECT ts, symbol, close, unnest(['open', 'half_close', 'ret1', 'sparse']) AS feature, unnest([open, close / 2 + 1, ret1, CASE WHEN symbol = 'Brand#11' THEN close END]) AS value FROM bars JOIN (SELECT symbol, ts, ret1 FROM rg) USING (symbol, ts)),
fr AS (SELECT feature, ts, value, rank() OVER (PARTITION BY feature, ts ORDER BY close) + (count(*) OVER (PARTITION BY feature, ts, close) - 1) / 2.0 AS px, rank() OVER (PARTITION BY feature, ts, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY feature, ts, value) - 1) / 2.0 AS rv FROM feats),
fc AS (SELECT feature, ts, corr(CASE WHEN value IS NOT NULL THEN rv END, CASE WHEN value IS NOT NULL THEN px END) AS rho, count(*) AS n, count(value) AS k FROM fr GROUP BY feature, ts)"""


@query(sql("bars", f"SELECT feature, {r('coverage', 'median_abs')}, coalesce(coverage >= 0.5 AND median_abs >= 0.97, false) AS proxy FROM (SELECT feature, sum(k) / sum(n) AS coverage, median(abs(rho)) FILTER (NOT isnan(rho)) AS median_abs FROM fc GROUP BY feature)", _RET + "," + _SCREEN))
def feature_screen(spark, d):
    b = stored_bars(spark, d)
    x = b.join(panel_features.returns_and_gaps(b).select("symbol", "ts", "ret1"), ["symbol", "ts"]).withColumns({"half_close": F.col("close") / 2 + 1, "sparse": F.when(F.col("symbol") == "Brand#11", F.col("close"))})
    return tidy(panel_features.feature_screen(x, ["open", "half_close", "ret1", "sparse"]))


_RESOLVED = _BENCH + "," + _ARMS + """, hd AS (SELECT t.ts, t.net - (e.close / s.close - 1) - 0.0003 AS hedged FROM tr3 t LEFT JOIN bench s ON t.ts = s.ts LEFT JOIN bench e ON e.i = s.i + t.hold),
bk AS (SELECT ts, sum(CASE WHEN rk <= 3 AND keep THEN net ELSE 0 END) / 3 AS filtered, sum(CASE WHEN rk <= 3 THEN net * coalesce(size_x, 1) ELSE 0 END) / 3 AS sized, sum(CASE WHEN mrank <= 3 THEN net ELSE 0 END) / 3 AS reranked FROM arms GROUP BY ts),
seven AS (SELECT t.ts, t.net, t.net - u.uni AS excess, t.stretch AS net_stretch, h.hedged, b.filtered AS meta_filtered, b.sized AS meta_sized, b.reranked AS meta_reranked FROM (SELECT ts, avg(net) AS net, avg(xr_s - 0.0035) AS stretch FROM ranked WHERE rk <= 3 GROUP BY ts) t
  JOIN (SELECT ts, avg(net) AS uni FROM ranked GROUP BY ts) u USING (ts) JOIN (SELECT ts, avg(hedged) AS hedged FROM hd GROUP BY ts) h USING (ts) JOIN bk b USING (ts))"""
_SEVEN = ("net", "excess", "net_stretch", "hedged", "meta_filtered", "meta_sized", "meta_reranked")


@query(sql("scores", f"SELECT ts, {r(*_SEVEN)} FROM seven", _RESOLVED))
def resolve_arms(spark, d):
    """All seven arms of a session from one grouping of its five best."""
    b = stored_bars(spark, d)
    return tidy(books.resolved_arms(_hedged(_arms(spark, d, b), b)))


@query(sql("scores", f"SELECT series, n_dates, {r('mean', 'CASE WHEN n_dates >= 40 THEN lo END=>lo', 'CASE WHEN n_dates >= 40 THEN hi END=>hi')} FROM intervals", _RESOLVED + "," + interval_sql(f"SELECT name AS series, ts, value FROM (UNPIVOT seven ON {', '.join(_SEVEN)})")))
def resolve_intervals(spark, d):
    """Mean of each arm; an interval from 40 sessions on."""
    b = stored_bars(spark, d)
    arms = books.resolved_arms(_hedged(_arms(spark, d, b), b))
    return tidy(evidence.guarded_intervals(evidence.block_bootstrap(arms, [c for c in arms.columns if c != "ts"])))


@query(sql("scores", " UNION ALL ".join(f"SELECT '{v}' AS version, year(ts) AS year, {r('avg(m) * 1e4=>net_bp')} FROM (SELECT ts, avg(xr_{v} - 0.0035) AS m FROM ranked WHERE rk <= 3 GROUP BY ts) GROUP BY year(ts)" for v in "abc")))
def entry_timing_by_year(spark, d):
    daily = ranking.ranked(scores(spark, d)).where("rk <= 3").groupBy("ts").agg(*[F.avg(net_return(f"xr_{v}")).alias(v) for v in "abc"])
    long = daily.unpivot(["ts"], ["a", "b", "c"], "version", "m")
    return tidy(long.groupBy("version", F.year("ts").alias("year")).agg((F.avg("m") * 1e4).alias("net_bp")))


@query(sql("scores", f"SELECT {r('avg(p) * 1e4=>picks_bp', 'avg(u) * 1e4=>universe_bp', 'avg(p - u) * 1e4=>difference_bp')} FROM (SELECT ts, avg(gap1) FILTER (rk <= 3) AS p, avg(gap1) AS u FROM ranked GROUP BY ts) WHERE p IS NOT NULL"))
def overnight_gap(spark, d):
    daily = ranking.ranked(scores(spark, d)).groupBy("ts").agg(F.avg(F.when(F.col("rk") <= 3, F.col("gap1"))).alias("p"), F.avg("gap1").alias("u")).where("p is not null")
    return tidy(daily.agg((F.avg("p") * 1e4).alias("picks_bp"), (F.avg("u") * 1e4).alias("universe_bp"), (F.avg(F.col("p") - F.col("u")) * 1e4).alias("difference_bp")))


@query(sql("scores", f"SELECT {r('count(*) FILTER (ft_c = -1 AND xr_c < xr_b - 1e-12) / greatest(count(*) FILTER (ft_c = -1), 1)::DOUBLE=>share')}, count(*) FILTER (ft_c = -1) AS stops FROM ranked WHERE rk <= 3"))
def stop_gap_share(spark, d):
    top = ranking.ranked(scores(spark, d)).where("rk <= 3")
    stop, gap = F.col("ft_c") == -1, (F.col("ft_c") == -1) & (F.col("xr_c") < F.col("xr_b") - 1e-12)
    out = top.agg(F.coalesce(F.sum(stop.cast("long")), F.lit(0)).alias("stops"), F.sum(gap.cast("long")).alias("gaps"))
    return tidy(out.select((F.col("gaps") / F.greatest("stops", F.lit(1))).alias("share"), "stops"))


@query(sql("scores", f"SELECT CASE ft WHEN 1 THEN 'TARGET' WHEN -1 THEN 'STOP' ELSE 'TIMEOUT' END AS outcome, count(*) AS n, {r('avg(net) * 1e4=>net_bp', 'median(exit_ret)=>median_ret')} FROM ranked WHERE rk <= 3 GROUP BY 1"))
def outcome_mix(spark, d):
    top = ranking.ranked(scores(spark, d)).where("rk <= 3").withColumn("outcome", outcome_name("ft"))
    return tidy(top.groupBy("outcome").agg(F.count("*").alias("n"), (F.avg(net_return()) * 1e4).alias("net_bp"), F.median("exit_ret").alias("median_ret")))


@query(sql("labels", f"SELECT symbol, ts, {r('close * (1 + 1.5 * atr / close)=>target', 'close * (1 - 1.0 * atr / close)=>stop', 'close * (1 + 2.0 * atr / close)=>stretch')}, CASE WHEN p >= 90 THEN 'very high' WHEN p >= 75 THEN 'high' WHEN p <= 10 THEN 'very low' WHEN p <= 25 THEN 'low' ELSE 'middle' END AS level FROM (SELECT *, 100.0 * rank() OVER (PARTITION BY ts ORDER BY close) / count(*) OVER (PARTITION BY ts) AS p FROM labels_all WHERE atr IS NOT NULL)"))
def watchlist_brackets(spark, d):
    x = labels.average_true_range(bars(spark, d)).where("atr is not null")
    a, c = F.col("atr") / F.col("close"), F.col("close")
    level = 100.0 * F.rank().over(Window.partitionBy("ts").orderBy("close")) / F.count("*").over(Window.partitionBy("ts"))
    return tidy(x.select("symbol", "ts", (c * (1 + 1.5 * a)).alias("target"), (c * (1 - 1.0 * a)).alias("stop"), (c * (1 + 2.0 * a)).alias("stretch"), percentile_word(level).alias("level")))


@query(sql("scores", f"SELECT ts, symbol, {r('za', 'zb')}, missing FROM (SELECT ts, symbol, {_avg_rank('p_raw', 'ts')} / count(*) OVER (PARTITION BY ts) - 0.5 AS za, CASE WHEN p_short IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY ts, p_short IS NULL ORDER BY p_short) + (count(*) OVER (PARTITION BY ts, p_short) - 1) / 2.0) / count(p_short) OVER (PARTITION BY ts) - 0.5 END AS zb, (p_short IS NULL)::BIGINT AS missing FROM (SELECT * REPLACE (CASE WHEN symbol < 'Brand#2' THEN NULL ELSE p_short END AS p_short) FROM scores))"))
def similarity_space(spark, d):
    x = scores(spark, d).withColumn("p_short", F.when(F.col("symbol") >= "Brand#2", F.col("p_short")))
    return tidy(panel_features.similarity_space(x, ["p_raw", "p_short"]).select("ts", "symbol", F.col("z_p_raw").alias("za"), F.col("z_p_short").alias("zb"), "missing"))


@query(sql("panel", "SELECT event_type, d AS ts, n FROM (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 3)"))
def semi_join_top_types(spark, d):
    e = scan(spark, d, "events", "event_type", "ts")
    top = e.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)
    return e.join(F.broadcast(top), "event_type", "left_semi").groupBy("event_type", F.to_date("ts").alias("ts")).agg(F.count("*").alias("n"))


VERDICT = "CASE WHEN lo > 0 THEN 'better' WHEN hi < 0 THEN 'worse' ELSE 'no clear difference' END AS verdict"
_DAILY = "dl AS (SELECT ts, avg(net) FILTER (rk <= 3) AS top_net, avg(net) AS universe_net, avg(net) FILTER (rk <= 3) - avg(net) AS excess FROM ranked GROUP BY ts)"


@query(sql("scores", f"SELECT series, n_dates, verdict, {r('mean', 'lo', 'hi')} FROM (SELECT *, {VERDICT} FROM intervals)", _DAILY + "," + interval_sql("SELECT name AS series, ts, value FROM (UNPIVOT dl ON top_net, universe_net, excess)")))
def block_bootstrap(spark, d):
    return tidy(evidence.decided(evidence.block_bootstrap(ranking.topn_vs_universe(scores(spark, d)), ["top_net", "universe_net", "excess"])))


def _learning(spark, d, b=None):
    b = stored_bars(spark, d) if b is None else b
    s = scores(spark, d, b)
    x = s.withColumns({"label": F.col("y"), "key": F.concat_ws("/", "ts", "symbol")}).join(panel_features.returns_and_gaps(b), ["symbol", "ts"])
    return durable(x), s


@query()
def gbt_walkforward(spark, d):
    x, s = _learning(spark, d)
    out = models.walk_forward(x, splits.forward_blocks(sessions(s)), ["p_short", "ret5", "gapvol20"])
    return models.calibrated_by_earlier_folds(out.select("ts", "symbol", "fold", "p_raw", "label")).select("ts", "symbol", "fold", "p_raw", "conf_cf")


@query(sql("docs", f"SELECT doc_id, {r('p', 'v=>p_cal')} FROM ({interpolated('p', 'rest')})", isotonic_sql("SELECT p AS x, y FROM docs") + ", rest AS (SELECT doc_id, n_chars::DOUBLE / (n_chars::DOUBLE + 1500.0) AS p FROM documents ANTI JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL)"))
def isotonic_calibrate(spark, d):
    """Fitted on the documents with a quality label, applied to those without."""
    learnt = models.isotonic(scored_docs(spark, d), "p", "y")
    n = F.col("n_chars").cast("double")
    rest = scan(spark, d, "documents", "doc_id", "n_chars").where("n_chars is not null").join(scan(spark, d, "labels", "doc_id"), "doc_id", "left_anti")
    return tidy(models.calibrated(learnt, rest.select("doc_id", (n / (n + 1500.0)).alias("p")), "p"))


@query()
def meta_bag(spark, d):
    x, s = _learning(spark, d)
    features = ["p_short", "ret5", "gapvol20"]
    return models.bag_predictions(models.bagged(x, sessions(s), features), x, features).select("ts", "symbol", "meta_p", "spread_lo", "spread_hi")
