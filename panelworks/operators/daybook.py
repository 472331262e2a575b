"""The day's book: expected values and brackets, the second model's decisions, what is recent, what is known.

Tables with a row per session are small by nature and use windows without a partition; everything else
is keyed by session or symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions import clip


def expected_value(p_target: Column, p_stop: Column, target: Column, stop: Column, timeout_mean: Column, cost_bps: float = 35.0) -> Column:
    """Return expected of a bracket: what neither barrier takes earns the mean of past timeouts; costs go off."""
    neither = F.greatest(F.lit(0.0), 1 - p_target - p_stop)
    return p_target * target - p_stop * stop + neither * timeout_mean - F.lit(cost_bps / 1e4)


def watchlist(scored: DataFrame, timeout_mean: float | Column, top: int | None = 10, target: float = 1.5, stop: float = 1.0, stretch: float = 2.0) -> DataFrame:
    """Every session's ``top`` (all if None) by score, with rank percentile, bracket prices and expected value in basis points.

    ``scored``: ts, symbol, close, atr, p_raw, confidence, p_sl. Prices and the expected value are NULL
    without a true range; the percentile is 1 for the best and 1/n for the last.
    """
    day = Window.partitionBy("ts")
    d = scored.withColumns({"rank": F.row_number().over(day.orderBy(F.col("p_raw").desc_nulls_last(), "symbol")).cast("long"), "_n": F.count("*").over(day)})
    d = d.withColumn("pct", 1 - (F.col("rank") - 1) / F.col("_n"))
    if top is not None:
        d = d.where(F.col("rank") <= top)
    reach, entry = F.col("atr") / F.col("close"), F.col("close")
    mean = timeout_mean if isinstance(timeout_mean, Column) else F.lit(timeout_mean)
    value = expected_value(F.col("confidence"), clip(F.col("p_sl"), 0.0, 1.0), target * reach, stop * reach, mean)
    return d.withColumns({"entry": entry, "target": entry * (1 + target * reach), "stop": entry * (1 - stop * reach), "stretch": entry * (1 + stretch * reach), "ev_bp": value * 1e4}).drop("_n")


def decisions(ranked: DataFrame, tau: float | Column, validated: bool = True, k: int = 3, pool: int = 5, meta: str = "meta_p") -> DataFrame:
    """Adds ``action``, ``size_x`` and ``meta_rank``.

    Of the top k by ``rk`` those with at least ``tau`` are TRADE, others SKIP; all are TRADE* while the
    filter is not validated, and ``-`` beyond the top. Sizes follow the second score within 0.5 and 1.5
    of the top's mean and sum to k, and are NULL where that mean is zero; the second score ranks the pool anew.
    """
    day, top, p = Window.partitionBy("ts"), F.col("rk") <= k, F.col(meta)
    cut = tau if isinstance(tau, Column) else F.lit(tau)
    taken = F.when(p >= cut, "TRADE").otherwise("SKIP") if validated else F.lit("TRADE*")
    d = ranked.withColumns({"_w": F.when(top, clip(p / F.nullif(F.avg(F.when(top, p)).over(day), F.lit(0.0)), 0.5, 1.5)), "_in": F.col("rk") <= pool})
    again = F.when(F.col("_in"), F.row_number().over(Window.partitionBy("ts", "_in").orderBy(p.desc_nulls_last(), "rk")))
    return d.withColumns({"action": F.when(top, taken).otherwise("-"), "size_x": F.col("_w") * k / F.sum("_w").over(day), "meta_rank": again.cast("long")}).drop("_w", "_in")


def last_rows(df: DataFrame, n: int, by: str = "symbol", on: str = "ts") -> DataFrame:
    """The last n rows of each group, with ``back`` from 0 for the latest."""
    d = df.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.col(on).desc())) - 1)
    return d.where(F.col("back") < n).withColumn("back", F.col("back").cast("long"))


def latest_session(df: DataFrame, on: str = "ts") -> DataFrame:
    """The rows of the latest session."""
    return df.join(F.broadcast(df.agg(F.max(on).alias(on))), on, "left_semi")  # one row


def kept(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One whole row a key: the first by ``order``, or the last. Partial aggregation, no sort; ``order`` must tell rows apart."""
    row, by = F.struct(*df.columns), F.struct(*order)
    return df.groupBy(*keys).agg((F.max_by if last else F.min_by)(row, by).alias("_row")).select("_row.*")


def recent_sessions(sessions: DataFrame, day: Column, trained_through: Column, back: int = 6) -> DataFrame:
    """Sessions to score before ``day``: the ``back`` before it, and all since training ended."""
    before = sessions.where(F.col("ts") < day)
    d = before.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("ts"))))
    return d.where((F.col("_k") <= back) | (F.col("ts") > trained_through)).drop("_k")


def densified(series: DataFrame, sessions: DataFrame, on: str = "ts") -> DataFrame:
    """The series with a row for every session; missing sessions are NULL, other days go."""
    return sessions.select(on).join(series, on, "left")


def share_at_most(series: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the share of all sessions, later ones included, with at most this session's value; missing values count as sessions."""
    upto = Window.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    share = F.count(value).over(upto) / F.count("*").over(Window.partitionBy())
    return series.withColumn(out, F.when(F.col(value).isNotNull(), share))


def market_state(returns: DataFrame, window: int = 20, least: int = 10) -> DataFrame:
    """Per session: mean return, share of risers, deviation across symbols, and the deviation of the mean over the last sessions.

    ``returns``: ts, symbol, ret1; missing returns do not count.
    """
    frame = Window.orderBy("ts").rowsBetween(1 - window, 0)
    r = F.col("ret1")
    d = returns.groupBy("ts").agg(F.avg(r).alias("mk_ret1"), F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("mk_breadth"), F.stddev_samp(r).alias("mk_dispersion"))
    return d.withColumn("mk_vol20", F.when(F.count("mk_ret1").over(frame) >= least, F.stddev_samp("mk_ret1").over(frame)))


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: does each column hold any value at all?"""
    return df.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in columns])


def largest_difference(df: DataFrame, one: str, other: str) -> DataFrame:
    """(n, max_difference) over the rows where both are known."""
    d = df.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    return d.agg(F.count("*").alias("n"), F.max(F.abs(F.col(one) - F.col(other))).alias("max_difference"))


def analogue_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """What became of a set of past cases: shares of outcomes, mean return, median excursions, mean sessions to the target of those that reached it first."""
    ft = F.col("ft")
    share = lambda k: F.avg(F.coalesce(ft == k, F.lit(False)).cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(1).alias("target_first"), share(-1).alias("stop_first"), share(0).alias("timeout"), F.avg("exit_ret").alias("avg_ret"), F.median("mfe").alias("median_mfe"), F.median("mae").alias("median_mae"), F.avg(F.when(ft == 1, F.col("days_tp"))).alias("avg_days_to_target"))


def fold_wins(daily: DataFrame, folds: DataFrame, one: str, other: str) -> DataFrame:
    """(block, one, other, won): means of two daily series within each fold and whether ``other`` is ahead.

    Folds are a handful of rows; ``won`` is false where a mean is missing.
    """
    inside = F.col("ts").between(F.col("test_start"), F.col("test_end"))
    d = daily.join(F.broadcast(folds), inside).groupBy("block").agg(F.avg(one).alias(one), F.avg(other).alias(other))
    return d.withColumn("won", F.coalesce(F.col(other) > F.col(one), F.lit(False)))
