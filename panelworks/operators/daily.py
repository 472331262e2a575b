"""The daily loop: a day's picks with all that is known of them, a ledger by date, and its later resolution.

Each date is one partition of the ledger. A day's run replaces its own date only, so running it twice is
running it once; a resolution reads and writes only dates that are not resolved and whose outcomes are
known by now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.functions import band_text, net_return, percent
from panelworks.operators import books, daybook, evaluation, models
from panelworks.operators.isotonic import calibrated
from panelworks.operators.runs import Run, load_meta
from panelworks.sources.durable import durable


def merged_series(stored: DataFrame, live: DataFrame, on: str = "ts") -> DataFrame:
    """A stored daily series carried on: where both have a day, the live value counts."""
    return stored.join(live.select(on), on, "left_anti").unionByName(live)


def decile_lookup(rows: DataFrame, deciles: DataFrame, score: str) -> DataFrame:
    """Adds meta_decile, meta_hist_bp and caution: the decile whose mean score is nearest, its net, and whether it is the worst and loses.

    ``deciles``: bucket, predicted, realised (a net return); a handful of rows. Without a score all three are NULL.
    """
    worst = deciles.agg(F.min_by("bucket", F.struct("realised", "bucket")).alias("_worst"))
    near = evaluation.nearest_bucket(rows.withColumn("_x", F.col(score)), deciles.select("bucket", "predicted"), "_x")
    d = near.join(F.broadcast(deciles.select("bucket", "realised")), "bucket", "left").crossJoin(F.broadcast(worst))  # one row
    known = F.col(score).isNotNull()
    return d.select(
        *rows.columns,
        F.when(known, F.col("bucket")).alias("meta_decile"),
        F.when(known, F.col("realised") * 1e4).alias("meta_hist_bp"),
        F.when(known, (F.col("bucket") == F.col("_worst")) & (F.col("realised") < 0)).alias("caution"),
    )


def day_view(scored: DataFrame, timeout_mean: float | Column, record: DataFrame, deciles: DataFrame, form: DataFrame, tau: float | Column, validated: bool = True, top: int = 10, k: int = 3, pool: int = 5) -> DataFrame:
    """The picks of one or more sessions: brackets, expected value, their rank's record, the second stage's view, the model's form.

    ``scored``: ts, symbol, close, atr, p_raw, confidence, p_sl, meta_p, spread_lo, spread_hi. ``record``:
    rank, hist_net_bp, hist_hit; ``form``: a row per session.
    """
    d = daybook.watchlist(scored, timeout_mean, top).withColumn("rk", F.col("rank"))
    d = daybook.decisions(d, tau, validated, k, pool)
    d = decile_lookup(d.join(F.broadcast(record), "rank", "left"), deciles, "meta_p")
    d = d.withColumns({"meta_prob": percent(F.col("meta_p")), "meta_band": band_text(F.col("spread_lo"), F.col("spread_hi"))})
    return d.join(F.broadcast(form), "ts", "left").drop("rk")


def scored_by(run: Run, rows: DataFrame, features: list[str], meta: DataFrame | None = None, meta_features: list[str] | None = None) -> DataFrame:
    """Rows scored by a stored run: p_raw, confidence, p_sl, mfe_hat, mae_hat, days_hat, and the second stage's scores if its features are given.

    ``meta``: ts, symbol and the second stage's features.
    """
    d = models.predict_bundle(models.load_bundle(run.path("bundle")), rows.drop("p_raw"), features).withColumnRenamed("raw", "p_raw")
    d = calibrated(run.read_isotonic("isotonic"), d, "p_raw", "confidence")
    if meta is None:
        return d
    seen = models.predict_meta(load_meta(run), meta, meta_features or []).select("ts", "symbol", "meta_p", "spread_lo", "spread_hi")
    return d.join(seen, ["ts", "symbol"], "left")


def write_day(view: DataFrame, ledger: str, model: str, pool: int = 5) -> None:
    """Puts the first ``pool`` picks of the view's sessions into the ledger; those dates are replaced, no others touched."""
    rows = view.where(F.col("rank") <= pool).select(F.col("ts").alias("date"), "symbol", "rank", "p_raw", "confidence", "target", "stop", "stretch", "ev_bp", "action", "size_x", "meta_rank", F.lit(model).alias("model"))
    books.write_ledger(rows, ledger)


def dates_of(spark: SparkSession, path: str) -> DataFrame:
    """The dates (of type date) that a store by date has, none if there is no store yet."""
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "date date")
    return stored.select(F.col("date").cast("date").alias("date")).distinct()


def resolve(spark: SparkSession, ledger: str, resolved: str, outcomes: DataFrame, horizon: int = 5) -> int:
    """Scores the ledger's dates that are not resolved and lie ``horizon`` sessions back; returns how many.

    ``outcomes``: ts, symbol, exit_ret, ft, days_tp, days_sl, xr_s, over all symbols; its sessions are the
    axis. A pick whose outcome is still unknown leaves its date for later.
    """
    axis = outcomes.select("ts").distinct().withColumn("left", F.row_number().over(Window.orderBy(F.desc("ts"))) - 1)  # a row per session
    ripe = dates_of(spark, ledger).join(dates_of(spark, resolved), "date", "left_anti").join(axis.where(F.col("left") >= horizon), F.col("date") == F.col("ts"), "left_semi")
    dates = sorted(r["date"] for r in ripe.collect())
    if not dates:
        return 0
    picks = spark.read.parquet(ledger).withColumn("date", F.col("date").cast("date")).where(F.col("date").isin(dates))
    known = outcomes.where(F.col("ts").isin(dates)).select("ts", "symbol", "exit_ret", "ft", "days_tp", "days_sl", "xr_s")
    market = known.groupBy("ts").agg(F.avg(net_return()).alias("uni"))
    d = picks.join(known.withColumnRenamed("ts", "date"), ["date", "symbol"], "left").join(F.broadcast(market.withColumnRenamed("ts", "date")), "date", "left")  # a row per session
    d = durable(d)
    open_ = d.groupBy("date").agg(F.count_if(F.col("exit_ret").isNull()).alias("unknown")).where("unknown > 0")
    done = d.join(F.broadcast(open_), "date", "left_anti")
    if done.isEmpty():
        return 0
    books.write_ledger(done.select("date", "symbol", "rank", "action", "size_x", "meta_rank", "exit_ret", "ft", "days_tp", "days_sl", "xr_s", net_return().alias("net"), (net_return() - F.col("uni")).alias("excess"), net_return("xr_s").alias("net_stretch")), resolved)
    return done.select("date").distinct().count()


def forward_arms(resolved: DataFrame, k: int = 3) -> DataFrame:
    """Per resolved session: the top k's net, excess and wider bracket, and the filtered, sized and re-ranked books."""
    top = F.col("rank") <= k
    mean = lambda c: F.avg(F.when(top, F.col(c)))
    slots = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0)) / k
    return resolved.groupBy("date").agg(
        mean("net").alias("net"),
        mean("excess").alias("excess"),
        mean("net_stretch").alias("net_stretch"),
        slots(top & (F.col("action") == "TRADE"), F.col("net")).alias("meta_filtered"),
        slots(top, F.col("net") * F.coalesce("size_x", F.lit(1.0))).alias("meta_sized"),
        slots(F.col("meta_rank") <= k, F.col("net")).alias("meta_reranked"),
    )


def trade_log(resolved: DataFrame, k: int = 3) -> DataFrame:
    """One row a trade: when, what, how it ended, after how many sessions, and the running net of all trades up to its month.

    Running sums go over months, of which there are few, not over trades.
    """
    outcome = F.when(F.col("ft") == 1, "TARGET").when(F.col("ft") == -1, "STOP").otherwise("TIMEOUT")
    held = F.when(F.col("ft") == 1, F.col("days_tp")).when(F.col("ft") == -1, F.col("days_sl")).otherwise(5)
    d = resolved.where(F.col("rank") <= k).withColumn("month", F.trunc("date", "month"))
    months = d.groupBy("month").agg(F.sum("net").alias("_net")).withColumn("through_month", F.sum("_net").over(Window.orderBy("month")))
    return d.join(F.broadcast(months), "month").select("date", "symbol", "rank", "action", outcome.alias("outcome"), held.cast("long").alias("held"), "net", "through_month")
