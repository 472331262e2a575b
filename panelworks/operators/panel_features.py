"""Features of a panel that use no future: standing in the day, persistence, form, decayed records, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions import guarded, net_return
from panelworks.operators.ranking import ranked
from panelworks.sources.tables import sessions


def score_standing(scores: DataFrame, top: int = 10) -> DataFrame:
    """Of the daily top: z-score, gap to the next rank, gap of ranks 3 and 4, and scores within 1 % of rank 3."""
    day, order = Window.partitionBy("ts"), Window.partitionBy("ts").orderBy("rk")
    d = ranked(scores)
    spread = F.nullif(F.stddev_samp("p_raw").over(day), F.lit(0.0))
    third, fourth = (F.max(F.when(F.col("rk") == k, F.col("p_raw"))).over(day) for k in (3, 4))
    d = d.withColumns({"score_z": (F.col("p_raw") - F.avg("p_raw").over(day)) / spread, "gap_next": F.col("p_raw") - F.lead("p_raw").over(order), "_third": third, "day_gap_3_4": third - fourth})
    crowd = F.sum(F.when(F.col("p_raw") >= F.col("_third") * 0.99, 1).otherwise(0)).over(day)
    return d.withColumn("top_crowding", crowd).drop("_third").where(F.col("rk") <= top)


def presence(panel: DataFrame, value: str, top: int = 10, back: int = 5) -> DataFrame:
    """(ts, symbol, rk, presence): sessions in the daily top over the previous ``back`` sessions; NULL on the first session."""
    d = ranked(panel, value).join(F.broadcast(sessions(panel)), "ts")
    frame = Window.partitionBy("symbol").orderBy("sidx").rangeBetween(-back, -1)
    seen = F.coalesce(F.sum(F.when(F.col("rk") <= top, 1).otherwise(0)).over(frame), F.lit(0))
    return d.withColumn("presence", F.when(F.col("sidx") > 0, seen)).select("ts", "symbol", "rk", "presence")


def model_form(scores: DataFrame, top: int = 3, lag: int = 6, widths: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """(ts, form_w): rolling means of the daily top's net over finished sessions. A row per session, so one window is small."""
    daily = ranked(scores).where(F.col("rk") <= top).groupBy("ts").agg(F.avg(net_return()).alias("net"))
    axis = Window.orderBy("ts")
    lagged = daily.withColumn("known", F.lag("net", lag).over(axis))
    out = {}
    for w in widths:
        frame = axis.rowsBetween(1 - w, 0)
        out[f"form_{w}"] = guarded(F.avg("known").over(frame), F.count("known").over(frame), max(3, w // 2))
    return lagged.select("ts", *[v.alias(k) for k, v in out.items()])


def finished_record(labels: DataFrame, value: str, lag: int = 6, halflife_days: float = 365.0) -> DataFrame:
    """Adds ``known`` (the value ``lag`` own rows ago), ``n_known`` and ``ewm``, its mean with weights that halve with time.

    Time between rows counts only where the lagged value is present.
    """
    order = Window.partitionBy("symbol").orderBy("ts")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    d = labels.withColumn("known", F.lag(value, lag).over(order)).withColumn("_days", F.date_diff("ts", F.lag("ts").over(order)).cast("double"))
    d = d.withColumn("_age", F.sum(F.when(F.col("known").isNotNull(), F.coalesce("_days", F.lit(0.0))).otherwise(0.0)).over(upto))
    weight = F.when(F.col("known").isNotNull(), F.pow(F.lit(2.0), F.col("_age") / halflife_days))
    d = d.withColumn("_w", weight)
    return d.withColumns({"ewm": F.sum(F.col("_w") * F.col("known")).over(upto) / F.sum("_w").over(upto), "n_known": F.count("known").over(upto)}).drop("_w", "_age", "_days")


def market_prior(labels: DataFrame, value: str, lag: int = 6, halflife: float = 250.0) -> DataFrame:
    """(ts, prior): the session mean's decayed mean, by sessions, ``lag`` sessions ago."""
    axis = Window.orderBy("ts")
    upto = axis.rowsBetween(Window.unboundedPreceding, 0)
    daily = labels.groupBy("ts").agg(F.avg(value).alias("m"))
    d = daily.withColumn("_w", F.when(F.col("m").isNotNull(), F.pow(F.lit(2.0), F.count("m").over(upto) / halflife)))
    d = d.withColumn("_ew", F.sum(F.col("_w") * F.col("m")).over(upto) / F.sum("_w").over(upto))
    return d.select("ts", F.lag("_ew", lag).over(axis).alias("prior"))


def shrunk_record(labels: DataFrame, value: str, prior_k: float = 30.0, cap: float = 500.0, horizon: float = 5.0, least: int = 20) -> DataFrame:
    """A symbol's decayed record blended with the market's, by its effective number of finished trades."""
    d = finished_record(labels, value).join(F.broadcast(market_prior(labels, value)), "ts", "left")  # a row per session
    n = F.least(F.col("n_known").cast("double"), F.lit(cap)) / horizon
    blend = (n * F.col("ewm") + prior_k * F.col("prior")) / (n + prior_k)
    return d.withColumns({"n_eff": n, "shrunk": guarded(blend, F.col("n_known"), least)}).withColumn("vs_market", F.col("shrunk") - F.col("prior"))


def returns_and_gaps(bars: DataFrame) -> DataFrame:
    """(symbol, ts, ret1, ret5, gapvol20) by own rows."""
    order = Window.partitionBy("symbol").orderBy("ts")
    d = bars.withColumns({"ret1": F.col("close") / F.lag("close", 1).over(order) - 1, "ret5": F.col("close") / F.lag("close", 5).over(order) - 1, "_gap": F.col("open") / F.lag("close", 1).over(order) - 1})
    frame = order.rowsBetween(-19, 0)
    return d.withColumn("gapvol20", guarded(F.stddev_samp("_gap").over(frame), F.count("_gap").over(frame), 10)).select("symbol", "ts", "ret1", "ret5", "gapvol20")


def asof_join(left: DataFrame, right: DataFrame, on: str = "ts", by: str = "symbol") -> DataFrame:
    """Each left row with the latest right row at or before it, matched as a whole row, so its NULLs stay NULL.

    A union and one window: no join, one shuffle on ``by``. Of right rows with equal keys the largest counts.
    """
    extra = [c for c in right.columns if c not in (on, by)]
    matched = F.struct(F.col(on).alias("_ts"), *extra)
    typed = right.groupBy(by, on).agg(F.max(F.struct(*extra)).alias("_r")).select(by, on, F.struct(F.col(on).alias("_ts"), *[F.col(f"_r.{c}").alias(c) for c in extra]).alias("_right"))
    kind = right.select(matched.alias("m")).schema["m"].dataType
    rows = left.withColumns({"_right": F.lit(None).cast(kind), "_side": F.lit(1)}).unionByName(typed.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    last = F.last("_right", ignorenulls=True).over(Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_right", last).where("_side = 1").select(*left.columns, F.col("_right._ts").alias(f"{on}_matched"), *[F.col(f"_right.{c}").alias(c) for c in extra])


def holding_return(trades: DataFrame, series: DataFrame) -> DataFrame:
    """Adds ``bench``: the series' return from a trade's session over its holding sessions ``hold``; NULL out of range."""
    axis = series.withColumn("_i", F.row_number().over(Window.orderBy("ts")))  # one series, small by nature
    start = axis.select("ts", F.col("_i"), F.col("close").alias("_from"))
    end = axis.select(F.col("_i").alias("_j"), F.col("close").alias("_to"))
    d = trades.join(F.broadcast(start), "ts", "left").withColumn("_j", F.col("_i") + F.col("hold"))
    return d.join(F.broadcast(end), "_j", "left").withColumn("bench", F.col("_to") / F.col("_from") - 1).drop("_i", "_j", "_from", "_to")


def similarity_space(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per-session percent ranks less one half, 0 where missing, and the number missing."""
    from panelworks.functions import percent_rank_average

    ranks = {f"z_{c}": F.coalesce(percent_rank_average(c, "ts") - 0.5, F.lit(0.0)) for c in columns}
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.withColumns(ranks | {"missing": missing.cast("long")})


def feature_screen(df: DataFrame, features: list[str], against: str = "close", coverage: float = 0.5, limit: float = 0.97) -> DataFrame:
    """(feature, coverage, proxy): median absolute rank correlation with a price a session, all features in one job."""
    from panelworks.functions import average_rank

    long = df.withColumn("_px", average_rank(against, "ts")).unpivot(["ts", "symbol", "_px"], features, "feature", "value")
    long = long.withColumn("_r", average_rank("value", ["feature", "ts"]))
    known = F.col("value").isNotNull()
    by = long.groupBy("feature", "ts").agg(F.corr(F.when(known, F.col("_r")), F.when(known, F.col("_px"))).alias("rho"), F.count("*").alias("n"), F.count("value").alias("k"))
    rho = F.nanvl(F.abs("rho"), F.lit(None).cast("double"))
    out = by.groupBy("feature").agg((F.sum("k") / F.sum("n")).alias("coverage"), F.median(rho).alias("median_abs"))
    return out.withColumn("proxy", F.coalesce((F.col("coverage") >= coverage) & (F.col("median_abs") >= limit), F.lit(False)))
