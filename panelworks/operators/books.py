"""Books of daily picks: slot-weighted arms, sizes, equity curves, roll-ups, the paper ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.functions import clip, net_return


def position_sizes(picks: DataFrame, k: int = 3, score: str = "p_raw") -> DataFrame:
    """Adds ``size_x``: score over the day's mean, within 0.5 and 1.5, scaled so that a day's sizes sum to k."""
    day = Window.partitionBy("ts")
    d = picks.withColumn("_w", clip(F.col(score) / F.avg(score).over(day), 0.5, 1.5))
    return d.withColumn("size_x", F.col("_w") * k / F.sum("_w").over(day)).drop("_w")


def slot_books(picks: DataFrame, k: int = 3) -> DataFrame:
    """Per session: base, filtered, sized and re-ranked arms. Every arm divides by k slots: an empty slot earns nothing.

    ``picks``: ts, rk, net, keep, size_x, mrank over a pool of at least k ranks.
    """
    top = F.col("rk") <= k
    slot = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0)) / k
    return picks.groupBy("ts").agg(slot(top, F.col("net")).alias("base"), slot(top & F.col("keep"), F.col("net")).alias("filtered"), slot(top, F.col("net") * F.coalesce("size_x", F.lit(1.0))).alias("sized"), slot(F.col("mrank") <= k, F.col("net")).alias("reranked"))


def resolved_arms(picks: DataFrame, k: int = 3) -> DataFrame:
    """Per session: net, excess over the universe, wider target, hedged, filtered, sized, re-ranked.

    The first four are means of the top k, the last three divide by k slots. ``picks`` has the columns
    of ``slot_books`` and uni (the session's universe), xr_s and hedged (NULL rows do not count).
    """
    top = F.col("rk") <= k
    mean = lambda x: F.avg(F.when(top, x))
    slot = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0)) / k
    net = F.col("net")
    return picks.groupBy("ts").agg(mean(net).alias("net"), mean(net - F.col("uni")).alias("excess"), mean(net_return("xr_s")).alias("net_stretch"), mean(F.col("hedged")).alias("hedged"), slot(top & F.col("keep"), net).alias("meta_filtered"), slot(top, net * F.coalesce("size_x", F.lit(1.0))).alias("meta_sized"), slot(F.col("mrank") <= k, net).alias("meta_reranked"))


def curve_stats(daily: DataFrame, value: str = "net") -> DataFrame:
    """One row for a daily series: days, mean, share of positive days, total, drawdown from the running peak, longest losing streak, worst and best month.

    The series has a row per session, which one window can hold.
    """
    axis = Window.orderBy("ts")
    upto = axis.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.where(F.col(value).isNotNull()).select("ts", F.col(value).alias("x"))
    d = d.withColumn("cum", F.sum("x").over(upto)).withColumn("peak", F.max("cum").over(upto))
    d = d.withColumns({"_run": F.row_number().over(axis) - F.row_number().over(Window.partitionBy(F.col("x") < 0).orderBy("ts")), "month": F.date_format("ts", "yyyy-MM")})
    streak = d.where("x < 0").groupBy("_run").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest_losing_streak"))
    months = d.groupBy("month").agg(F.sum("x").alias("m"))
    by_month = months.agg(F.avg((F.col("m") > 0).cast("double")).alias("positive_months"), F.min_by("month", F.struct("m", "month")).alias("worst_month"), F.max_by("month", F.struct("m", "month")).alias("best_month"))
    whole = d.agg(F.count("*").alias("days"), (F.avg("x") * 1e4).alias("mean_bp"), F.avg((F.col("x") > 0).cast("double")).alias("positive_days"), (F.sum("x") * 1e4).alias("total_bp"), (F.min(F.col("cum") - F.col("peak")) * 1e4).alias("max_drawdown_bp"))
    return whole.crossJoin(streak).crossJoin(by_month)  # one row each


def rollup(daily: DataFrame, unit: str, value: str = "net") -> DataFrame:
    """(period, days, mean_bp, total_bp) by month, quarter or year."""
    return daily.groupBy(F.to_date(F.date_trunc(unit, "ts")).alias("period")).agg(F.count(value).alias("days"), (F.avg(value) * 1e4).alias("mean_bp"), (F.sum(value) * 1e4).alias("total_bp"))


def upserted(ledger: DataFrame, fresh: DataFrame, key: str = "date") -> DataFrame:
    """The ledger with the rows of the fresh dates replaced; columns may differ."""
    return ledger.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_ledger(fresh: DataFrame, path: str, key: str = "date") -> None:
    """Replaces the dates of ``fresh`` in a ledger partitioned by date; other partitions are not touched."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_experiment(spark: SparkSession, path: str, record: dict) -> None:
    spark.createDataFrame([{k: str(v) for k, v in record.items()}]).write.mode("append").json(path)
