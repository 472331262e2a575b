"""Shared views of the queries: bars, labels and scores over the driver's tables.

A query makes its bars once: bars, a row a symbol and week, are stored, and so are the scores; nothing
later reads the lines again. A query that needs bars beside labels or scores hands its own to both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.functions import net_return
from panelworks.operators.labels import barrier_labels
from panelworks.sources.durable import durable
from panelworks.sources.tables import bars


def squash(x):
    """Into (0, 1), by arithmetic that all engines do alike."""
    return 0.5 + 0.5 * x / (1 + F.abs(x))


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(bars(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return barrier_labels(stored_bars(spark, sf_dir) if of is None else of)


def scores(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(ts, symbol, p_raw, p_short, exit_ret, ft, y, hit, gap1, xr_*, days_*, mfe, mae, close, atr): two causal scores of labelled bars."""
    order = Window.partitionBy("symbol").orderBy("ts")
    d = labelled(spark, sf_dir, of).withColumns({"p_raw": squash(F.col("close") / F.lag("close", 5).over(order) - 1), "p_short": squash(F.col("close") / F.lag("close", 1).over(order) - 1)})
    d = d.where("p_raw is not null and xr_a is not null").withColumn("exit_ret", F.col("xr_a"))
    return durable(d.select("ts", "symbol", "p_raw", "p_short", "exit_ret", F.col("ft_a").alias("ft"), (net_return() > 0).cast("double").alias("y"), (F.col("ft_a") == 1).cast("double").alias("hit"), "gap1", "xr_a", "xr_b", "xr_c", "ft_c", "xr_s", "days_tp", "days_sl", "mfe", "mae", "close", "atr"))
