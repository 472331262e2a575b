"""Daily ranks of scores, top-N picks and how they did against the universe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions import average_rank, net_return, percent_rank_average, rank_by_score, two_errors


def ranked(scores: DataFrame, score: str = "p_raw") -> DataFrame:
    """Adds ``rk``: row number by descending score a session, ties by symbol."""
    return scores.withColumn("rk", rank_by_score(score, "symbol"))


def universe(scores: DataFrame) -> DataFrame:
    return scores.groupBy("ts").agg(F.avg(net_return()).alias("universe_net"))


def topn_vs_universe(scores: DataFrame, n: int = 3) -> DataFrame:
    """Per session: mean net of the top n, of everything, and the difference. One pass: both are aggregates of the same groups."""
    net = net_return()
    daily = ranked(scores).groupBy("ts").agg(F.avg(F.when(F.col("rk") <= n, net)).alias("top_net"), F.avg(net).alias("universe_net"), F.sum((F.col("rk") <= n).cast("long")).alias("picks"))
    return daily.withColumn("excess", F.col("top_net") - F.col("universe_net"))


def topn_hit_table(scores: DataFrame, sizes: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """For each N: signals, sessions, realised rate with two errors, mean score of the daily top N."""
    picks = ranked(scores).where(F.col("rk") <= max(sizes)).withColumn("top_n", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes]))).where("rk <= top_n")
    out = picks.groupBy("top_n").agg(F.count("*").alias("signals"), F.count_distinct("ts").alias("sessions"), F.avg("y").alias("realised"), F.avg("p_raw").alias("mean_score"))
    return out.withColumn("se2", two_errors(F.col("realised"), F.col("signals")))


def rank_track_record(scores: DataFrame, top: int = 10) -> DataFrame:
    """By rank position: days, net, excess over the universe (basis points), hit rate; net under the wider target where known (``xr_s``)."""
    net, day = net_return(), Window.partitionBy("ts")
    rows = ranked(scores).withColumns({"net": net, "uni": F.avg(net).over(day)}).where(F.col("rk") <= top)
    return rows.groupBy("rk").agg(F.count("*").alias("days"), (F.avg("net") * 1e4).alias("net_bp"), (F.avg(F.col("net") - F.col("uni")) * 1e4).alias("excess_bp"), F.avg("hit").alias("hit"), *([(F.avg(net_return("xr_s")) * 1e4).alias("stretch_net_bp")] if "xr_s" in scores.columns else []))


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    return df.withColumns({"avg_rank": average_rank(value, "ts"), "pct_rank": percent_rank_average(value, "ts")})


def rank_ensemble(df: DataFrame, scores: list[str]) -> DataFrame:
    """Mean of the percent ranks of several scores."""
    parts = [percent_rank_average(c, "ts") for c in scores]
    return df.withColumn("ensemble", reduce(lambda a, b: a + b, parts) / len(parts))


def rank_correlation_by_date(df: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Spearman correlation a session over rows with both values; sessions of fewer than ``least`` are left out."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": average_rank(a, "ts"), "_b": average_rank(b, "ts")})
    return both.groupBy("ts").agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n")).where(F.col("n") >= least)


def rank_ic(df: DataFrame, a: str, b: str) -> DataFrame:
    by = rank_correlation_by_date(df, a, b)
    return by.agg(F.avg("rho").alias("rank_ic"), F.median(F.abs("rho")).alias("median_abs"), F.count("rho").alias("sessions"))


def spearman(df: DataFrame, a: str, b: str, least: int = 50) -> DataFrame:
    """One Spearman correlation over all rows; NULL below ``least`` pairs.

    Ranks of a whole table come from counts per distinct value, summed over ranges of values, so no
    single task sorts all rows.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ra, rb = global_average_rank(both, "a"), global_average_rank(both, "b")
    joined = both.join(ra.withColumnRenamed("rank", "ra"), "a").join(rb.withColumnRenamed("rank", "rb"), "b")
    return joined.agg(F.when(F.count("*") >= least, F.corr("ra", "rb")).alias("rho"), F.count("*").alias("n"))


def global_average_rank(df: DataFrame, value: str, slices: int = 256) -> DataFrame:
    """(value, rank, n): the average rank of each distinct value over the whole table.

    Values are cut into slices by approximate quantiles; a window numbers each slice, and the
    slices' totals, a few rows, shift them.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    cuts = sorted(set(df.approxQuantile(value, [k / slices for k in range(1, slices)], 0.001))) if slices > 1 else []
    edge = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    cut = counts.withColumn("slice", F.size(F.filter(edge, lambda c: c < F.col(value))))
    totals = cut.groupBy("slice").agg(F.sum("n").alias("t"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("n").over(within), F.lit(0))
    return cut.withColumn("upto", upto).join(F.broadcast(shifts), "slice").select(value, (F.col("shift") + F.col("upto") + (F.col("n") + 1) / 2.0).alias("rank"), "n")
