"""Intervals for daily series by circular block bootstrap, and verdicts from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions import net_return, verdict
from panelworks.operators.ranking import ranked

SCHEMA = "series string, mean double, lo double, hi double, n_dates long"


def block_bootstrap(daily: DataFrame, columns: list[str], block: int = 5, draws: int = 2000, seed: int = 7) -> DataFrame:
    """(series, mean, lo, hi, n_dates) for each column of a table with a row per session.

    ``lo`` and ``hi`` are the 2.5 and 97.5 percentiles of means over circular blocks of sessions, the last
    block cut to the series' length; NULL below two blocks of sessions. Where a block starts is a hash of
    series, seed, draw and block, so draws need no generator, spread over tasks and are the same everywhere.
    """
    by = Window.partitionBy("series")
    long = daily.unpivot(["ts"], columns, "series", "value").where("value is not null")
    x = long.withColumns({"i": F.row_number().over(by.orderBy("ts")) - 1, "n": F.count("*").over(by)})
    round_ = x.unionByName(x.where(F.col("i") < block).withColumn("i", F.col("i") + F.col("n")))
    after = [F.lead("value", k).over(by.orderBy("i")) if k else F.col("value") for k in range(block)]
    rest = F.pmod(F.col("n") - 1, F.lit(block)) + 1  # sessions of the last block
    whole, cut = sum(after[1:], after[0]), sum((F.when(rest > k, a).otherwise(0.0) for k, a in enumerate(after)), F.lit(0.0))
    starts = round_.select("series", "i", "n", whole.alias("whole"), cut.alias("cut")).where("i < n")
    means = long.groupBy("series").agg(F.avg("value").alias("mean"), F.count("*").alias("n_dates"))
    each = means.where(F.col("n_dates") >= 2 * block).select("series", F.ceil(F.col("n_dates") / block).alias("blocks"), "n_dates")
    drawn = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.md5(F.concat_ws(":", "series", F.lit(seed), "draw", "b"))
    at = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.col("n_dates")).cast("int")
    met = drawn.select("series", "draw", "n_dates", (F.col("b") == F.col("blocks") - 1).alias("last"), at.alias("i")).join(starts.drop("n"), ["series", "i"])
    sums = met.groupBy("series", "draw").agg((F.sum(F.when(F.col("last"), F.col("cut")).otherwise(F.col("whole"))) / F.first("n_dates")).alias("drawn"))
    ends = sums.groupBy("series").agg(F.percentile("drawn", 0.025).alias("lo"), F.percentile("drawn", 0.975).alias("hi"))
    return means.join(ends, "series", "left").select("series", "mean", "lo", "hi", "n_dates")


def decided(intervals: DataFrame, better: str = "better", worse: str = "worse") -> DataFrame:
    return intervals.withColumn("verdict", verdict(F.col("lo"), F.col("hi"), better, worse))


def guarded_intervals(intervals: DataFrame, least: int = 40) -> DataFrame:
    """Intervals become NULL below ``least`` sessions; means stay."""
    enough = F.col("n_dates") >= least
    return intervals.withColumns({c: F.when(enough, F.col(c)) for c in ("lo", "hi")})


def topn_evidence(scores: DataFrame, sizes: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(top_n, measure, mean, lo, hi, n_dates, clears): daily hit rate and net return of each top N, with intervals.

    ``clears``: the net return's interval lies above zero; false where there is none.
    """
    x = ranked(scores).withColumn("net", net_return()).where(F.col("rk") <= max(sizes))
    daily = x.groupBy("ts").agg(*[F.avg(F.when(F.col("rk") <= n, F.col(c))).alias(f"{c}_{n}") for n in sizes for c in ("hit", "net")])
    out = block_bootstrap(daily, [f"{c}_{n}" for n in sizes for c in ("hit", "net")])
    name = F.split("series", "_")
    return out.select(name[1].cast("long").alias("top_n"), name[0].alias("measure"), "mean", "lo", "hi", "n_dates", ((name[0] == "net") & F.coalesce(F.col("lo") > 0, F.lit(False))).alias("clears"))
