"""Column functions with the panel's semantics for ties and missing values."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rank_by_score(score: str, *ties: str, by: str = "ts") -> Column:
    """Row number by descending score in each group; NULL scores have no rank."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), *ties)
    return F.when(F.col(score).isNotNull(), F.row_number().over(order)).cast("long")


def average_rank(value: str, by: str | list[str]) -> Column:
    """Ascending rank, ties sharing their mean rank; NULL stays NULL. Several in a row need one exchange by the group."""
    by = [by] if isinstance(by, str) else by
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    same = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0)


def percent_rank_average(value: str, by: str | list[str]) -> Column:
    """Average rank over the number of values present."""
    keys = [by] if isinstance(by, str) else by
    return average_rank(value, by) / F.count(value).over(Window.partitionBy(*keys))


def equal_buckets(rank: Column, count: Column, q: int) -> Column:
    """Bucket 1..q of a rank among ``count``: edges at equal steps of rank, upper edges inside."""
    return F.when(count <= 1, F.lit(1)).otherwise(F.greatest(F.ceil((rank - 1) * F.lit(q) / (count - 1)), F.lit(1))).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded value; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def guarded(value: Column, count: Column, least: int) -> Column:
    return F.when(count >= least, value)


def net_return(exit_ret: str = "exit_ret", cost_bps: float = 35.0) -> Column:
    return F.col(exit_ret) - F.lit(cost_bps / 1e4)


def two_errors(rate: Column, n: Column) -> Column:
    """Two binomial standard errors of a rate."""
    return 2 * F.sqrt(rate * (1 - rate) / n)


def verdict(low: Column, high: Column, better: str, worse: str, neither: str = "no clear difference") -> Column:
    """By an interval of a difference: above zero, below zero, or neither (also where it is missing)."""
    return F.when(low > 0, better).when(high < 0, worse).otherwise(neither)


def outcome_name(first_touch: str) -> Column:
    c = F.col(first_touch)
    return F.when(c == 1, "TARGET").when(c == -1, "STOP").when(c == 0, "TIMEOUT")


def percentile_word(x: Column) -> Column:
    return F.when(x >= 90, "very high").when(x >= 75, "high").when(x <= 10, "very low").when(x <= 25, "low").when(x.isNotNull(), "middle")


def percent(x: Column, places: int = 0) -> Column:
    """A share in percent, rounded half away from zero."""
    return F.round(100 * x, places)


def band_text(low: Column, high: Column) -> Column:
    """An interval of shares as whole percents, ``12-34``; ``n/a`` if an end is missing."""
    whole = lambda x: percent(x).cast("long").cast("string")
    return F.coalesce(F.concat(whole(low), F.lit("-"), whole(high)), F.lit("n/a"))


def content_id(*columns: str) -> Column:
    """First ten hex digits of the SHA-1 of a row's JSON."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 10)
