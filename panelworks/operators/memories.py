"""What a symbol's own record and similar past moments say about now: decayed records, analogues, their blend.

``rows`` everywhere: ts, symbol, columns of outcomes. Only finished trades count: outcomes ``lag``
sessions old or older. Sessions and months are few; the rest is keyed by symbol or by month and block.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions import guarded
from panelworks.operators import analogues
from panelworks.operators.sampling import hash60, hash_limits
from panelworks.sources.durable import durable

OUTCOMES = ("tp", "ret", "mfe", "mae", "sl")


def own_record(rows: DataFrame, outcomes: tuple[str, ...] = OUTCOMES, compared: tuple[str, ...] = ("tp", "ret"), lag: int = 6, halflife_days: float = 365.0, prior_k: float = 30.0, horizon: float = 5.0, least: int = 20) -> DataFrame:
    """(symbol, ts, own_<outcome>, own_<outcome>_vs_market, own_neff): decayed records shrunk to the market's.

    Weights halve with the days between known outcomes; the market's record halves with sessions. The
    number of finished trades is that of the first outcome, for all of them. One shuffle by symbol.
    """
    sessions_half = max(halflife_days * 250 / 365, 1.0)
    order = Window.partitionBy("symbol").orderBy("ts")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    known = lambda o: F.col(f"_k_{o}")
    d = rows.select("symbol", "ts", *outcomes).withColumns({f"_k_{o}": F.lag(o, lag).over(order) for o in outcomes} | {"_days": F.coalesce(F.date_diff("ts", F.lag("ts").over(order)), F.lit(0)).cast("double")})
    d = d.withColumns({f"_a_{o}": F.sum(F.when(known(o).isNotNull(), F.col("_days")).otherwise(0.0)).over(upto) for o in outcomes})
    d = d.withColumns({f"_w_{o}": F.when(known(o).isNotNull(), F.pow(F.lit(2.0), F.col(f"_a_{o}") / halflife_days)) for o in outcomes})
    d = d.withColumns({f"_e_{o}": F.sum(F.col(f"_w_{o}") * known(o)).over(upto) / F.sum(f"_w_{o}").over(upto) for o in outcomes} | {"_n": F.count(known(outcomes[0])).over(upto)})

    axis = Window.orderBy("ts")
    before = axis.rowsBetween(Window.unboundedPreceding, 0)
    daily = rows.groupBy("ts").agg(*[F.avg(o).alias(o) for o in outcomes])
    daily = daily.withColumns({f"_w_{o}": F.when(F.col(o).isNotNull(), F.pow(F.lit(2.0), F.count(o).over(before) / sessions_half)) for o in outcomes})
    daily = daily.withColumns({f"_m_{o}": F.sum(F.col(f"_w_{o}") * F.col(o)).over(before) / F.sum(f"_w_{o}").over(before) for o in outcomes})
    prior = daily.select("ts", *[F.lag(f"_m_{o}", lag).over(axis).alias(f"_p_{o}") for o in outcomes])

    n = F.least(F.col("_n").cast("double"), F.lit(2.0 * sessions_half)) / horizon
    shrunk = {o: guarded((n * F.col(f"_e_{o}") + prior_k * F.col(f"_p_{o}")) / (n + prior_k), F.col("_n"), least) for o in outcomes}
    out = d.join(F.broadcast(prior), "ts", "left")  # a row per session
    return out.select("symbol", "ts", *[shrunk[o].alias(f"own_{o}") for o in outcomes], *[(shrunk[o] - F.col(f"_p_{o}")).alias(f"own_{o}_vs_market") for o in compared], n.alias("own_neff"))


def _months(rows: DataFrame, finished: Column, lag: int, least: int) -> DataFrame:
    """(month, cut): months whose pool, the finished rows entered up to ``cut``, has ``least`` rows or more."""
    daily = rows.groupBy("sidx").agg(F.min(F.trunc("ts", "month")).alias("month"), F.count_if(finished).alias("ok"))
    daily = daily.withColumn("pool", F.sum("ok").over(Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, 0)))
    months = daily.groupBy("month").agg((F.min("sidx") - lag).alias("cut"))
    upto = daily.select(F.col("sidx").alias("cut"), "pool")
    return months.join(upto, "cut").where(F.col("pool") >= least).select("month", F.col("cut").cast("long").alias("cut"))


def memory(rows: DataFrame, dims: list[str], outcomes: tuple[str, ...] = OUTCOMES, lag: int = 6, k_cross: int = 50, k_self: int = 20, least_self: int = 30, least_pool: int = 5_000, pool_cap: int | None = None, eps: float = 0.1, shrink_k: float = 10.0, horizon: float = 5.0, block: int = 4096, sizes: analogues.Sizes = analogues.Sizes()) -> DataFrame:
    """(symbol, ts, mem_...): outcomes of the nearest finished moments of all symbols and of the symbol itself, and their blend.

    ``rows`` has sidx (the session's number) and the dimensions; rows with a missing dimension take no
    part. Pools are renewed each month: rows with all outcomes, entered ``lag`` sessions before the
    month's first session or earlier; a month with fewer than ``least_pool`` has no memory. Pools across
    symbols are whole unless ``pool_cap`` asks for samples: then a month's is its first ``pool_cap`` rows
    by a hash of their key. Samples of all months come from one reading of the rows, as a later month's
    is a part of the earlier months' and of what came in since.
    """
    sizes = replace(sizes, block=block)
    known = rows.where(analogues.finite(dims)).withColumns({"sidx": F.col("sidx").cast("long")} | {c: F.col(c).cast("double") for c in (*dims, *outcomes)})
    finished = F.lit(True)
    for o in outcomes:
        finished = finished & F.col(o).isNotNull()
    months = _months(known, finished, lag, least_pool)
    months = F.broadcast(rows.sparkSession.createDataFrame(sorted(map(tuple, months.collect())), months.schema))  # a row per month
    hashed = F.lit(0).cast("long") if pool_cap is None else hash60(F.concat_ws("/", "symbol", "ts"))
    moments = durable(known.where(finished).select("sidx", F.col("symbol").alias("who"), hashed.alias("sampled"), *dims, *outcomes))
    months = months.withColumn("limit", F.lit(0).cast("long")) if pool_cap is None else _sampled(moments, months, pool_cap)
    queries = durable(known.withColumn("month", F.trunc("ts", "month")).join(months, "month").select("symbol", "ts", "cut", "limit", *dims))

    cross = analogues.gathered(analogues.across(moments, queries, dims, outcomes, k_cross, sizes), outcomes, k_cross, eps, "mem_cross_").drop("mem_cross_n", "mem_cross_kth")
    own = analogues.gathered(analogues.within(moments.withColumn("sampled", F.lit(0).cast("long")), queries, dims, outcomes, k_self, sizes), outcomes, k_self, eps, "mem_self_").drop("mem_self_kth")
    own = own.where(F.col("mem_self_n") >= least_self).withColumn("mem_self_n", F.col("mem_self_n").cast("double"))

    d = cross.join(own, ["symbol", "ts"], "left")
    n = F.coalesce("mem_self_n", F.lit(0.0)) / horizon
    one, all_ = (lambda o: F.col(f"mem_self_{o}")), (lambda o: F.col(f"mem_cross_{o}"))
    d = d.withColumns({f"mem_{o}": F.when(one(o).isNotNull(), (n * one(o) + shrink_k * all_(o)) / (n + shrink_k)).otherwise(all_(o)) for o in outcomes})
    spread = F.greatest(F.lit(0.0), F.col("mem_tp") * (1 - F.col("mem_tp")))
    return d.withColumns({"mem_gap_tp": one("tp") - all_("tp"), "mem_gap_ret": one("ret") - all_("ret"), "mem_tp_se": F.sqrt(spread / F.greatest(n + k_cross / horizon, F.lit(1.0)))})


def _sampled(moments: DataFrame, months: DataFrame, cap: int) -> DataFrame:
    """``months`` with ``limit``: moments up to the cut whose hash is no greater are the month's sample."""
    turns = sorted((r["cut"], r["month"]) for r in months.collect())
    cuts = [c for c, _ in turns]
    later = F.lit(len(turns))
    for g in reversed(range(len(turns))):
        later = F.when(F.col("sidx") <= cuts[g], g).otherwise(later)
    limits = hash_limits(moments.withColumn("_entered", later), "sampled", "_entered", len(turns), cap)
    return F.broadcast(months.sparkSession.createDataFrame([(m, c, x) for (c, m), x in zip(turns, limits, strict=True)], "month date, cut long, limit long"))


def remembered(rows: DataFrame, dims: list[str], missing: str, **settings) -> DataFrame:
    """The own record and the memory of every row that has any of them, and the number of missing dimensions."""
    record, past = own_record(rows), memory(rows, dims, **settings)
    d = rows.select("symbol", "ts", F.col(missing).alias("state_missing")).join(record, ["symbol", "ts"], "left").join(past, ["symbol", "ts"], "left")
    return d.where(F.coalesce(*[F.col(c) for c in d.columns if c.startswith(("own_", "mem_"))]).isNotNull())
