"""The second stage's inputs as one frame, and how its decisions did on days its model had not seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions import net_return
from panelworks.operators import books, daybook, evaluation, models, panel_features
from panelworks.operators.ranking import ranked
from panelworks.operators.splits import forward_blocks
from panelworks.sources.durable import durable
from panelworks.sources.tables import sessions


def meta_features(scores: DataFrame, bars: DataFrame, top: int = 10) -> DataFrame:
    """The daily top with its standing, persistence, the model's form, the market's state and each pick's own moves.

    ``scores``: ts, symbol, p_raw, exit_ret. Series with a row per session are broadcast; the others
    meet on (symbol, ts).
    """
    key = ["ts", "symbol"]
    standing = panel_features.score_standing(scores, top)
    seen = panel_features.presence(scores, "p_raw").select(*key, F.col("presence").alias("top10_presence5"))
    moves = panel_features.returns_and_gaps(bars)
    form, market = panel_features.model_form(scores), daybook.market_state(moves)
    d = standing.join(seen, key, "left").join(moves, key, "left").join(F.broadcast(form), "ts", "left").join(F.broadcast(market), "ts", "left")
    return d.withColumn("win", (net_return() > 0).cast("long"))


def nested_picks(df: DataFrame, features: list[str], folds: int = 4, least: float = 0.40, pool: int = 5, **fit) -> DataFrame:
    """The pool of each later block of days, scored by a second stage fitted on earlier days only.

    ``df``: ts, symbol, rk, label, net. Adds meta_p, spread_lo, spread_hi, tau and block. One fit per
    block, blocks are a handful.
    """
    axis = durable(sessions(df))
    rows, blocks = durable(df.select("ts", "symbol", "rk", "label", "net", *features)), forward_blocks(axis, folds, least).orderBy("block").collect()
    before = lambda d, f: d.where(F.col("ts") <= F.lit(f["train_end"]))
    parts = []
    for f, fitted in zip(blocks, models.fit_metas([(before(rows, f), before(axis, f)) for f in blocks], features, **fit), strict=True):
        test = rows.where(F.col("ts").between(F.lit(f["test_start"]), F.lit(f["test_end"])) & (F.col("rk") <= pool))
        parts.append(models.predict_meta(fitted, test, features).withColumns({"tau": F.lit(fitted.tau), "block": F.lit(f["block"]).cast("long")}))
    return reduce(lambda a, b: a.unionByName(b), parts).select("ts", "symbol", "rk", "label", "net", "meta_p", "spread_lo", "spread_hi", "tau", "block")


def decided_picks(picks: DataFrame, k: int = 3, pool: int = 5) -> DataFrame:
    """``picks`` (ts, symbol, rk, meta_p, tau, net, label) with keep, size_x and mrank."""
    d = daybook.decisions(picks, F.col("tau"), k=k, pool=pool)
    return d.withColumns({"keep": F.col("action") == "TRADE", "mrank": F.col("meta_rank")}).drop("action", "meta_rank")


def nested_books(decided: DataFrame, k: int = 3) -> DataFrame:
    """Per session the four arms and their differences to the plain book."""
    d = books.slot_books(decided, k)
    return d.withColumns({f"{c}_minus_base": F.col(c) - F.col("base") for c in ("filtered", "sized", "reranked")})


def nested_summary(decided: DataFrame, k: int = 3) -> DataFrame:
    """One row: days, picks, share skipped, days all in cash, AUC, Brier score and skill, base rate, share of scores inside their band."""
    top = decided.where((F.col("rk") <= k) & F.col("meta_p").isNotNull())
    days = top.groupBy("ts").agg(F.count_if("keep").alias("kept"), F.count("*").alias("n"))
    by_day = days.agg(F.count("*").alias("days_tested"), F.count_if(F.col("kept") == 0).alias("days_all_cash"), (1 - F.sum("kept") / F.sum("n")).alias("skipped_share"))
    inside = F.col("meta_p").between(F.col("spread_lo"), F.col("spread_hi")).cast("double")
    p, y = F.col("meta_p"), F.col("label").cast("double")
    whole = top.agg(F.count("*").alias("picks_tested"), F.avg(y).alias("base_rate"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(inside).alias("band_coverage"))
    whole = whole.withColumn("brier_skill", 1 - F.col("brier") / F.nullif(F.col("base_rate") * (1 - F.col("base_rate")), F.lit(0.0)))
    auc = evaluation.roc_auc(top.withColumn("y", y), "meta_p").select("auc")
    return by_day.crossJoin(whole).crossJoin(auc)  # one row each


def nested_by_block(decided: DataFrame, k: int = 3) -> DataFrame:
    """(block, base_bp, filtered_bp, skipped): daily means over each block's sessions."""
    top = decided.where(F.col("rk") <= k)
    daily = top.groupBy("block", "ts").agg((F.sum("net") / k).alias("base"), (F.sum(F.when(F.col("keep"), F.col("net")).otherwise(0.0)) / k).alias("filtered"), F.count_if(~F.col("keep")).alias("out"), F.count("*").alias("n"))
    return daily.groupBy("block").agg((F.avg("base") * 1e4).alias("base_bp"), (F.avg("filtered") * 1e4).alias("filtered_bp"), (F.sum("out") / F.sum("n")).alias("skipped"))


def compared_runs(df: DataFrame, folds: DataFrame, runs: dict[str, list[str]], n: int = 3, kind: str = "gbt", cfg: models.Trees = models.Trees()) -> DataFrame:
    """(ts, <run>...): the daily net of each run's top n on the folds' test days.

    A run is a list of features: an ablation leaves some out, an A/B test adds some. ``df``: ts, symbol,
    label, exit_ret and the features. One walk-forward a run.
    """
    series = []
    for name, scored in zip(runs, models.walk_forwards(df, folds, list(runs.values()), kind, cfg), strict=True):
        scored = scored.select("ts", "symbol", "exit_ret", "p_raw")
        series.append(ranked(scored).where(F.col("rk") <= n).groupBy("ts").agg(F.avg(net_return()).alias(name)))
    return reduce(lambda a, b: a.join(b, "ts", "full"), series)


def lead_over(daily: DataFrame, one: str, other: str) -> DataFrame:
    """One row: means of two daily series over days that have both, and the mean of their difference, in basis points."""
    both = daily.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    bp = lambda x, name: (F.avg(x) * 1e4).alias(name)
    return both.agg(F.count("*").alias("days"), bp(F.col(one), "one_bp"), bp(F.col(other), "other_bp"), bp(F.col(other) - F.col(one), "lead_bp"))
