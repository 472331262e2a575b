"""Walk-forward folds, nested blocks and day blocks on the session axis; bags of days by hash order.

All of it is arithmetic on session numbers, so the tables have a row per session or per fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(sessions: DataFrame) -> DataFrame:
    return sessions.select("ts", F.col("sidx").cast("long").alias("sidx")).withColumn("n", F.count("*").over(Window.partitionBy()))


def forward_blocks(sessions: DataFrame, blocks: int = 5, least: float = 0.35, embargo: int = 5) -> DataFrame:
    """(block, train_end, test_start, test_end): expanding training up to ``embargo`` sessions before equal test blocks.

    Edges are the truncated points of an even grid from ``least`` of the sessions to all of them.
    """
    d = _numbered(sessions)
    size = d.groupBy().agg(F.max("n").alias("n")).select("n", F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("b"))
    edge = lambda b: F.floor(F.floor(F.col("n") * least) + (F.col("n") - F.floor(F.col("n") * least)) * b / float(blocks)).cast("long")
    grid = size.select(F.col("b").cast("long").alias("block"), edge(F.col("b") - 1).alias("lo"), (edge(F.col("b")) - 1).alias("hi"))
    grid = grid.withColumn("cut", F.col("lo") - embargo - 1)
    at = lambda name, out: sessions.select(F.col("sidx").cast("long").alias(name), F.col("ts").alias(out))
    return grid.join(at("cut", "train_end"), "cut").join(at("lo", "test_start"), "lo").join(at("hi", "test_end"), "hi").select("block", "train_end", "test_start", "test_end")


def day_blocks(sessions: DataFrame, blocks: int = 5, buffer_days: int = 10) -> DataFrame:
    """(block, lo, hi, guard_lo, guard_hi): contiguous blocks, the first ones a session longer, and the days kept out of training."""
    d = _numbered(sessions)
    big = (F.col("n") % blocks) * (F.floor(F.col("n") / blocks) + 1)
    block = F.when(F.col("sidx") < big, F.floor(F.col("sidx") / (F.floor(F.col("n") / blocks) + 1))).otherwise(F.col("n") % blocks + F.floor((F.col("sidx") - big) / F.floor(F.col("n") / blocks)))
    out = d.groupBy((block + 1).cast("long").alias("block")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return out.withColumns({"guard_lo": F.date_sub("lo", buffer_days), "guard_hi": F.date_add("hi", buffer_days)})


def calibration_split(sessions: DataFrame, tail: float = 0.25, embargo: int = 5) -> DataFrame:
    """(ts, part): fit, gap or calibrate, by the share of sessions at the end."""
    d = _numbered(sessions)
    cut = F.floor(F.col("n") * (1 - tail)).cast("long")
    return d.select("ts", F.when(F.col("sidx") < cut, "fit").when(F.col("sidx") >= cut - 1 + embargo, "calibrate").otherwise("gap").alias("part"))


def fold_parts(sessions: DataFrame, folds: DataFrame, tail: float = 0.25, embargo: int = 5) -> DataFrame:
    """(block, ts, part): what each fold's sessions are for: fit, gap, calibrate, embargo or test.

    A fold's training sessions end in a tail for calibration, an embargo after those to fit on. Sessions
    past the test block do not belong to the fold. Folds are a handful, sessions few.
    """
    d = sessions.select("ts", F.col("sidx").cast("long").alias("sidx")).join(F.broadcast(folds), F.col("ts") <= F.col("test_end"))
    n = F.count_if(F.col("ts") <= F.col("train_end")).over(Window.partitionBy("block"))
    cut = F.greatest(F.lit(1), F.floor(n * (1 - tail))).cast("long")
    start = F.least(cut - 1 + embargo, n - 1)
    at = F.row_number().over(Window.partitionBy("block").orderBy("ts")) - 1
    part = F.when(F.col("ts") >= F.col("test_start"), "test").when(F.col("ts") > F.col("train_end"), "embargo").when(at < cut, "fit").when(at >= start, "calibrate").otherwise("gap")
    return d.select("block", "ts", part.alias("part"))


def hashed_days(sessions: DataFrame, share: float = 0.8, bag: int = 0) -> DataFrame:
    """Whole days of a bag: the first ``share`` by a hash of day and bag."""
    order = Window.orderBy(F.md5(F.concat(F.col("ts").cast("string"), F.lit(f":{bag}"))))
    d = sessions.select("ts").withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy())})
    return d.where(F.col("_r") <= F.floor(F.col("_n") * share)).select("ts")


def hashed_bags(days: DataFrame, share: float = 0.8) -> DataFrame:
    """``hashed_days`` of many bags at once. ``days``: _fit, _group, _bag, ts, a row for each session that a fit may draw."""
    fit = Window.partitionBy("_fit")
    order = fit.orderBy(F.md5(F.concat(F.col("ts").cast("string"), F.lit(":"), F.col("_bag").cast("string"))))
    d = days.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(fit)})
    return d.where(F.col("_r") <= F.floor(F.col("_n") * share)).select("_fit", "_group", "ts")


def lockbox_parts(sessions: DataFrame, share: float = 0.15, embargo: int = 5) -> DataFrame:
    """(ts, part): research, a gap of ``embargo`` sessions, and the lockbox, the last ``share`` that no fold may see."""
    d = _numbered(sessions)
    start = F.floor(F.col("n") * (1 - share)).cast("long")
    return d.select("ts", F.when(F.col("sidx") >= start, "lockbox").when(F.col("sidx") < start - embargo, "research").otherwise("gap").alias("part"))


def held_out(df: DataFrame, block) -> DataFrame:
    """Rows of one block of days (a row of ``day_blocks``) as ``block``, rows outside its guard band as ``train``; the rest go."""
    inside = F.col("ts").between(F.lit(block["lo"]), F.lit(block["hi"]))
    guarded = F.col("ts").between(F.lit(block["guard_lo"]), F.lit(block["guard_hi"]))
    part = F.when(inside, "block").when(~guarded, "train")
    return df.withColumn("part", part).where("part is not null")
