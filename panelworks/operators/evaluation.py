"""How good scores are: AUC, log-loss, Brier, calibration, threshold sweeps, errors against a naive guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions import clip, equal_buckets, two_errors
from panelworks.operators.ranking import global_average_rank, spearman


def roc_auc(df: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """Rank-sum AUC; NULL with one class only. Ranks come from distinct scores, not from one sort of all rows."""
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    ones = d.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("ones"))
    both = global_average_rank(d, score).join(ones, score)
    return both.agg(F.sum("ones").alias("n1"), (F.sum("n") - F.sum("ones")).alias("n0"), F.sum(F.col("rank") * F.col("ones")).alias("s")).select(
        "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1").cast("double") * F.col("n0"))).alias("auc")
    )


def losses(df: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """Log-loss, Brier score and its skill over the base rate."""
    p = clip(F.col(score), 1e-6, 1 - 1e-6)
    t = F.col(y).cast("double")
    d = df.agg(F.avg(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("logloss"), F.avg((F.col(score) - t) * (F.col(score) - t)).alias("brier"), F.avg(t).alias("base_rate"))
    reference = F.col("base_rate") * (1 - F.col("base_rate"))
    return d.withColumn("brier_skill", F.when(reference > 0, 1 - F.col("brier") / reference))


def bucketed(df: DataFrame, score: str, tie: str, q: int, y: str = "y") -> DataFrame:
    """Adds ``bucket`` 1..q of equal counts by score, ties by ``tie``.

    The position of each row among all comes from the same sliced ranks as the AUC's, so no task sorts the table.
    """
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    place = global_average_rank(d, score)  # first place of a value: rank - (n - 1) / 2
    first = (F.col("rank") - (F.col("n") - 1) / 2.0).cast("long")
    total = d.agg(F.count("*").alias("_total"))
    within = F.row_number().over(Window.partitionBy(score).orderBy(tie)) - 1
    return d.join(place, score).crossJoin(F.broadcast(total)).withColumn("bucket", equal_buckets(first + within, F.col("_total"), q)).drop("rank", "n", "_total")


def calibration_table(df: DataFrame, score: str, tie: str, q: int = 10, y: str = "y") -> DataFrame:
    out = bucketed(df, score, tie, q, y).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(y).alias("realised"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    return out.withColumn("se2", two_errors(F.col("realised"), F.col("n")))


def threshold_sweep(df: DataFrame, breakeven: float = 0.424, score: str = "p", y: str = "y", least: int = 50) -> DataFrame:
    """For 26 cut-offs: signals, share, realised rate and whether it clears breakeven by two errors.

    Rows are counted by the highest cut-off they reach, 26 groups at most, and summed downwards.
    """
    spark = df.sparkSession
    cuts = spark.range(26).select(F.col("id").alias("k"), (F.lit(0.20) + F.col("id") * F.lit(0.02)).alias("t"))
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    edges = F.array(*[F.lit(0.20) + F.lit(k) * F.lit(0.02) for k in range(26)])
    reached = F.size(F.filter(edges, lambda t: F.col(score) >= t)) - 1
    levels = d.groupBy(reached.alias("k")).agg(F.count("*").alias("n"), F.sum(y).alias("ones"))
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    summed = cuts.join(levels, "k", "full").select("k", "t", F.sum(F.coalesce("n", F.lit(0))).over(down).alias("n"), F.sum(F.coalesce("ones", F.lit(0))).over(down).alias("ones"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rate = F.col("ones") / F.col("n")
    out = summed.where((F.col("k") >= 0) & (F.col("n") >= least)).select(F.round("t", 2).alias("threshold"), "n", (F.col("n") / F.col("total")).alias("share"), rate.alias("realised"))
    return out.withColumn("se2", two_errors(F.col("realised"), F.col("n"))).withColumns({"clears": F.col("realised") - F.col("se2") > breakeven, "margin": F.col("realised") - breakeven})


def error_vs_naive(df: DataFrame, predicted: str, real: str) -> DataFrame:
    """Mean absolute error of a prediction and of the median of all real values."""
    naive = df.agg(F.median(real).alias("naive"))
    d = df.where(F.col(predicted).isNotNull() & F.col(real).isNotNull()).crossJoin(F.broadcast(naive))
    out = d.agg(F.avg(F.abs(F.col(predicted) - F.col(real))).alias("error_model"), F.avg(F.abs(F.col("naive") - F.col(real))).alias("error_naive"))
    return out.withColumn("better", F.col("error_model") < F.col("error_naive"))


def reliability(df: DataFrame, predicted: str, real: str, naive: Column | None = None, least_rho: float = 0.10) -> DataFrame:
    """(n, spearman, error_model, error_naive, verdict) of a prediction, over the rows with both.

    It is ``useful`` if it ranks as the real values do (``least_rho``) and errs less than a constant: the
    median of all real values unless ``naive`` names a column.
    """
    constant = df.agg(F.median(real).alias("_naive"))
    both = df.where(F.col(predicted).isNotNull() & F.col(real).isNotNull())
    rho = spearman(both, predicted, real, 1).select(F.col("rho").alias("spearman"))
    d = both.crossJoin(F.broadcast(constant))
    guess = F.col("_naive") if naive is None else naive
    errors = d.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(predicted) - F.col(real))).alias("error_model"), F.avg(F.abs(guess - F.col(real))).alias("error_naive"))
    out = errors.crossJoin(rho)  # one row each
    good = (F.col("spearman") >= least_rho) & (F.col("error_model") < F.col("error_naive"))
    return out.select("n", "spearman", "error_model", "error_naive", F.when(good, "useful").otherwise("weak").alias("verdict"))


def within_rank_lift(df: DataFrame, score: str = "p_raw", least: int = 20) -> DataFrame:
    """By rank: net above the rank's median score less net at or below it, in basis points."""
    d = df.withColumn("_m", F.median(score).over(Window.partitionBy("rk")))
    high, low = F.col(score) > F.col("_m"), F.col(score) <= F.col("_m")
    out = d.groupBy("rk").agg(F.sum(high.cast("long")).alias("n_high"), F.sum(low.cast("long")).alias("n_low"), ((F.avg(F.when(high, F.col("net"))) - F.avg(F.when(low, F.col("net")))) * 1e4).alias("lift_bp"))
    return out.where((F.col("n_high") > least) & (F.col("n_low") > least))


def nearest_bucket(values: DataFrame, buckets: DataFrame, value: str = "p", predicted: str = "predicted") -> DataFrame:
    """Adds the bucket whose prediction is nearest, the first of equals; buckets are a handful of rows."""
    listed = buckets.agg(F.sort_array(F.collect_list(F.struct("bucket", predicted))).alias("_b"))
    nearest = F.array_min(F.transform("_b", lambda b: F.struct(F.abs(b[predicted] - F.col(value)).alias("d"), b["bucket"].alias("bucket"))))
    return values.crossJoin(F.broadcast(listed)).withColumn("bucket", nearest["bucket"]).drop("_b")
