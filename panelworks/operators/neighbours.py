"""Nearest past moments: across a pool, within a symbol up to a cut-off, and declustered."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators import analogues

def knn_sharded(queries: DataFrame, pool: DataFrame, k: int, digits: int = 9, shard_rows: int = 8192, block_queries: int = 1024) -> DataFrame:
    """(query_id, rank, id, dist): the k nearest pool rows of each query, ties to the smaller id.

    ``queries`` and ``pool``: id, v. Pool rows are dealt into shards and queries into blocks, both of bounded size; each (shard, block)
    gives its k nearest rows, which a window merges. A pool row with the query's own id is skipped.
    Distances are ranked by their ``digits`` decimal places; equal query rows count once. Vectors meet
    those of their own width.
    """
    pool, queries = (d.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).where("id is not null and v is not null").withColumn("width", F.size("v")) for d in (pool, queries.distinct()))
    shards, blocks = max(1, -(-pool.count() // shard_rows)), max(1, -(-queries.count() // block_queries))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = pool.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", numbers(blocks))
    asked = queries.withColumn("q", F.xxhash64("id", "v")).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("shard", numbers(shards))
    names = ["q", "query_id", "id", "dist"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, vectors = left["id"].to_numpy(), np.array(left["v"].tolist(), np.float64)
            norms = (vectors**2).sum(1)
            for lo in range(0, len(right), 64):
                part = right.iloc[lo : lo + 64]
                block = np.array(part["v"].tolist(), np.float64)
                sizes = (block**2).sum(1)
                rough = sizes[:, None] - 2 * block @ vectors.T + norms
                for i, (q, own) in enumerate(zip(part["q"], part["id"], strict=True)):
                    at = np.flatnonzero(ids != own)
                    near = rough[i, at]
                    if len(at) > k and np.isfinite(near).all():  # all that may be among the k: past the k-th by rounding at most
                        kth = max(np.partition(near, k - 1)[k - 1], 0.0)
                        slack = 1e-14 * (vectors.shape[1] + 8) * (sizes[i] + norms.max())
                        at = at[near <= (np.sqrt(kth + slack) + 10.0**-digits) ** 2 + slack]
                    dist = np.sqrt(((vectors[at] - block[i]) ** 2).sum(1))
                    first = np.lexsort((ids[at], np.round(dist, digits)))[:k]
                    found.append(pd.DataFrame({"q": q, "query_id": own, "id": ids[at][first], "dist": dist[first]}))
        return pd.concat(found) if found else pd.DataFrame({"q": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "dist": np.zeros(0)})

    keys = ["width", "shard", "block"]
    best = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "q long, query_id long, id long, dist double")
    order = Window.partitionBy("query_id", "q").orderBy(F.round("dist", digits), "id")
    return best.select(*names).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def knn_self(rows: DataFrame, dims: list[str], outcome: str, k: int = 20, lag: int = 6, least: int = 30, eps: float = 0.1, sizes: analogues.Sizes = analogues.Sizes()) -> DataFrame:
    """(symbol, ts, n, dist, mean): the distance-weighted outcome of a symbol's own k nearest finished moments.

    ``rows``: symbol, ts, sidx, dims, outcome. The pool of a month are rows entered ``lag`` sessions
    before the month's first session or earlier. Rows with a missing dimension take no part.
    """
    month = F.date_trunc("month", "ts")
    cuts = rows.groupBy(month.alias("month")).agg((F.min("sidx") - lag).alias("cut"))
    known = rows.where(analogues.finite(dims)).withColumn("sidx", F.col("sidx").cast("long"))
    q = known.withColumn("month", month).join(F.broadcast(cuts), "month").select("symbol", "ts", F.col("cut").cast("long").alias("cut"), F.lit(0).cast("long").alias("limit"), *dims)
    p = known.where(F.col(outcome).isNotNull()).select("sidx", F.col("symbol").alias("who"), F.lit(0).cast("long").alias("sampled"), *dims, F.col(outcome).cast("double").alias("y"))
    near = analogues.gathered(analogues.within(p, q.toDF(*q.columns), dims, ("y",), k, sizes), ("y",), k, eps, "_").where(F.col("_n") >= least)
    return near.select("symbol", "ts", F.col("_n").alias("n"), F.col("_dist").alias("dist"), F.col("_y").alias("mean"))


def declustered(pairs: DataFrame, keys: list[str], k: int = 10, spacing: int = 5) -> DataFrame:
    """(keys, picks): nearest first, each at least ``spacing`` sessions from all taken before, until k are taken.

    ``pairs``: keys, sidx, d. The fold runs over a sorted array of one key's own history.
    """
    sorted_ = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("d", "sidx"))).alias("_near"))
    empty = F.array().cast("array<struct<d:double,sidx:bigint>>")
    far = lambda taken, x: F.forall(taken, lambda t: F.abs(t["sidx"] - x["sidx"]) >= spacing)
    step = lambda taken, x: F.when((F.size(taken) < k) & far(taken, x), F.concat(taken, F.array(F.struct(x["d"].cast("double").alias("d"), x["sidx"].cast("bigint").alias("sidx"))))).otherwise(taken)
    return sorted_.select(*keys, F.aggregate("_near", empty, step).alias("picks"))
