"""Hard-negative mining: all scores of an anchor sorted, and entries read below each positive's upper limit.

Rows are dealt into shards, anchors into blocks, both of bounded size and packed into one row each; a
task holds one shard against one block. It computes integer scores, sorts each anchor's by (score
descending, id) and reads its first rows of the same label; the best of all shards are the anchor's
positives. Their limits go back to the shards: in the same order, a binary search finds the first entry
at or below a positive's upper limit, and the different-label entries from there down to the lower limit
are read, k of them at most. The first k over all shards are the answer, as each shard's part of an
anchor's sorted list is complete down to its k-th entry. Scores are computed twice rather than stored:
they are as many as anchors times rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.learning import blob, table
from panelworks.llm.top_k import exact_products, quantised
from panelworks.llm.vectors import matrix, packed
from panelworks.sources.durable import durable


@dataclass(frozen=True)
class Mining:
    k: int = 3  # negatives of a positive
    positives: int = 5  # of an anchor
    low: int = 50  # percent of a positive's score that a negative reaches at least
    high: int = 95  # and at most
    shard_rows: int = 4096
    block_anchors: int = 2048
    at_once: int = 64  # anchors whose scores a task holds


def sorted_scores(ids: np.ndarray, vectors: np.ndarray, anchors: np.ndarray, at_once: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, order of the rows, their scores in it): by score from the highest, ties by smaller id."""
    exact = float(np.abs(vectors).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, vectors.shape[1])) < 2**53
    for lo in range(0, len(anchors), at_once):
        scores = exact_products(vectors, anchors[lo : lo + at_once], exact).astype(np.int64)
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)
        ordered = np.take_along_axis(scores, order, 1)
        for k in range(len(order)):
            yield lo + k, order[k], ordered[k]


def limits(positive: int, cfg: Mining) -> tuple[int, int]:
    """The least and the greatest score with low * positive <= 100 * score <= high * positive."""
    return -(-cfg.low * positive // 100), cfg.high * positive // 100


def below(ordered: np.ndarray, different: np.ndarray, positive: int, cfg: Mining) -> np.ndarray:
    """Places in the sorted list of the first k entries of another label within the positive's limits.

    ``different``: the places of entries of another label, ascending.
    """
    lower, upper = limits(positive, cfg)
    start = np.searchsorted(-ordered, -upper, side="left")
    near = different[np.searchsorted(different, start) :][: cfg.k]
    return near[ordered[near] >= lower]


def _bundle(columns: dict[str, str]):
    """Group: its rows as one, each column's values as bytes of its kind."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"width": [key[0]], "part": [key[1]]} | {c: [blob(group[c].to_numpy(kind)) if kind else b"".join(group[c])] for c, kind in columns.items()})

    return run


def _bundled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.groupBy("width", "part").applyInPandas(_bundle(columns), "width int, part int, " + ", ".join(f"{c} binary" for c in columns))


def _open(row: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["vec_id"], np.int64), np.frombuffer(row["label"], np.int64), np.frombuffer(row["v"], np.float64).reshape(-1, width)


def mine(rows: DataFrame, anchors: DataFrame, cfg: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    ``rows`` and ``anchors``: vec_id, label, ``v`` (an array of whole doubles) and any more columns; rows
    with a null in one of the three or an empty array take no part. Vectors meet those of their length
    only. A row is never its own anchor's positive or negative, nor is another of the same vec_id. Rows
    that repeat in all three count one by one (``max(k, positives)`` of them decide all that more would).
    Anchors without positives, and positives without a row within their limits, have no lines; a
    positive of a negative score has none, as its limits exclude each other. Empty sides give an empty
    result. Scores that exceed a long are held at its ends.
    """
    three = ["vec_id", "label", "v"]
    use = lambda df: df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v").where("vec_id is not null and label is not null and size(v) > 0")
    counted = use(rows).groupBy(*three).agg(F.count("*").alias("n"))
    copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(max(cfg.k, cfg.positives)))))
    kept = durable(packed(counted.withColumns({"width": F.size("v"), "copy": copies}).drop("n"), "v", "float64"))
    asked = durable(packed(use(anchors).distinct().withColumns({"width": F.size("v"), "q": F.xxhash64(*three)}), "v", "float64"))
    parts = lambda df, most: max(1, -(-(df.groupBy("width").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) // most))
    shards, blocks = parts(kept, cfg.shard_rows), parts(asked, cfg.block_anchors)
    dealt = kept.withColumn("part", F.pmod(F.xxhash64(*three, "copy"), F.lit(shards)).cast("int"))
    shard = durable(_bundled(dealt, {"vec_id": "int64", "label": "int64", "v": ""})).withColumnRenamed("part", "shard")
    block = _bundled(asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")), {"q": "int64", "vec_id": "int64", "label": "int64", "v": ""})
    block = durable(block).withColumnRenamed("part", "block")
    keys = ["width", "shard", "block"]
    every = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = every(shard, "block", blocks)

    def first(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(other):
            width = int(one["width"].iloc[0])
            ids, labels, vectors = _open(one.iloc[0], width)
            q, (own, marks, asks) = np.frombuffer(other["q"].iloc[0], np.int64), _open(other.iloc[0], width)
            for k, order, ordered in sorted_scores(ids, vectors, asks, cfg.at_once):
                same = np.flatnonzero((labels[order] == marks[k]) & (ids[order] != own[k]))[: cfg.positives]
                out.append(pd.DataFrame({"q": q[k], "positive_id": ids[order[same]], "positive_score": ordered[same]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q", "positive_id", "positive_score")})

    found = left.groupBy(*keys).cogroup(every(block, "shard", shards).groupBy(*keys)).applyInPandas(first, "q long, positive_id long, positive_score long")
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("p", turn).where(F.col("p") <= cfg.positives).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("p", "positive_id", "positive_score"))).alias("best"))
    wanted = asked.join(best, "q").withColumns({"part": F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"), "many": F.size("best"), "positive_id": F.col("best.positive_id"), "positive_score": F.col("best.positive_score")}).drop("best")
    wanted = packed(packed(wanted, "positive_id", "int64"), "positive_score", "int64")
    wanted = durable(_bundled(wanted, {"q": "int64", "vec_id": "int64", "label": "int64", "many": "int64", "v": "", "positive_id": "", "positive_score": ""})).withColumnRenamed("part", "block")
    names = ["q", "anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]

    def second(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(other):
            width, asked_ = int(one["width"].iloc[0]), other.iloc[0]
            ids, labels, vectors = _open(one.iloc[0], width)
            q, (own, marks, asks) = np.frombuffer(asked_["q"], np.int64), _open(asked_, width)
            ends = np.cumsum(np.frombuffer(asked_["many"], np.int64))
            which, scores = np.frombuffer(asked_["positive_id"], np.int64), np.frombuffer(asked_["positive_score"], np.int64)
            for k, order, ordered in sorted_scores(ids, vectors, asks, cfg.at_once):
                different = np.flatnonzero((labels[order] != marks[k]) & (ids[order] != own[k]))
                for p, at in enumerate(range(ends[k - 1] if k else 0, ends[k]), 1):
                    near = below(ordered, different, int(scores[at]), cfg)
                    out += zip(*([x] * len(near) for x in (q[k], own[k], p, which[at], scores[at])), ids[order[near]], ordered[near], strict=True)
        return pd.DataFrame(out, columns=names)

    found = left.groupBy(*keys).cogroup(every(wanted, "shard", shards).groupBy(*keys)).applyInPandas(second, ", ".join(f"{n} long" for n in names))
    turn = F.row_number().over(Window.partitionBy("q", "positive_rank").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= cfg.k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null or with null or non-finite components, null labels and null ids take no part."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("vec_id", label.alias("label"), quantised(factor=256.0).alias("v"))
    return mine(rows, rows.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank
  FROM pairs WHERE same QUALIFY positive_rank <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM positives JOIN pairs n USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
