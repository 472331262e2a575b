"""Connected components of a link table by distributed union-find.

Links point from the larger id to the smaller. Each task first unites its own links into stars, which
leaves few of them and no id with many parents. Then rounds: all parents of an id meet in one
partition, which unites what it holds; after that every id jumps to its parent's parent by a join,
whose hot side Spark can split. Nothing of it passes through the driver but two sums that tell
whether a round changed anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.sources.durable import durable


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the links of its partition as stars around the smallest member of each local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ends = list(parent)
    for k in range(0, len(ends), 1 << 16):
        stars = [(x, r) for x in ends[k : k + (1 << 16)] if (r := root(x)) != x]
        yield pa.RecordBatch.from_pydict({"u": pa.array([s[0] for s in stars], pa.int64()), "v": pa.array([s[1] for s in stars], pa.int64())})


def components(links: DataFrame, rounds: int = 60, settle: bool = True) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b: long): label is the smallest id that is reachable.

    Without ``settle`` it stops after ``rounds``: ids with the same label are connected, but a
    component may still have several labels. Null ends and links of an id with itself count for
    nothing; an empty table gives an empty result. ``links`` are read twice: hand over a stored table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    n = links.count()
    edges, state = edges.mapInArrow(_unite, "u long, v long"), None
    for _ in range(rounds):
        met = durable(edges.repartition("u").mapInArrow(_unite, "u long, v long"), n)
        up = met.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
        edges = durable(met.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")), n)
        if settle:
            seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if seen == state:
                break
            state = seen
    else:
        if settle:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
