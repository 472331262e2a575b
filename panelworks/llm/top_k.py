"""Exact top-k inner-product search: ball-tree branch and bound in each shard.

Rows are dealt into shards of bounded size; each shard's ball tree is built once and kept as a packed
row of a table. Queries come in large blocks. In a shard, every query opens leaves in the order of
their inner-product upper bounds, and stops when the best bound left is below its k-th score; the
queries that open the same leaf at the same time share one matrix product. Shards are searched in
waves, and the k-th score found so far goes along into the next wave.

A node's bound is the least of its parent's, the ball bound ``q.c + |q| r`` and the cone bound
``|q| n cos(max(0, t - w))`` (n: largest norm, w: widest angle to the centre, t: the query's angle to it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.learning import blob, table
from panelworks.sources.durable import durable


@dataclass(frozen=True)
class Search:
    k: int = 20
    shard_rows: int = 8192
    block_queries: int = 8192
    leaf: int = 128
    waves: tuple[int, ...] = (1, 8)  # shards a query has seen after each wave but the last


class BallTree:
    """Nodes in one array each, a parent before its children; rows permuted so that a node's stand in a row."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        order, span, parent, inner = np.arange(len(vectors)), [], [], []
        centres, radii, norms, cosines = [], [], [], []
        lengths = np.sqrt((vectors**2).sum(1))
        todo = [(0, len(vectors), -1)]
        while todo:
            lo, hi, above = todo.pop()
            own, length = vectors[order[lo:hi]], lengths[order[lo:hi]]
            centre = own.mean(0)
            apart = np.sqrt(((own - centre) ** 2).sum(1))
            size = np.sqrt((centre**2).sum())
            node = len(span)
            span.append((lo, hi)), parent.append(above), centres.append(centre)
            radii.append(apart.max() * (1 + 1e-9) + 1e-6)
            norms.append(length.max() * (1 + 1e-9))
            some = length > 0
            cosines.append((own[some] @ centre / (length[some] * size)).min() - 1e-9 if size > 0 and some.any() else -1.0)
            split = hi - lo > leaf and radii[-1] > 1e-5
            inner.append(split)
            if split:
                one = own[apart.argmax()]
                other = own[((own - one) ** 2).sum(1).argmax()]
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (other - one), mid)]
                todo += [(lo + mid, hi, node), (lo, lo + mid, node)]
        self.order, self.span, self.parent = order, np.array(span, np.int64), np.array(parent, np.int64)
        self.centres, self.radii, self.norms, self.cosines = np.array(centres), np.array(radii), np.array(norms), np.clip(np.array(cosines), -1.0, 1.0)
        self.leaves = np.flatnonzero(~np.array(inner))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with the rows of each leaf."""
        lengths = np.sqrt((queries**2).sum(1))[:, None]
        along = queries @ self.centres.T
        sizes = np.sqrt((self.centres**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(np.nan_to_num(along / (lengths * sizes), nan=1.0, posinf=1.0, neginf=1.0), -1, 1))
        cone = lengths * self.norms * np.cos(np.maximum(angle - np.arccos(self.cosines), 0.0))
        cone = np.where(sizes > 0, np.where(cone < 0, lengths * self.norms, cone), lengths * self.norms)
        ball = along + lengths * self.radii
        out = np.minimum(ball, cone)
        out += 1e-7 * (np.abs(out) + lengths * self.norms) + 1e-3
        for node in range(1, len(self.parent)):
            np.minimum(out[:, node], out[:, self.parent[node]], out=out[:, node])
        return out[:, self.leaves]


def exact_products(rows: np.ndarray, queries: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Integer inner products, a line for each query; beyond the range where doubles are exact, by Python's integers, held within a long."""
    if exact_floats:
        return queries @ rows.T
    limit = (1 << 63) - 1
    got = [[max(-limit, min(limit, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in rows] for q in queries]
    return np.array(got, np.int64).reshape(len(queries), len(rows))


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's k best, in order."""
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    use = place < k
    return owner[use], ids[use], scores[use]


def search_shard(tree: BallTree, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, search: Search, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of up to k best rows for each query, those below its floor left out.

    ``ids`` and ``vectors`` are in the tree's order and hold integers as doubles. A row with the
    query's own id is skipped. ``scored`` gets the numbers of (row, query) products computed.
    """
    exact = float(np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1]) < 2**53
    kind = np.float64 if exact else np.int64
    floors = floors.astype(np.float64).copy()
    bounds = tree.bounds(queries) if exact else np.full((len(queries), len(tree.leaves)), np.inf)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    alive = np.arange(len(queries))
    for step in range(len(tree.leaves)):
        leaf = turn[alive, step]
        open_ = bounds[alive, leaf] >= floors[alive]
        alive, leaf = alive[open_], leaf[open_]
        if not len(alive):
            break
        order = np.argsort(leaf, kind="stable")
        new = [best]
        for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            lo, hi = tree.span[tree.leaves[leaf[part[0]]]]
            asks = alive[part]
            scores = exact_products(vectors[lo:hi], queries[asks], exact)
            if scored is not None:
                scored.append(scores.size)
            own = ids[lo:hi] == query_ids[asks][:, None]
            if exact and hi - lo > search.k:  # ties with the k-th stay
                least = np.partition(np.where(own, -np.inf, scores), hi - lo - search.k, axis=1)[:, hi - lo - search.k]
                floors[asks] = np.maximum(floors[asks], least)
            q, r = np.nonzero((scores >= floors[asks][:, None]) & ~own) if exact else np.nonzero(~own)
            new.append((asks[q], ids[lo:hi][r], scores[q, r]))
        best = _best(*(np.concatenate(x) for x in zip(*new, strict=True)), search.k)
        if exact:
            count = np.bincount(best[0], minlength=len(queries))
            last = np.cumsum(count) - 1
            full = np.flatnonzero(count >= search.k)
            floors[full] = np.maximum(floors[full], best[2][last[full]])
    return best[0], best[1], best[2].astype(np.int64)


def quantised(column: str = "embedding", factor: float = 64.0) -> Column:
    """floor(factor * x) of every component as a double array; null unless all components are finite numbers."""
    whole = F.transform(F.col(column), lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double"))
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _packed(names: list[str]):
    """Task: the vectors ``v`` as the bytes of their doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            data, at = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"v": pa.array([blob(data[at[i] : at[i + 1]]) for i in range(len(v))], pa.binary())})

    return run


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


PARTS = ("span", "parent", "centres", "radii", "norms", "cosines", "leaves")


def _grow(leaf: int):
    """Group: a shard's ball tree, ids and vectors, packed into one row."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        vectors = _matrix(group["v"])
        tree = BallTree(vectors, leaf)
        packed = {n: blob(getattr(tree, n)) for n in PARTS} | {"ids": blob(group["vec_id"].to_numpy()[tree.order]), "vectors": blob(vectors[tree.order])}
        return pd.DataFrame({"width": [group["width"].iloc[0]], "shard": [group["shard"].iloc[0]]} | {n: [x] for n, x in packed.items()})

    return run


def _read(row: pd.Series) -> tuple[BallTree, np.ndarray, np.ndarray]:
    tree, width = BallTree.__new__(BallTree), int(row["width"])
    for n in PARTS:
        data = np.frombuffer(row[n], np.int64 if n in ("span", "parent", "leaves") else np.float64)
        setattr(tree, n, data.reshape(-1, 2) if n == "span" else data.reshape(-1, width) if n == "centres" else data)
    return tree, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, width)


def top_k(rows: DataFrame, queries: DataFrame, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest integer inner products, ties to the smaller vec_id.

    ``rows`` and ``queries`` have vec_id and ``v``, an array of whole doubles, and may have further
    columns; nulls in either take no part, nor do empty arrays. Vectors meet those of their own length
    only. Rows that repeat a vec_id count one by one; equal query rows count once. An empty side gives
    an empty result.
    """
    rows = rows.select(F.col("vec_id").cast("long"), "v").where("vec_id is not null and size(v) > 0").withColumn("width", F.size("v"))
    queries = queries.select(F.col("vec_id").cast("long"), "v").where("vec_id is not null and size(v) > 0").distinct().withColumn("width", F.size("v"))
    counted = rows.groupBy("width").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shards = max(1, -(-counted // search.shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).select("vec_id", "width", "shard", "v")
    dealt = dealt.mapInArrow(_packed(["vec_id", "width", "shard"]), "vec_id long, width int, shard int, v binary")
    trees = durable(dealt.groupBy("width", "shard").applyInPandas(_grow(search.leaf), "width int, shard int, " + ", ".join(f"{n} binary" for n in (*PARTS, "ids", "vectors"))))
    named = queries.withColumn("q", F.xxhash64("vec_id", "v", F.lit(1))).withColumn("home", F.pmod(F.xxhash64("q"), F.lit(shards)).cast("int"))
    asked = durable(named.select("q", "vec_id", "width", "home", "v").mapInArrow(_packed(["q", "vec_id", "width", "home"]), "q long, vec_id long, width int, home int, v binary"))
    blocks = max(1, -(-asked.count() // search.block_queries))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q", F.lit(2)), F.lit(blocks)).cast("int"))
    schema = "q long, query_id long, vec_id long, score long"
    keys = ["width", "shard", "block"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("q", "query_id", "vec_id", "score")})
        own, at = right["vec_id"].to_numpy(), right["q"].to_numpy()
        place, ids, scores = search_shard(*_read(left.iloc[0]), own, _matrix(right["v"]), right["floor"].to_numpy(), search)
        return pd.DataFrame({"q": at[place], "query_id": own[place], "vec_id": ids, "score": scores})

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    spread, best = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), None
    ends = sorted({min(w, shards) for w in search.waves} | {shards})
    for lo, hi in zip([0, *ends], ends):
        turn = asked.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda s: (F.col("home") + s) % shards).cast("array<int>")))
        if best is None:
            turn = turn.withColumn("floor", F.lit(-1e300))
        else:
            floors = best.groupBy("q").agg(F.when(F.count("*") >= search.k, F.min("score")).alias("floor"))
            turn = turn.join(floors, "q", "left").withColumn("floor", F.coalesce(F.col("floor").cast("double"), F.lit(-1e300)))
        found = spread.groupBy(*keys).cogroup(turn.groupBy(*keys)).applyInPandas(run, schema)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)
        if hi < shards:
            best = durable(best)
    return best.select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("v", quantised())
    return top_k(rows, rows.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
