"""Exact nearest past moments, each moment stored once and met by the queries that can need it.

A moment is a row of a pool: its session ``sidx``, its symbol and its place in a space of a few
dimensions. A query asks for the nearest moments up to a session ``cut``, so pools of later months
contain those of earlier ones and none is copied. Moments lie in shards (cells of the space, or
stretches of one symbol's sessions) of bounded size. In a task, a shard's moments stand in the leaves of
a small tree; a query opens leaves in the order of their boxes' distances until the next is farther
than its k-th moment.

Distances are compared at nine decimal places, ties go to the earlier session, then by symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.sources.durable import durable

SLACK = 2e-9  # distances are rounded to nine places


@dataclass(frozen=True)
class Sizes:
    cell: int = 8192  # moments of a cell, about
    cells: int = 1024  # at most; beyond, cells have more moments and come in parts
    part: int = 65_536  # moments a task holds at most
    sample: int = 65_536  # moments that place the cuts between cells, about
    block: int = 4096  # queries of a task
    sessions: int = 2048  # of one symbol in a shard
    leaf: int = 32


class Leaves:
    """Points in the order of their leaves, and each leaf's box."""

    def __init__(self, z: np.ndarray, leaf: int):
        order, todo, spans = np.arange(len(z)), [(0, len(z))], []
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                spans.append((lo, hi))
                continue
            own = z[order[lo:hi]]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.order, self.spans = order, spans
        self.low = np.array([z[order[a:b]].min(0) for a, b in spans])
        self.high = np.array([z[order[a:b]].max(0) for a, b in spans])


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each query from each box, zero inside."""
    return np.sqrt(sum(np.maximum(np.maximum(low[:, j] - q[:, j, None], q[:, j, None] - high[:, j]), 0.0) ** 2 for j in range(q.shape[1])))


def nearest(z: np.ndarray, sidx: np.ndarray, turn: np.ndarray, sampled: np.ndarray, q: np.ndarray, cut: np.ndarray, limit: np.ndarray, reach: np.ndarray, k: int, leaf: int, computed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, rows) of each query's k nearest points, a line each; rows are -1 where there are fewer.

    Only points with ``sidx`` up to the query's ``cut`` and a hash up to its ``limit`` count, and only those
    within its ``reach``. ``turn`` breaks ties. ``computed`` gets the numbers of distances computed.
    """
    tree = Leaves(z, leaf)
    order, first = tree.order, np.array([sidx[tree.order[a:b]].min() for a, b in tree.spans])
    z, s, t, h = z[order], sidx[order], turn[order], sampled[order]
    m = len(q)
    far, tie, row = np.full((m, k), np.inf), np.full((m, k), np.iinfo(np.int64).max), np.full((m, k), -1, np.int64)
    bound = box_distance(q, tree.low, tree.high)
    bound[cut[:, None] < first] = np.inf
    turns = np.argsort(bound, axis=1, kind="stable")
    alive = np.arange(m)
    for step in range(len(tree.spans)):
        which = turns[alive, step]
        b = bound[alive, which]
        go = np.isfinite(b) & (b <= np.minimum(far[alive, -1], reach[alive]) + SLACK)
        alive, which = alive[go], which[go]
        if not len(alive):
            break
        by = np.argsort(which, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(which[by])) + 1):
            lo, hi = tree.spans[which[part[0]]]
            at = alive[part]
            d = np.round(np.sqrt(sum((q[at, j, None] - z[lo:hi, j]) ** 2 for j in range(q.shape[1]))), 9)
            if computed is not None:
                computed.append(d.size)
            d[(s[lo:hi] > cut[at, None]) | (h[lo:hi] > limit[at, None]) | (d > reach[at, None] + SLACK)] = np.inf
            all_far, all_tie = np.hstack([far[at], d]), np.hstack([tie[at], np.broadcast_to(t[lo:hi], d.shape)])
            all_row = np.hstack([row[at], np.where(np.isfinite(d), order[lo:hi], -1)])
            best = np.lexsort((all_tie, all_far), axis=1)[:, :k]
            far[at], tie[at], row[at] = (np.take_along_axis(x, best, 1) for x in (all_far, all_tie, all_row))
    return far, row


def searched(pool: DataFrame, asked: DataFrame, keys: list[str], dims: list[str], outcomes: tuple[str, ...], k: int, sizes: Sizes = Sizes()) -> DataFrame:
    """(symbol, ts, seen, d, sidx, who, outcomes): up to k nearest moments of each query in each shard it names.

    ``pool``: keys (the shard), sidx long, who, sampled long, dims, outcomes. ``asked``: keys, symbol, ts,
    cut long, limit long, reach double, dims. ``seen`` stands in a query's first row of a shard: how many
    of the shard's moments it may use. A shard's queries come in blocks, its moments packed in one row.
    """
    fields = ["sidx", "who", "sampled", *dims, *outcomes]
    packed = pool.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("moments"))  # shards are bounded
    blocks = asked.groupBy(*keys).agg(F.ceil(F.count("*") / sizes.block).cast("int").alias("_blocks"))
    left = packed.join(blocks, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(*keys, "_block", "moments")
    right = asked.join(blocks.toDF(*blocks.columns), keys).withColumn("_block", F.pmod(F.xxhash64("symbol", "ts"), F.col("_blocks")).cast("int")).drop("_blocks")
    kinds = dict(asked.dtypes)
    schema = f"symbol {kinds['symbol']}, ts {kinds['ts']}, seen long, d double, sidx long, who {dict(pool.dtypes)['who']}, " + ", ".join(f"{o} double" for o in outcomes)

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["symbol", "ts", "seen", "d", "sidx", "who", *outcomes]
        if not shard.num_rows or not queries.num_rows:
            some = {"symbol": queries["symbol"], "ts": queries["ts"]}
            return pa.table({n: some[n].slice(0, 0) if n in some else pa.array([], pa.string() if n == "who" else pa.int64() if n in ("seen", "sidx") else pa.float64()) for n in names})
        moments = shard["moments"].combine_chunks()
        moments = moments.flatten() if isinstance(moments, pa.ListArray) else pa.concat_arrays([c.flatten() for c in moments.chunks])
        column = lambda n: moments.field(n)
        plain = lambda n: column(n).to_numpy(zero_copy_only=False)
        turn = np.empty(len(moments), np.int64)
        turn[pc.sort_indices(pa.table({"s": column("sidx"), "w": column("who")}), [("s", "ascending"), ("w", "ascending")]).to_numpy()] = np.arange(len(moments))
        z, sidx, sampled = np.column_stack([plain(d) for d in dims]), plain("sidx"), plain("sampled")
        dates = np.sort(sidx)
        out = []
        for lo in range(0, queries.num_rows, 512):
            part = queries.slice(lo, 512)
            of = lambda n: part[n].to_numpy()
            cut, limit = of("cut"), of("limit")
            far, row = nearest(z, sidx, turn, sampled, np.column_stack([of(d) for d in dims]), cut, limit, of("reach"), k, sizes.leaf)
            seen = np.searchsorted(dates, cut, side="right")
            i, j = np.nonzero(row >= 0)
            at = pa.array(row[i, j])
            out.append(pa.table({"symbol": part["symbol"].take(pa.array(i)), "ts": part["ts"].take(pa.array(i)), "seen": np.where(j == 0, seen[i], 0), "d": far[i, j]} | {n: column(n).take(at) for n in ("sidx", "who", *outcomes)}))
        return pa.concat_tables(out).combine_chunks()

    both = [*keys, "_block"]
    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(run, schema)


def listed(found: DataFrame, outcomes: tuple[str, ...], k: int) -> DataFrame:
    """(symbol, ts, _n, _near): of each query the moments it may use, and the k nearest of all shards, in order."""
    fields = ["d", "sidx", "who", *outcomes]
    near = F.slice(F.array_sort(F.collect_list(F.struct(*fields))), 1, k)  # k of each shard at most
    return found.groupBy("symbol", "ts").agg(F.sum("seen").alias("_n"), near.alias("_near"))


def gathered(found: DataFrame, outcomes: tuple[str, ...], k: int, eps: float, prefix: str) -> DataFrame:
    """(symbol, ts, <prefix><outcome>, <prefix>dist, <prefix>n, <prefix>kth): distance-weighted outcomes of the k nearest of all shards."""
    d = listed(found, outcomes, k)
    w = lambda x: 1.0 / (x["d"] + eps)
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda acc, x: acc + f(x))
    means = [(total(lambda x, o=o: w(x) * x[o]) / total(w)).alias(f"{prefix}{o}") for o in outcomes]
    return d.select("symbol", "ts", *means, (total(lambda x: x["d"]) / F.size("_near")).alias(f"{prefix}dist"), F.col("_n").alias(f"{prefix}n"), F.when(F.size("_near") >= k, F.element_at("_near", -1)["d"]).alias(f"{prefix}kth"))


class Cuts:
    """A balanced tree of cuts through the space: ``place`` tells a point's cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        todo = [(1, sample)]
        while todo:
            node, own = todo.pop()
            if node >> depth:
                continue
            if len(own):
                self.dim[node] = np.ptp(own, axis=0).argmax()
                self.at[node] = np.median(own[:, self.dim[node]])
            left = own[:, self.dim[node]] <= self.at[node]
            todo += [(2 * node, own[left]), (2 * node + 1, own[~left])]

    def place(self, z: np.ndarray) -> np.ndarray:
        node = np.ones(len(z), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (z[np.arange(len(z)), self.dim[node]] > self.at[node])
        return node - (1 << self.depth)


def _placed(df: DataFrame, cuts: Cuts, dims: list[str]) -> DataFrame:
    @F.pandas_udf("long")
    def cell(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for z in batches:
            z = (z,) if isinstance(z, pd.Series) else z  # a single dimension comes bare
            yield pd.Series(cuts.place(np.column_stack([np.asarray(x, float) for x in z])))

    return df.withColumn("cell", cell(*dims))


def across(moments: DataFrame, queries: DataFrame, dims: list[str], outcomes: tuple[str, ...], k: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Each query's nearest moments of all symbols up to its ``cut``, as found in all cells that can hold one of the k nearest.

    Two passes: the query's own cell first, whose k-th distance is an upper bound; then only cells whose
    box lies within it. ``moments``: sidx, who, sampled, dims, outcomes; ``queries``: symbol, ts, cut, limit,
    dims; none null. The driver gets the sample that places the cuts and a row for each cell.
    """
    n = moments.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(sizes.cells, n / sizes.cell))))))
    some = moments.where(F.pmod(F.xxhash64("who", "sidx", F.lit(3)), F.lit(max(1, n // sizes.sample))) == 0).select(*dims) if depth else None
    cuts = Cuts(np.array([tuple(r) for r in some.collect()], float).reshape(-1, len(dims)) if depth else np.zeros((0, len(dims))), depth)
    pool = durable(_placed(moments, cuts, dims))
    facts = pool.groupBy("cell").agg(F.count("*").alias("n"), F.min("sidx").alias("first"), *[f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]).collect()
    parts = max([1, *(-(-r["n"] // sizes.part) for r in facts)])
    pool = pool.withColumn("part", F.pmod(F.xxhash64("who", "sidx", F.lit(4)), F.lit(parts)).cast("int"))
    every = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = durable(_placed(queries, cuts, dims))
    keys = ["cell", "part"]
    home = durable(searched(pool, every(asked.withColumn("reach", F.lit(float("inf")))), keys, dims, outcomes, k, sizes))
    if len(facts) < 2:
        return home
    reach = listed(home, outcomes, k).select("symbol", "ts", F.when(F.size("_near") >= k, F.element_at("_near", -1)["d"]).alias("reach"))
    cells, first = np.array([r["cell"] for r in facts]), np.array([r["first"] for r in facts])
    low, high = (np.array([[r[f"{d}_{f}"] for d in dims] for r in facts], float) for f in ("min", "max"))

    @F.pandas_udf("array<long>")
    def others(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for own, cut, reach, *z in batches:
            d = box_distance(np.column_stack([np.asarray(x, float) for x in z]), low, high)
            go = (d <= np.asarray(reach, float)[:, None] + SLACK) & (cells != np.asarray(own)[:, None]) & (first <= np.asarray(cut)[:, None])
            yield pd.Series([cells[g] for g in go])

    wide = asked.join(reach, ["symbol", "ts"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    visits = every(durable(wide.withColumn("cell", F.explode(others("cell", "cut", "reach", *dims)))))
    return home.unionByName(searched(pool, visits, keys, dims, outcomes, k, sizes))


def within(moments: DataFrame, queries: DataFrame, dims: list[str], outcomes: tuple[str, ...], k: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Each query's k nearest moments of its own symbol up to its ``cut``, as found in each stretch of sessions."""
    of = lambda c: F.floor(F.col(c) / sizes.sessions).cast("int")
    pool = moments.withColumns({"symbol": F.col("who"), "stretch": of("sidx")})
    asked = queries.where("cut >= 0").withColumns({"reach": F.lit(float("inf")), "stretch": F.explode(F.sequence(F.lit(0), of("cut")))})
    return searched(pool, asked, ["symbol", "stretch"], dims, outcomes, k, sizes)


def apart(near: str, k: int, spacing: int) -> Column:
    """Of a sorted list of moments the first k that lie ``spacing`` sessions or more from all taken before."""
    far = lambda taken, x: F.forall(taken, lambda t: F.abs(t["sidx"] - x["sidx"]) >= spacing)
    step = lambda taken, x: F.when((F.size(taken) < k) & far(taken, x), F.concat(taken, F.array(x))).otherwise(taken)
    return F.aggregate(near, F.filter(near, lambda _: F.lit(False)), step)


CASE = ("ft", "exit_ret", "mfe", "mae", "days_tp")


def cases(rows: DataFrame, asked: DataFrame, dims: list[str], k: int = 10, spacing: int = 5, lag: int = 6, sizes: Sizes = Sizes()) -> DataFrame:
    """(symbol, ts, scope, place, who, sidx, d, ft, exit_ret, mfe, mae, days_tp, market_ret): past cases like each asked row, and what became of them.

    Scope ``self``: the symbol's own nearest moments, each ``spacing`` sessions or more from all before it;
    as one moment keeps at most 2 * spacing - 2 others out, k times as many of the nearest are enough to
    choose from. Scope ``cross``: the k nearest of all symbols. Only moments with an outcome, ``lag``
    sessions back or more, count; ``market_ret`` is the mean of all symbols' outcomes of that session.
    ``asked`` are some of ``rows`` (symbol, ts, sidx, dims, outcomes).
    """
    known = lambda df: df.where(finite(dims)).withColumns({"sidx": F.col("sidx").cast("long")} | {d: F.col(d).cast("double") for d in dims})
    done = known(rows).where("ft is not null and exit_ret is not null")
    moments = durable(done.select("sidx", F.col("symbol").alias("who"), F.lit(0).cast("long").alias("sampled"), *dims, *[F.col(c).cast("double").alias(c) for c in CASE]))
    queries = durable(known(asked).select("symbol", "ts", (F.col("sidx") - lag).alias("cut"), F.lit(0).cast("long").alias("limit"), *dims))
    wide = k * (2 * spacing - 1)
    own = listed(within(moments, queries, dims, CASE, wide, sizes), CASE, wide).select("symbol", "ts", F.lit("self").alias("scope"), apart("_near", k, spacing).alias("_near"))
    other = listed(across(moments, queries, dims, CASE, k, sizes), CASE, k).select("symbol", "ts", F.lit("cross").alias("scope"), "_near")
    each = own.unionByName(other).select("symbol", "ts", "scope", F.posexplode("_near").alias("place", "_m")).select("symbol", "ts", "scope", (F.col("place") + 1).cast("long").alias("place"), "_m.*")
    market = moments.groupBy("sidx").agg(F.avg("exit_ret").alias("market_ret"))
    return each.join(F.broadcast(market), "sidx", "left").select("symbol", "ts", "scope", "place", "who", "sidx", "d", *CASE, "market_ret")  # a row per session


def finite(columns: list[str]) -> Column:
    """All columns hold a number."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out
