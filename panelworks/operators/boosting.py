"""Gradient boosting on histograms: an L2 penalty, a learned side for missing values, median leaves.

Features become bins (at most 255 and one for missing), rows are packed into blocks with their bins. Many
models grow side by side: a level of all their next trees is one pass, as a pass over little costs what a
job costs. Every task sums gradients, hessians and counts of its rows by (model, node, feature, bin), sums
of models whose rows lie in several tasks meet by key, and splits are picked where the sums are; the
driver sees the splits alone. Gradients are summed as whole numbers of 2**-32, so that sums do not hang on
the order of rows or tasks, nor on which models grow together.

For the log loss a leaf is -G / (H + l2); for the absolute error trees follow the signs of the residuals
and a leaf is the median of its rows' residuals. Trees are grown level by level to a depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.sources.durable import durable

MISSING = 255
UNIT = float(1 << 32)


@dataclass(frozen=True)
class Boosting:
    rounds: int = 300
    depth: int = 5
    rate: float = 0.06
    leaf: int = 200
    l2: float = 1.0
    loss: str = "log"  # or "absolute"
    bins: int = 255
    block: int = 16_384  # rows packed together
    stored: int = 10  # trees after which rows' scores are stored anew
    few: int = 16  # blocks of a task, where there are many


@dataclass
class Tree:
    """Nodes as in a heap: the children of i are 2i + 1 and 2i + 2. ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    split: np.ndarray  # bins up to it go left
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins`` (n, features)."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == MISSING, self.missing_left[at], b <= self.split[at])
            at = np.where(f < 0, at, 2 * at + 2 - left)
        return at


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]  # of each feature, ascending; a value's bin is the number of edges below it
    base: float
    loss: str
    trees: list[Tree]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, (x, edges) in enumerate(zip(columns, self.edges, strict=True)):
            out[:, k] = np.where(np.isnan(x), MISSING, np.searchsorted(edges, x, side="left"))
        return out

    def raw(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the trees from ``first`` on, without the base."""
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += tree.value[tree.place(bins)]
        return out

    def output(self, columns: list[np.ndarray]) -> np.ndarray:
        """The probability of label 1, or the predicted value, of each row."""
        f = self.base + self.raw(self.binned(columns))
        return 1 / (1 + np.exp(-f)) if self.loss == "log" else f

    def score(self, spark: SparkSession) -> Column:
        """``output`` of each row."""
        return scores(spark, [self])[0]

    def gains(self) -> np.ndarray:
        """Gain of all splits on each feature."""
        out = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(out, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Three tables under ``path``: edges, nodes, and the base."""
        edges = [(k, f, self.edges[k].tolist()) for k, f in enumerate(self.features)]
        spark.createDataFrame(edges, "k int, feature string, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")
        nodes = [(t, n, int(x.feature[n]), int(x.split[n]), bool(x.missing_left[n]), float(x.value[n]), float(x.gain[n])) for t, x in enumerate(self.trees) for n in range(len(x.feature))]
        spark.createDataFrame(nodes, "tree int, node int, feature int, split int, missing_left boolean, value double, gain double").write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.base, self.loss)], "base double, loss string").write.mode("overwrite").parquet(f"{path}/base")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        edges = sorted(spark.read.parquet(f"{path}/edges").collect())
        base = spark.read.parquet(f"{path}/base").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        trees = [Tree(*(g[c].to_numpy() for c in ("feature", "split", "missing_left", "value", "gain"))) for _, g in nodes.groupby("tree")]
        return cls([r["feature"] for r in edges], [np.array(r["edges"], float) for r in edges], base["base"], base["loss"], trees)


def scores(spark: SparkSession, models: list[Model]) -> Column:
    """An array of each model's output; models have the same features."""
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = (columns,) if isinstance(columns, pd.Series) else columns  # a single feature comes bare
            x = [c.to_numpy(float) for c in columns]
            yield pd.Series(list(np.column_stack([m.output(x) for m in shared.value])))

    return run(*[F.col(c).cast("double") for c in models[0].features])


def gradients(loss: str, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives as whole numbers of 2**-32."""
    if loss == "log":
        p = 1 / (1 + np.exp(-f))
        return np.round((p - y) * UNIT).astype(np.int64), np.round(p * (1 - p) * UNIT).astype(np.int64)
    return (np.sign(f - y) * UNIT).astype(np.int64), np.full(len(y), int(UNIT))


def best_splits(sums: np.ndarray, cfg: Boosting) -> list[tuple[float, int, int, bool] | None]:
    """For each node (gain, feature, bin, whether missing goes left), or None. ``sums``: (3, nodes, features, 256).

    Ties go to the lower feature, the lower bin, and missing to the left.
    """
    g, h, n = sums[0] / UNIT, sums[1] / UNIT, sums[2]
    out = []
    gain = lambda a, b: a * a / np.maximum(b + cfg.l2, 1e-300)
    for k in range(g.shape[0]):
        total = [x[k, 0].sum() for x in (g, h, n)]
        found = None
        if n.shape[1] and total[2] >= 2 * cfg.leaf:
            options = []
            for left in (True, False):
                gl, hl, nl = (np.cumsum(x[k, :, :MISSING], axis=1) + (x[k, :, MISSING:] if left else 0) for x in (g, h, n))
                ok = (nl >= cfg.leaf) & (total[2] - nl >= cfg.leaf)
                options.append(np.where(ok, gain(gl, hl) + gain(total[0] - gl, total[1] - hl) - gain(total[0], total[1]), -np.inf))
            value = np.stack(options, axis=2)  # feature, bin, side
            at = int(value.argmax())
            if value.flat[at] > 1e-12:
                f, b, side = np.unravel_index(at, value.shape)
                found = float(value.flat[at]), int(f), int(b), side == 0
        out.append(found)
    return out


Blocks = RDD[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # fit, labels, scores, bins (n, features)
Split = tuple[tuple[float, int, int, bool] | None, np.ndarray, np.ndarray | None]  # of a node, with the sums of all its rows and of those that go left


def _decided(sums: np.ndarray, cfg: Boosting) -> Split:
    """``sums``: (3, features, 256) of one node."""
    split = best_splits(sums[:, None], cfg)[0]
    if split is None:
        return None, sums[:2, 0].sum(-1), None
    _, feature, b, left = split
    return split, sums[:2, 0].sum(-1), sums[:2, feature, : b + 1].sum(-1) + (sums[:2, feature, MISSING] if left else 0)


def _median(x: np.ndarray) -> float:
    x = np.partition(x, [(len(x) - 1) // 2, len(x) // 2])
    return float(0.5 * x[(len(x) - 1) // 2] + 0.5 * x[len(x) // 2])


class _Rows:
    """Packed rows of all fits. ``apart``: some fit's rows lie in several blocks, hence in several tasks."""

    def __init__(self, rows: DataFrame, fits: dict[int, Model], counts: dict[int, int], names: list[str], cfg: Boosting):
        self.fits, self.cfg, self.apart = fits, cfg, max(counts.values()) > cfg.block
        self.sc = rows.sparkSession.sparkContext
        at = {k: [names.index(c) for c in m.features] for k, m in fits.items()}
        base = self.sc.broadcast({k: replace(m, trees=[]) for k, m in fits.items()})

        def packed(fit: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            y, x = table.column("y").to_numpy().astype(float), [table.column(f"x{k}").to_numpy().astype(float) for k in at[fit]]
            model = base.value[fit]
            return pa.RecordBatch.from_pydict({"fit": pa.array([fit], pa.int32())} | {n: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for n, v in (("y", y), ("bins", model.binned(x)))})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by fit."""
            held, n = [], 0
            for batch in batches:
                ids = batch.column("fit").to_numpy()
                cuts = np.flatnonzero(np.diff(ids)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                    while lo < hi:
                        if held and (held[0].column("fit")[0].as_py() != ids[lo] or n == cfg.block):
                            yield packed(held[0].column("fit")[0].as_py(), held)
                            held, n = [], 0
                        take = min(hi - lo, cfg.block - n)
                        held.append(batch.slice(lo, take))
                        lo, n = lo + take, n + take
            if held:
                yield packed(held[0].column("fit")[0].as_py(), held)

        self.parts = max(self.sc.defaultParallelism, -(-sum(-(-n // cfg.block) for n in counts.values()) // cfg.few))
        dealt = rows.repartition(self.parts) if self.apart else rows.repartition(self.parts, "fit")
        table = durable(dealt.sortWithinPartitions("fit").mapInArrow(pack, "fit int, y binary, bins binary"))
        width, start = {k: len(m.features) for k, m in fits.items()}, {k: m.base for k, m in fits.items()}

        def unpacked(row) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
            y = np.frombuffer(bytes(row["y"]))
            return row["fit"], (y, np.full(len(y), start[row["fit"]]), np.frombuffer(bytes(row["bins"]), np.uint8).reshape(-1, width[row["fit"]]))

        blocks = table.rdd.map(unpacked)
        if not self.apart:  # few blocks: the tasks get as much each
            load, place = [0] * self.parts, {}
            for k in sorted(counts, key=lambda k: (-counts[k], k)):
                place[k] = int(np.argmin(load))
                load[place[k]] += counts[k] * width[k]
            blocks = blocks.partitionBy(self.parts, lambda k: place[k])
        self.base: Blocks = blocks.map(lambda r: (r[0], *r[1])).persist(StorageLevel.MEMORY_AND_DISK)
        self.now, self.kept = self.base, {k: 0 for k in fits}  # trees that the scores at hand know
        self.shared = None

    def store(self) -> None:
        """Scores with all trees so far, made of the rows as packed, so that lineage stays short."""
        shared = self.sc.broadcast(self.fits)

        def run(block):
            fit, y, f, bins = block
            return fit, y, f + shared.value[fit].raw(bins), bins

        before, was, self.now = self.now, self.shared, self.base.map(run).persist(StorageLevel.MEMORY_AND_DISK)
        self.now.count()
        self.kept, self.shared = {k: len(m.trees) for k, m in self.fits.items()}, shared
        if was is not None:
            before.unpersist()
            was.unpersist()

    def drop(self) -> None:
        self.now.unpersist()
        self.base.unpersist()
        if self.shared is not None:
            self.shared.unpersist()

    def _late(self, fits) -> dict[int, Model]:
        """Models with the trees alone that the scores at hand lack."""
        return {k: replace(self.fits[k], edges=[], trees=self.fits[k].trees[self.kept[k] :]) for k in fits}

    def splits(self, trees: dict[int, Tree], level: int) -> list[tuple[tuple[int, int], Split]]:
        """((fit, node of the level), what is found for it), by sums over all rows."""
        late, cfg, nodes, first = self._late(trees), self.cfg, 1 << level, (1 << level) - 1

        def sums(blocks) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            out = {}
            for fit, y, f, bins in blocks:
                if fit not in trees or not bins.shape[1]:
                    continue
                width = bins.shape[1]
                at = trees[fit].place(bins) - first
                use = np.flatnonzero(at >= 0)
                g, h = gradients(late[fit].loss, (f + late[fit].raw(bins))[use], y[use])
                slot = ((at[use, None] * width + np.arange(width)) * 256 + bins[use]).ravel()
                # whole numbers below 2**32 of a block: their sums are exact as doubles
                got = [np.bincount(slot, None if x is None else np.repeat(x.astype(float), width), nodes * width * 256) for x in (g, h, None)]
                got = np.stack(got).astype(np.int64).reshape(3, nodes, width, 256)
                for node in np.unique(at[use]).tolist():
                    key = fit, node
                    out[key] = out[key] + got[:, node] if key in out else got[:, node]
            yield from out.items()

        if self.apart:
            return self.now.mapPartitions(sums).reduceByKey(np.add, self.parts).mapValues(lambda x: _decided(x, cfg)).collect()
        return self.now.mapPartitions(lambda blocks: ((key, _decided(x, cfg)) for key, x in sums(blocks))).collect()

    def medians(self, trees: dict[int, Tree]) -> list[tuple[tuple[int, int], float]]:
        """((fit, leaf), its median residual)."""
        late = self._late(trees)

        def residuals(blocks) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            for fit, y, f, bins in blocks:
                if fit in trees:
                    leaf, r = trees[fit].place(bins), y - (f + late[fit].raw(bins))
                    for k in np.unique(leaf).tolist():
                        yield (fit, k), r[leaf == k]

        parts = self.now.mapPartitions(residuals)
        if self.apart:
            return parts.groupByKey(self.parts).mapValues(lambda x: _median(np.concatenate(list(x)))).collect()
        return parts.mapValues(_median).collect()


@dataclass(frozen=True)
class Fit:
    features: list[str]
    loss: str = "log"


def _start(rows: DataFrame, fits: dict[int, Fit], names: list[str], cfg: Boosting) -> tuple[dict[int, Model], dict[int, int]]:
    """Models without trees, and the rows each has."""
    at, xs = [k / cfg.bins for k in range(1, cfg.bins)], [f"x{k}" for k in range(len(names))]
    facts = {r["fit"]: r for r in rows.groupBy("fit").agg(F.count("*").alias("_n"), F.avg("y").alias("_mean"), F.median("y").alias("_median"), *[F.percentile_approx(x, at, 10_000).alias(x) for x in xs]).collect()}  # a row a fit
    values = rows.drop("y").unpivot(["fit"], xs, "x", "value").where("value is not null").distinct()
    few = values.groupBy("fit", "x").agg(F.count("*").alias("n")).where(F.col("n") <= cfg.bins)
    own = {(r["fit"], r["x"]): r["values"] for r in values.join(few, ["fit", "x"]).groupBy("fit", "x").agg(F.collect_list("value").alias("values")).collect()}  # ``bins`` values each
    models = {}
    for k, fit in fits.items():
        if k not in facts:
            models[k] = Model(list(fit.features), [np.zeros(0)] * len(fit.features), 0.0, fit.loss, [])
            continue
        p = facts[k]["_mean"] if fit.loss == "log" else facts[k]["_median"]
        base = float(np.log(p / (1 - p))) if fit.loss == "log" and 0 < p < 1 else (np.sign(p - 0.5) * 20.0 if fit.loss == "log" else p)
        columns = [xs[names.index(c)] for c in fit.features]
        models[k] = Model(list(fit.features), [np.unique(np.array(own.get((k, x), facts[k][x]) or [], float)) for x in columns], float(base), fit.loss, [])
    return models, {k: r["_n"] for k, r in facts.items()}


def fit_all(train: DataFrame, fits: dict[int, Fit], cfg: Boosting = Boosting()) -> dict[int, Model]:
    """Boosted trees of each fit on its rows with a label; NULL and NaN features are missing.

    ``train``: _fit (int), _y, and the features; a row that several fits learn from is there once for each. ``cfg`` holds
    but for the loss, which each fit has. A feature's edges are its values if there are no more than ``bins``, else quantiles of them.
    Medians of leaves are exact: hand over a bounded sample. Without rows, or with nothing to split on, the base alone is left.
    """
    names = list(dict.fromkeys(c for fit in fits.values() for c in fit.features))
    rows = durable(train.where(F.col("_y").isNotNull()).select(F.col("_fit").cast("int").alias("fit"), F.col("_y").cast("double").alias("y"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{k}") for k, c in enumerate(names)]))
    models, counts = _start(rows, fits, names, cfg)
    if not counts:
        return models
    data, open_ = _Rows(rows, {k: models[k] for k in counts}, counts, names, cfg), sorted(counts)
    for done in range(1, cfg.rounds + 1):
        trees, totals = {k: Tree.empty(cfg.depth) for k in open_}, {k: {} for k in open_}
        for level in range(cfg.depth):
            first = (1 << level) - 1
            growing = {k: trees[k] for k in open_ if not level or max(totals[k], default=0) >= first}
            if not growing:
                break
            for (k, at), (split, total, left) in data.splits(growing, level):
                node, tree = first + at, trees[k]
                if not level:
                    totals[k][0] = total
                if node in totals[k] and split:
                    tree.gain[node], tree.feature[node], tree.split[node], tree.missing_left[node] = split
                    totals[k][2 * node + 1], totals[k][2 * node + 2] = left, totals[k][node] - left
        open_ = [k for k in open_ if trees[k].feature[0] >= 0]  # the others have nothing left to split on
        if not open_:
            break
        for k in open_:
            for node, (g, h) in totals[k].items():
                trees[k].value[node] = -cfg.rate * (g / UNIT) / (h / UNIT + cfg.l2)
        absolute = {k: trees[k] for k in open_ if models[k].loss == "absolute"}
        if absolute:
            for k in absolute:
                trees[k].value[:] = 0.0
            for (k, leaf), r in data.medians(absolute):
                trees[k].value[leaf] = cfg.rate * r
        for k in open_:
            models[k].trees.append(trees[k])
        if done % cfg.stored == 0 and done < cfg.rounds:
            data.store()
    data.drop()
    return models


def fit_each(parts: list[tuple[DataFrame, Fit]], cfg: Boosting = Boosting(), y: str = "label") -> list[Model]:
    """``fit_all`` of tables of one fit each, with the label ``y``."""
    names = list(dict.fromkeys(c for _, fit in parts for c in fit.features))
    missing = F.lit(None).cast("double")
    rows = [df.select(F.lit(k).alias("_fit"), F.col(y).cast("double").alias("_y"), *[(F.col(c).cast("double") if c in fit.features else missing).alias(c) for c in names]) for k, (df, fit) in enumerate(parts)]
    models = fit_all(reduce(lambda a, b: a.unionByName(b), rows), {k: fit for k, (_, fit) in enumerate(parts)}, cfg)
    return [models[k] for k in range(len(parts))]


def fit(train: DataFrame, features: list[str], y: str = "label", cfg: Boosting = Boosting()) -> Model:
    """One model of ``fit_all``."""
    return fit_each([(train, Fit(list(features), cfg.loss))], cfg, y)[0]
