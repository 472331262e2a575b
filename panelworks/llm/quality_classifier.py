"""Quality classifier: random Fourier features over text statistics, ridge regression, isotonic calibration.

The statistics of every text are computed once and written to the checkpoint folder. Training rows
are mapped to random Fourier features of a Gaussian kernel; each partition sums their normal
equations per fold, Spark sums the partitions' rows, and the driver solves systems of a fixed size.
Each fold's scores come from the other folds, so the isotonic calibration sees honest scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import blob, one_label, remainder, table
from panelworks.sources.durable import durable

N_STATS = 34
_MARKS = [ord(c) for c in ".,!?;:|\"'-#*<>{}()=/_@%$&\\"]


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 6.0  # of the Gaussian kernel, in standard deviations of the statistics
    ridge: float = 1.0
    folds: int = 5
    bins: int = 2048  # of scores, for the calibration
    seed: int = 3


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``N_STATS`` numbers for each text of a chunk; an empty text has a row of zeros."""
    n = len(at) - 1
    starts, ends, bounds = K.word_spans(data, at)
    counts = K.byte_histograms(data, at)
    words, sizes = K.word_hashes(K.LOWER[data], starts), ends - starts
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    out = np.zeros((n, N_STATS))
    size = np.maximum(counts.sum(1), 1)
    letters = counts[:, 65:91].sum(1) + counts[:, 97:123].sum(1) + counts[:, 192:].sum(1)
    out[:, 0] = np.log1p(counts.sum(1))
    out[:, 1] = counts[:, 65:91].sum(1) / np.maximum(letters, 1)
    out[:, 2] = counts[:, 48:58].sum(1) / size
    out[:, 3] = counts[:, 192:].sum(1) / size
    out[:, 4] = counts[:, 10] / size * 100
    out[:, 5] = counts[:, K.WHITESPACE].sum(1) / size
    share = counts / size[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 6] = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    for k, c in enumerate((".", ",", "!", "?", "|", "-")):
        out[:, 7 + k] = np.log1p(100 * counts[:, ord(c)] / size)
    out[:, 13] = np.log1p(100 * counts[:, [c for c in _MARKS if chr(c) not in ".,!?|-"]].sum(1) / size)
    for i in range(n):
        own, length = words[bounds[i] : bounds[i + 1]], sizes[bounds[i] : bounds[i + 1]]
        m = len(own)
        if not m:
            out[i] = 0
            continue
        distinct, times = np.unique(own, return_counts=True)
        heads = first[bounds[i] : bounds[i + 1]]
        out[i, 14] = np.log1p(m)
        out[i, 15] = length.mean()
        out[i, 16] = length.std()
        out[i, 17] = len(distinct) / m
        out[i, 18] = times.max() / m
        out[i, 19] = (times == 1).sum() / m
        out[i, 20] = (own[1:] == own[:-1]).sum() / m
        out[i, 21] = (length <= 3).sum() / m
        out[i, 22] = (length >= 12).sum() / m
        out[i, 23] = ((heads >= 65) & (heads < 91)).sum() / m
        for k, width in enumerate((2, 3, 5)):
            windows = K.window_hashes(own, width)
            out[i, 24 + k] = 1 - len(np.unique(windows)) / len(windows) if len(windows) else 0
        out[i, 27] = (length == 1).sum() / m
        out[i, 28] = np.log1p(length.max())
        out[i, 29] = np.sqrt((times / m) @ (times / m))
        lines = counts[i, 10] + 1
        out[i, 30] = np.log1p(m / lines)
        out[i, 31] = np.log1p(m / (counts[i, 46] + counts[i, 33] + counts[i, 63] + 1))
        if lines > 1:
            rows = data[at[i] : at[i + 1]].tobytes().split(b"\n")
            out[i, 32] = 1 - len(set(rows)) / len(rows)
        out[i, 33] = len(distinct) / np.sqrt(m)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in K.chunks(batch.column("text")):
            rows = statistics(data, at).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "stats": pa.array([blob(r) for r in rows], pa.binary())})


def text_statistics(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_describe, "doc_id long, stats binary")


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None  # None: no usable labels, every score is ``base``
    knots: np.ndarray
    levels: np.ndarray
    base: float
    settings: Settings

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines of random projections of the standardised statistics, and a constant."""
        rng = np.random.default_rng(self.settings.seed)
        x = np.clip((stats - self.centre) / self.spread, -8, 8)
        way = rng.normal(size=(N_STATS, self.settings.features)) / self.settings.width
        turn = rng.uniform(0, 2 * np.pi, self.settings.features)
        return np.hstack([np.sqrt(2 / self.settings.features) * np.cos(x @ way + turn), np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(stats):
            return np.full(len(stats), self.base)
        return np.clip(np.interp(self.features(stats) @ self.weights, self.knots, self.levels), 0, 1)


def _matrix(stats: pa.Array) -> np.ndarray:
    return np.frombuffer(K.utf8(stats)[0], np.float32).reshape(-1, N_STATS).astype(np.float64)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing levels (weighted least squares)."""
    level, weight, width = [], [], []
    for v, w in zip(values, weights, strict=True):
        level.append(v), weight.append(w), width.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / total]
            weight[-2:], width[-2:] = [total], [width[-2] + width[-1]]
    return np.repeat(level, width)


def fit(training: DataFrame, settings: Settings = Settings()) -> Model:
    """``training`` has doc_id, stats, y. What reaches the driver has a size that settings fix."""
    folded = training.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(settings.folds)).cast("int")).select("fold", "stats", "y")

    def moments(batches):
        total = np.zeros((3, N_STATS))
        labels = np.zeros(2)
        for b in batches:
            x = _matrix(b.column("stats"))
            total += np.stack([np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)])
            labels += np.bincount(np.asarray(b.column("y")), minlength=2)[:2]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(N_STATS + 1), pa.int32()), "a": [*total[0], labels[0]], "b": [*total[1], labels[1]], "c": [*total[2], 0.0]})

    sums = np.zeros((N_STATS + 1, 3))
    for r in folded.mapInArrow(moments, "at int, a double, b double, c double").groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).collect():
        sums[r["at"]] = r["a"], r["b"], r["c"]
    zeros, ones = sums[N_STATS, :2]
    centre = sums[:N_STATS, 1] / np.maximum(sums[:N_STATS, 0], 1)
    spread = np.sqrt(np.maximum(sums[:N_STATS, 2] / np.maximum(sums[:N_STATS, 0], 1) - centre**2, 0))
    base = (ones + 0.5) / (zeros + ones + 1)
    model = Model(centre, np.where(spread > 1e-9, spread, 1.0), None, np.array([0.0, 1.0]), np.array([base, base]), float(base), settings)
    if not zeros or not ones:
        return model

    size = settings.features + 1

    def equations(batches):
        sums = {}
        for b in batches:
            z, y, folds = model.features(_matrix(b.column("stats"))), np.asarray(b.column("y"), np.float64), np.asarray(b.column("fold"))
            for f in np.unique(folds):
                own = z[folds == f]
                sums[f] = sums.get(f, 0) + np.hstack([own.T @ own, (own.T @ y[folds == f])[:, None]])
        for f, m in sums.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(size, f, np.int32)), "at": pa.array(range(size), pa.int32()), "row": pa.array([blob(r) for r in m], pa.binary())})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": rows["fold"].iloc[:1], "at": rows["at"].iloc[:1], "row": [blob(sum(np.frombuffer(x) for x in rows["row"]))]})

    schema = "fold int, at int, row binary"
    parts = np.zeros((settings.folds, size, size + 1))
    for r in folded.mapInArrow(equations, schema).groupBy("fold", "at").applyInPandas(added, schema).collect():
        parts[r["fold"], r["at"]] = np.frombuffer(r["row"])
    whole = parts.sum(0)
    solve = lambda m: np.linalg.solve(m[:, :size] + settings.ridge * 1e-3 * np.eye(size), m[:, size])
    weights = np.stack([solve(whole - own) for own in parts])

    def scored(batches):
        for b in batches:
            s = (model.features(_matrix(b.column("stats"))) * weights[np.asarray(b.column("fold"))]).sum(1)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.clip((s + 1) / 3 * settings.bins, 0, settings.bins - 1).astype(np.int32)), "y": b.column("y").cast(pa.int32())})

    bins = sorted((r["bin"], r["n"], r["ones"]) for r in folded.mapInArrow(scored, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect())
    at, n, got = (np.array(x, np.float64) for x in zip(*bins, strict=True))
    model.weights = solve(whole)
    model.knots = (at + 0.5) / settings.bins * 3 - 1
    model.levels = (pool_adjacent(got / n, n) * len(n) + base) / (len(n) + 1) if len(n) > 1 else np.array([base])
    return model


def _apply(model: Model):
    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column("stats")))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return run


def classify_quality(documents: DataFrame, labels: DataFrame, in_training, settings: Settings = Settings()) -> DataFrame:
    """Scores every document. ``in_training``: a condition on doc_id that rows must meet to be learnt from.

    Null and empty texts have statistics of zero and get a score like any other. Without labels of
    both kinds all scores are the share of ones (0.5 without any). Repeated rows are scored one by one.
    """
    stats = durable(text_statistics(documents))
    training = stats.join(one_label(labels, "quality").where(in_training), "doc_id").select("doc_id", "stats", "y")
    return stats.mapInArrow(_apply(fit(training, settings)), "doc_id long, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    scores = classify_quality(documents, labels, remainder("doc_id", 3) != 1)
    return scores.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
