"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams within lower-cased words, word edges included, each present or
absent in a text. From a bounded sample of labelled texts come the log ratios of each n-gram's
frequency in toxic and other texts; n-grams with a ratio near zero are left out. A logistic
regression over the rest, scaled by their ratios, gives the weights. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import blob, one_label, remainder, table

# Lower case of the characters below U+0250, where it is one character, by Python's own table.
_SMALL = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _SMALL[_c] = ord(chr(_c).lower())
_SEPARATOR = np.ones(128, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20  # of the hashed feature space
    sample_toxic: int = 4000  # labelled texts to learn from, the first by a hash of the id
    sample_other: int = 8000
    smoothing: float = 0.5
    least_texts: int = 4  # that an n-gram occurs in
    least_ratio: float = 1.0  # absolute log ratio of an n-gram that is kept
    most_features: int = 60_000
    penalty: float = 2.0
    steps: int = 150


def ngrams(data: np.ndarray, at: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (text number, feature) of every n-gram of a chunk, with repeats."""
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upto = np.concatenate([[0], np.cumsum(lead)])[at]
    if upto[-1] != len(points):  # malformed text; count bytes as characters
        points, upto = data.astype(np.uint32), at
    low = np.where(points < 0x250, _SMALL[np.minimum(points, 0x24F)], points)
    edge = _SEPARATOR[np.minimum(low, 127)] & (low < 128)
    n, size = len(at) - 1, len(low) + len(at)
    low[edge] = 32
    # One separator before each text and one at the end, so that no n-gram reaches across.
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(upto) + 1)
    room = np.full(size, 32, np.uint32)
    room[np.arange(len(low)) + owner_shift(upto, len(low))] = low
    owner = np.append(owner, np.int32(max(n - 1, 0)))[:size]
    gap = room == 32
    code = (room.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    rolled = np.zeros(size, np.uint64)
    inner = np.zeros(size, bool)  # an edge inside the n-gram
    shift = np.uint64(64 - settings.bits)
    for order in range(1, max(settings.orders) + 1):
        # rolled[i]: the hash of the order characters from i on
        m = size - order + 1
        if m <= 0:
            break
        rolled[:m] = rolled[:m] * np.uint64(0xD6E8FEB86659FD93) + code[order - 1 :]
        if order > 2:
            inner[:m] |= gap[order - 2 : size - 1]
        if order in settings.orders:
            use = np.flatnonzero(~inner[:m])
            h = rolled[use]
            h ^= h >> np.uint64(31)
            yield owner[use], ((h * np.uint64(0xC4CEB9FE1A85EC53 + 2 * order)) >> shift).astype(np.int32)


def owner_shift(upto: np.ndarray, size: int) -> np.ndarray:
    """How far each character moves when a separator goes before each text."""
    return np.repeat(np.arange(1, len(upto)), np.diff(upto)) if size else np.zeros(0, np.int64)


def _features(settings: Settings, kept: np.ndarray | None):
    """Task: (doc_id, y, distinct features) of labelled texts; of kept features their slots only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column("text"), K.CHUNK // 4):
                found: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
                for owner, feature in ngrams(data, at, settings):
                    if kept is not None:
                        feature = kept[feature]
                        owner, feature = owner[feature >= 0], feature[feature >= 0]
                    for i, part in enumerate(np.split(feature, np.searchsorted(owner, np.arange(1, hi - lo)))):
                        found[i].append(part)
                rows = [blob(np.unique(np.concatenate(x)).astype(np.int32)) if x else b"" for x in found]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "y": batch.column("y").slice(lo, hi - lo), "features": pa.array(rows, pa.binary())})

    return run


def _counts(settings: Settings):
    """Task: texts with each feature, by label, as rows (feature, toxic, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << settings.bits), np.int32)
        for batch in _features(settings, None)(batches):
            for y, features in zip(batch.column("y").to_pylist(), batch.column("features").to_pylist(), strict=True):
                sums[y, np.frombuffer(features, np.int32)] += 1
        some = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_pydict({"feature": pa.array(some.astype(np.int32)), "other": pa.array(sums[0, some].astype(np.int64)), "toxic": pa.array(sums[1, some].astype(np.int64))})

    return run


@dataclass
class Model:
    slots: np.ndarray  # feature -> slot, -1 if left out
    weights: np.ndarray  # by slot, ratio and coefficient multiplied
    bias: float
    settings: Settings

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.full(len(at) - 1, self.bias)
        if len(self.weights) and len(data):
            pairs = []
            for owner, feature in ngrams(data, at, self.settings):
                slot = self.slots[feature]
                use = slot >= 0
                pairs.append(owner[use].astype(np.int64) * len(self.weights) + slot[use])
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            total += np.bincount(pairs // len(self.weights), self.weights[pairs % len(self.weights)], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with an L2 penalty by Nesterov's method; rows hold slots."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    of = np.repeat(np.arange(len(rows)), sizes)
    value = scale[flat]
    most = float((np.bincount(of, value**2, len(rows)) * weight).max(initial=0.0))
    total = weight.sum()
    mean = float((weight * y).sum() / total)
    w, b = np.zeros(len(scale)), float(np.log(mean / (1 - mean)))
    z, zb, momentum = w.copy(), b, 1.0
    # The largest eigenvalue by a few power steps gives the step's length.
    v = np.ones(len(scale))
    top = max(most, 1.0)
    for _ in range(12):
        u = np.bincount(of, value * v[flat], len(rows)) * weight
        v2 = np.bincount(flat, value * u[of], len(scale))
        top = np.linalg.norm(v2) / max(np.linalg.norm(v), 1e-12)
        v = v2 / max(np.linalg.norm(v2), 1e-12)
    step, bstep = 1 / (0.3 * top + settings.penalty + 1e-9), 1 / (0.3 * total)
    for _ in range(settings.steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, value * z[flat], len(rows)) + zb, -40, 40)))
        error = weight * (p - y)
        fresh = z - step * (np.bincount(flat, value * error[of], len(scale)) + settings.penalty * z)
        freshb = zb - bstep * error.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, zb = fresh + (momentum - 1) / after * (fresh - w), freshb + (momentum - 1) / after * (freshb - b)
        w, b, momentum = fresh, freshb, after
    return w, b


def fit(documents: DataFrame, labels: DataFrame, in_training, settings: Settings = Settings()) -> Model:
    """Learns from at most ``sample_toxic`` and ``sample_other`` labelled ids; their weights restore the true shares.

    Null and empty texts are texts without features. Ids should not repeat in ``documents``: all rows of a
    sampled id are learnt from. Without labels of both kinds the model is one constant.
    """
    usable = one_label(labels, "toxic").where(in_training)
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    empty = Model(np.full(1 << settings.bits, -1, np.int32), np.zeros(0), float(np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))), settings)
    if not totals.get(1) or not totals.get(0):
        return empty
    first = lambda y, n: usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(n)
    sample = first(1, settings.sample_toxic).unionByName(first(0, settings.sample_other))
    picked = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")  # 12,000 ids at most
    sums = picked.mapInArrow(K.lean(_counts(settings)), "feature int, other long, toxic long").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    got = sums.where(F.col("other") + F.col("toxic") >= settings.least_texts).toArrow()  # 2 ** bits rows at most
    feature, other, toxic = (got.column(k).to_numpy() for k in ("feature", "other", "toxic"))
    seen = {y: min(totals[y], n) for y, n in ((1, settings.sample_toxic), (0, settings.sample_other))}
    ratio = np.log((toxic + settings.smoothing) / (seen[1] + 2 * settings.smoothing)) - np.log((other + settings.smoothing) / (seen[0] + 2 * settings.smoothing))
    order = np.lexsort((feature, -np.abs(ratio) * np.sqrt(toxic + other)))
    order = order[np.abs(ratio[order]) >= settings.least_ratio][: settings.most_features]
    slots = empty.slots.copy()
    slots[feature[order]] = np.arange(len(order))
    rows = picked.mapInArrow(K.lean(_features(settings, slots)), "doc_id long, y int, features binary").toArrow()  # a row for each sampled text
    order_of = np.lexsort((rows.column("y").to_numpy(), rows.column("doc_id").to_numpy()))
    y = rows.column("y").to_numpy()[order_of].astype(float)
    if not len(order) or not len(y) or y.min() == y.max():
        return empty
    lists = [np.frombuffer(x, np.int32) for x in rows.column("features").to_pylist()]
    weight = np.where(y == 1, totals[1] / seen[1], totals[0] / seen[0])
    coefficient, bias = logistic([lists[i] for i in order_of], y, weight, ratio[order], settings)
    return Model(slots, coefficient * ratio[order], bias, settings)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column("text"), K.CHUNK // 4):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "score": pa.array(model.score(data, at))})

    return run


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; null and empty texts get the score of no features at all.

    Repeated rows are scored one by one; without labels of both kinds all scores are one constant.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.lean(_score(shared)), "doc_id long, score double")


def keep_clean(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, all columns and rows as they were.

    Null and empty texts get the score of no features at all, which a fitted model puts below the
    threshold as long as toxic texts are the fewer; repeated rows stay or go together.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, data, at in K.chunks(batch.column(place), K.CHUNK // 4):
                keep[lo:hi] = shared.value.score(data, at) < threshold
            yield batch.filter(pa.array(keep))

    place = documents.columns.index("text")
    return documents.mapInArrow(K.lean(run), documents.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels", "doc_id", "toxic"), remainder("doc_id", 4) != 2)
    scores = score_toxicity(documents, model)
    return scores.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
