"""Language identification by prediction by partial matching (PPM, escape method C).

A context tree of bytes per language, of orders 0 to ``order``, holds counts from a bounded sample.
With the counts frozen, the code length of a byte after its context is a constant: the path of
escapes down to the longest context that has seen the byte. The tree is therefore kept as tables
from (context, byte) to one cost per language, and a text's code length under each language is a
sum of look-ups over all its bytes. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import remainder, table


@dataclass(frozen=True)
class Settings:
    order: int = 3  # bytes of context, 1 to 7
    sample: int = 1500  # documents a language is learnt from (expected number, by a hash of the id)
    temper: float = 0.02  # bits count so much in the score, as a text's bytes are far from independent


class Index:
    """Positions of 64-bit keys in a sorted list: hash tables in a chain, each for what did not fit before."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left, multiplier = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            bits = max(int(len(left) * 4 - 1).bit_length(), 4)
            slots = np.full(1 << bits, -1, np.int32)
            at = (keys[left] * np.uint64(multiplier)) >> np.uint64(64 - bits)
            slots[at] = left
            self.levels.append((np.uint64(multiplier), np.uint64(64 - bits), slots))
            left = left[slots[at] != left]
            multiplier = (multiplier * 0xD1342543DE82EF95 + 2) | 1
            multiplier &= (1 << 64) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key is absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        rest: np.ndarray | None = None
        for multiplier, shift, slots in self.levels:
            ask = keys if rest is None else keys[rest]
            got = slots[(ask * multiplier) >> shift]
            hit = (got >= 0) & (self.keys[np.maximum(got, 0)] == ask)
            if rest is None:
                out[hit], rest = got[hit], np.flatnonzero(~hit)
            else:
                out[rest[hit]], rest = got[hit], rest[~hit]
            if not len(rest):
                break
        return out


def grams(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``size`` bytes that end at each byte, and whether they lie within one text."""
    n = len(data)
    keys = np.zeros(n, np.uint64)
    for k in range(size):
        keys[k:] |= data[: n - k].astype(np.uint64) << np.uint64(8 * k)
    whole = np.ones(n, bool)
    for k in range(size - 1):
        edge = at[:-1] + k
        whole[edge[(edge < at[1:])]] = False
    return keys, whole


class Trees:
    """Frozen statistics of all languages: for each order, keys and one cost in bits per language."""

    def __init__(self, langs: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]], order: int):
        """counts[size - 1][language]: sorted keys of ``size`` bytes and their counts."""
        self.langs, self.order = langs, order
        width = len(langs)
        self.costs: list[np.ndarray] = []  # by order 0..order: rows for (context, byte)
        self.escapes: list[np.ndarray] = []  # by order 1..order: rows for contexts
        self.seen: list[Index] = []
        self.contexts: list[Index] = []
        for size in range(1, order + 2):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in counts[size - 1])]))
            above = np.unique(keys >> np.uint64(8))
            escape, fitted = np.zeros((len(above), width), np.float32), np.zeros((len(keys), width), np.float32)
            told = np.zeros((len(keys), width), bool)
            for j, (own, n) in enumerate(counts[size - 1]):
                place = np.searchsorted(above, own >> np.uint64(8))
                total = np.bincount(place, n, len(above))
                kinds = np.bincount(place, minlength=len(above))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, j] = np.where(kinds > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0)
                slot = np.searchsorted(keys, own)
                fitted[slot, j] = np.log2((total + kinds)[place] / n)
                told[slot, j] = True
            mask = np.uint64((1 << (8 * (size - 1))) - 1)
            lower = self._cost(keys & mask, size - 1) if size > 1 else np.full((len(keys), width), 8.0, np.float32)
            fall = lower + (escape[np.searchsorted(above, keys >> np.uint64(8))] if len(keys) else 0)
            self.costs.append(np.where(told, fitted, fall).astype(np.float32))
            self.escapes.append(escape)
            self.seen.append(Index(keys))
            self.contexts.append(Index(above))

    def _cost(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Bits per language of the last of ``size`` bytes after the others."""
        at = self.seen[size - 1].find(keys)
        out = self.costs[size - 1][np.maximum(at, 0)] if len(self.costs[size - 1]) else np.zeros((len(keys), len(self.langs)), np.float32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = keys[missing]
            lower = self._cost(rest & np.uint64((1 << (8 * (size - 1))) - 1), size - 1) if size > 1 else np.full((len(rest), len(self.langs)), 8.0, np.float32)
            if len(self.escapes[size - 1]):
                context = self.contexts[size - 1].find(rest >> np.uint64(8))
                lower = lower + np.where(context[:, None] >= 0, self.escapes[size - 1][np.maximum(context, 0)], 0)
            out[missing] = lower
        return out

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        n = len(data)
        if not n:
            return np.zeros((len(at) - 1, len(self.langs)))
        keys, whole = grams(data, at, self.order + 1)
        costs = self._cost(keys, self.order + 1)
        for size in range(self.order, 0, -1):  # the first bytes of a text have shorter contexts
            edge = at[:-1] + size - 1
            edge = edge[edge < at[1:]]
            costs[edge] = self._cost(keys[edge] & np.uint64((1 << (8 * size)) - 1), size)
        filled = np.flatnonzero(np.diff(at))
        out = np.zeros((len(at) - 1, len(self.langs)))
        out[filled] = np.add.reduceat(costs, at[:-1][filled], axis=0, dtype=np.float64)
        return out


def _count(order: int):
    """Task: n-gram counts per language, orders 0 to ``order``, as rows (lang, size, key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, at in K.chunks(batch.column("text")):
                own = np.array(langs[lo:hi], object)
                names = sorted(set(own))
                of = np.repeat(np.searchsorted(names, own.astype(str)), np.diff(at))
                for size in range(1, order + 2):
                    keys, whole = grams(data, at, size)
                    for j, lang in enumerate(names):
                        found, n = np.unique(keys[whole & (of == j)], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "size": pa.array(np.full(len(found), size, np.int32)), "item": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def learn(documents: DataFrame, settings: Settings = Settings()) -> Trees | None:
    """Trees from a sample of the documents with a language: about ``settings.sample`` whole texts of each.

    Languages are few and the sample is bounded, so the tables that come to the driver are too.
    """
    usable = documents.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(settings.sample / sizes[k]))])[F.col("lang")]
    counted = usable.where(chance < limit).select("text", "lang").mapInArrow(_count(settings.order), "lang string, size int, item long, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    lang, size, item, n = (np.asarray(rows.column(k).to_numpy(zero_copy_only=False)) for k in ("lang", "size", "item", "n"))
    counts = []
    for s in range(1, settings.order + 2):
        by_lang = []
        for name in langs:
            mine = (lang == name) & (size == s)
            keys = item[mine].view(np.uint64) if mine.any() else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            by_lang.append((keys[order], n[mine][order].astype(np.float64)))
        counts.append(by_lang)
    return Trees(langs, counts, settings.order)


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (Unicode categories L*)."""
    ascii_letter = (K.LOWER[data] >= 97) & (K.LOWER[data] <= 122)
    upto = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = upto[at[1:]] > upto[at[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _predict(trees, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column("text"), K.CHUNK // 4):
                n = hi - lo
                names, score = np.full(n, "und", object), np.zeros(n)
                if model is not None:
                    bits = model.code_lengths(data, at)
                    ahead = np.exp2(-settings.temper * (bits - bits.min(1, keepdims=True)))
                    known = has_letter(data, at)
                    names[known] = np.array(model.langs, object)[bits.argmin(1)][known]
                    score[known] = (1 / ahead.sum(1))[known]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, n), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score)})

    return run


def identify_language(documents: DataFrame, learn_from: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Language and score (the normalised likelihood of the winner) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no language
    could be learnt. Equal code lengths go to the smaller name. Repeated rows are judged one by one.
    """
    trees = documents.sparkSession.sparkContext.broadcast(learn(learn_from, settings))
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(trees, settings), "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify_language(documents, documents.where(remainder("doc_id", 4) != 2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
