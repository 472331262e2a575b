"""Quality rules by distribution divergence.

Each text's histograms of character classes and of common words are compared with references, one
per language, by the Jensen-Shannon distance (base 2, so between 0 and 1). The references are
counted over all documents that pass the base rules and have a language. A text is held against
the language it is nearest to, so wrong or missing ``lang`` values do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import table

# The character classes, by byte of the UTF-8 text.
CLASS_NAMES = ["lower", "upper", "digit", "space", "stop", "mark", "symbol", "control", "wide"]
CLASS_OF = np.full(256, 7, np.uint8)
CLASS_OF[[32, 9, 10, 13]] = 3
CLASS_OF[33:127] = 5
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58] = 0, 1, 2
CLASS_OF[[ord(c) for c in ".,;:?'\"-()"]] = 4
CLASS_OF[[ord(c) for c in "#*$%&|<>"]] = 6
CLASS_OF[128:] = 8
SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"])


@dataclass(frozen=True)
class Rules:
    common_words: int = 100
    min_chars: int = 80  # below, character classes are not compared
    min_words: int = 40  # below, common words are not compared
    max_class_distance: float = 0.24
    max_word_distance: float = 0.445
    min_base_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


def text_facts(data: np.ndarray, at: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Base counts, class histograms and word hashes of a chunk of texts."""
    n = len(at) - 1
    starts, ends, bounds = K.word_spans(data, at)
    histograms = K.byte_histograms(data, at)
    spaces = histograms[:, K.WHITESPACE].sum(1)
    points = histograms.sum(1) - histograms[:, 128:192].sum(1)
    words = K.word_hashes(data, starts)
    repeats, dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        own = words[bounds[i] : bounds[i + 1]]
        if len(own) > rules.window:
            hits = K.repeated(K.window_hashes(own, rules.window))
            if hits.any():
                repeats[i] = K.covered(hits, rules.window, len(own))
        if histograms[i, 10]:
            lines = [x for x in data[at[i] : at[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup_lines[i] = len(lines) - len(set(lines))
    classes = np.stack([histograms[:, CLASS_OF == k].sum(1) for k in range(len(CLASS_NAMES))], 1)
    classes[:, 8] -= histograms[:, 128:192].sum(1)
    n_words = np.diff(bounds)
    lowered = K.word_hashes(K.LOWER[data], starts)
    return {
        "n_words": n_words, "word_chars": points - spaces, "n_symbols": histograms[:, SYMBOLS].sum(1), "n_dup_lines": dup_lines, "n_repeat_words": repeats,
        "base_failed": (n_words < rules.min_base_words) | (100 * repeats > rules.max_repeat_percent * n_words),
        "points": points, "classes": classes, "words": lowered, "bounds": bounds,
    }


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one reference; rows without counts are at 0."""
    total = counts.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(np.broadcast_to(q, m.shape) / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def _counts(rules: Rules):
    """Task: by language, counts of character classes (kind 0), of each word (kind 1) and of all words (kind 2)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64))]

    def rows(lang: str, kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "kind": pa.array(np.full(len(keys), kind, np.int32)), "item": pa.array(keys.astype(np.uint64).view(np.int64)), "n": pa.array(counts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, list] = {}
        totals: dict[str, int] = {}
        classes: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, at in K.chunks(batch.column("text")):
                facts = text_facts(data, at, rules)
                usable = {}
                for i in range(hi - lo):
                    if langs[lo + i] is not None and not facts["base_failed"][i]:
                        usable.setdefault(langs[lo + i], []).append(i)
                for lang, own in usable.items():
                    classes[lang] = classes.get(lang, 0) + facts["classes"][own].sum(0)
                    got = np.concatenate([facts["words"][facts["bounds"][i] : facts["bounds"][i + 1]] for i in own])
                    keys, counts = np.unique(got, return_counts=True)
                    totals[lang] = totals.get(lang, 0) + len(got)
                    parts = words.setdefault(lang, [])
                    parts.append((keys, counts))
                    if sum(len(k) for k, _ in parts) > 600_000:
                        parts[:] = merged(parts)
                        if len(parts[0][0]) > 500_000:  # a task holds so many at most
                            yield rows(lang, 1, *parts.pop())
        for lang, parts in words.items():
            if parts:
                yield rows(lang, 1, *merged(parts)[0])
        for lang, counts in classes.items():
            yield rows(lang, 0, np.arange(len(counts)), counts.astype(np.int64))
            yield rows(lang, 2, np.zeros(1), np.array([totals[lang]], np.int64))

    return run


def language_references(documents: DataFrame, rules: Rules = Rules()) -> list[dict]:
    """Per language: class counts, the hashes of its commonest words, and their counts with the rest's count last.

    Of words that tie over the last place none is common, so no order among ties decides. A bounded
    number of rows a language comes to the driver, as languages are few by nature.
    """
    counts = documents.select("text", "lang").mapInArrow(_counts(rules), "lang string, kind int, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    kept = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(rules.common_words + 1, len(CLASS_NAMES)))
    found: dict[str, dict] = {}
    for r in kept.collect():
        found.setdefault(r["lang"], {0: {}, 1: {}, 2: {0: 0}})[r["kind"]][r["item"]] = r["n"]
    out = []
    for lang in sorted(found):
        classes, words, total = found[lang][0], found[lang][1], found[lang][2][0]
        if len(words) > rules.common_words:
            border = sorted(words.values(), reverse=True)[rules.common_words]
            words = {k: n for k, n in words.items() if n > border}
        keys = np.sort(np.array(list(words), np.int64).view(np.uint64))
        own = np.array([words[int(k)] for k in keys.view(np.int64)], np.float64)
        out.append({"lang": lang, "classes": np.array([classes.get(k, 0) for k in range(len(CLASS_NAMES))], np.float64), "keys": keys, "words": np.append(own, max(total - own.sum(), 0))})
    return out


RULE_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def _judge(references: list[dict], rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, at in K.chunks(batch.column("text")):
                facts = text_facts(data, at, rules)
                n, owner = hi - lo, np.repeat(np.arange(hi - lo), np.diff(facts["bounds"]))
                near = np.full((n, 2), np.inf)
                for r in references:
                    size = len(r["keys"])
                    slot = np.minimum(np.searchsorted(r["keys"], facts["words"]), max(size - 1, 0))
                    slot = np.where(r["keys"][slot] == facts["words"], slot, size) if size else np.zeros(len(facts["words"]), int)
                    words = np.bincount(owner * (size + 1) + slot, minlength=n * (size + 1)).reshape(n, size + 1)
                    apart = np.stack([js_distance(facts["classes"], r["classes"]), js_distance(words, r["words"])], 1)
                    near = np.where((apart.sum(1) < near.sum(1))[:, None], apart, near)
                near[~np.isfinite(near)] = 0
                bad = (facts["points"] >= rules.min_chars) & (near[:, 0] > rules.max_class_distance) | (facts["n_words"] >= rules.min_words) & (near[:, 1] > rules.max_word_distance)
                columns = {k: facts[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                columns |= {"base_failed": facts["base_failed"], "class_distance": near[:, 0], "word_distance": near[:, 1], "kept": ~facts["base_failed"] & ~bad}
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, n)} | {k: pa.array(v) for k, v in columns.items()})

    return run


def quality_rules(documents: DataFrame, rules: Rules = Rules(), references: list[dict] | None = None) -> DataFrame:
    """Base counts and verdict of every document.

    Null and empty texts have zero counts and fail the base rules. Repeated rows are judged one by
    one. Without any reference (no language at all, empty table) only the base rules decide. Texts
    shorter than the guards are kept unless the base rules reject them. Other columns are ignored.
    """
    if references is None:
        references = language_references(documents, rules)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_judge(references, rules), RULE_SCHEMA)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
