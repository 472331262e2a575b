"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents are sets of word shingles. Documents with equal sets are one class, known by a hash of the
set. Classes are banded; candidates are compared by batches of their signatures
and dropped as soon as the posterior chance of reaching the threshold is below the chosen miss
probability; survivors are confirmed on their full sets (see ``linking``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import blob, table
from panelworks.llm.linking import Similarity, band_keys, linked, packed_signatures, signatures
from panelworks.sources.durable import durable


@dataclass(frozen=True)
class Near:
    width: int = 5  # words in a shingle
    similarity: Similarity = field(default_factory=Similarity)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk, A-Z lower-cased; a text of fewer words is one shingle."""
    data = K.LOWER[data]
    starts, _, bounds = K.word_spans(data, at)
    words = K.word_hashes(data, starts)
    out = []
    for i in range(len(at) - 1):
        own = words[bounds[i] : bounds[i + 1]]
        if 0 < len(own) < width:
            out.append(K.mix(K.window_hashes(own, len(own)) + np.uint64(len(own))))
        else:
            out.append(np.unique(K.window_hashes(own, width)))
    return out


def _describe(near: Near):
    """Task: size, a 128-bit key of the set, and bucket keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column("text")):
                sets = shingle_sets(data, at, near.width)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                flat = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, np.uint64)
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
                keys = np.zeros((2, hi - lo), np.uint64)
                if len(some):
                    keys[0, some] = np.add.reduceat(K.mix(flat), starts)
                    keys[1, some] = np.add.reduceat(K.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                bands = np.zeros((hi - lo, near.similarity.bands), np.int64)
                bands[some] = band_keys(signatures(flat, starts, near.similarity.rows * near.similarity.bands), near.similarity)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo), "twin": batch.column("twin").slice(lo, hi - lo), "n_shingles": pa.array(sizes), "key_a": pa.array(keys[0].view(np.int64)), "key_b": pa.array(keys[1].view(np.int64)),
                    "bands": pa.array([blob(b) for b in bands], pa.binary()),
                })

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = np.frombuffer(K.utf8(batch.column("bands"))[0], np.int64)
        ids = np.asarray(batch.column("id"))
        if len(ids):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bands), "id": pa.array(np.repeat(ids, len(bands) // len(ids)))})


def shared_buckets(banded: DataFrame) -> DataFrame:
    """(bucket, id) of the buckets that two ids or more fall into; ``banded``: (id, bands)."""
    rows = banded.mapInArrow(_buckets, "bucket long, id long")
    shared = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("bucket")
    return rows.join(shared, "bucket")


def _profile(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column("text")):
                sets = shingle_sets(data, at, near.width)
                starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
                sigs = signatures(np.concatenate(sets), starts, near.similarity.values)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(lo, hi - lo), "sig": pa.array(packed_signatures(sigs), pa.binary()), "bands": pa.array([blob(b) for b in band_keys(sigs, near.similarity)], pa.binary()), "body": batch.column("text").slice(lo, hi - lo).cast(pa.binary())})

    return run


def _expand(near: Near):
    """Sets of documents given by their texts, which take less room than their sets."""

    def run(bodies: pa.Array) -> list[np.ndarray]:
        return [s for _, _, data, at in K.chunks(bodies) for s in shingle_sets(data, at, near.width)]

    return run


def near_duplicates(documents: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, twin (a hash of the text), n_shingles, component_id, kept of every row.

    component_id is the smallest doc_id reachable over links between similar sets, kept whether it
    is the row's own. Texts that are null or without words have no shingles and are linked with
    nothing. Rows that repeat a doc_id are described one by one and share components as their texts
    do. Rows without a doc_id have no component and are kept. Classes have 64-bit ids, so among N
    different sets about N**2 / 2**65 pairs are taken for equal by mistake.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = durable(rows.withColumn("twin", F.xxhash64("text")).mapInArrow(K.lean(_describe(near)), "doc_id long, twin long, n_shingles long, key_a long, key_b long, bands binary"))
    set_key = ["key_a", "key_b", "n_shingles"]
    classes = described.where("n_shingles > 0 and doc_id is not null").groupBy(*set_key).agg(F.min(F.struct("doc_id", "twin")).alias("rep"), F.first("bands").alias("bands"))
    classes = durable(classes.select(F.xxhash64(*set_key).alias("id"), *set_key, F.col("rep.doc_id").alias("rep"), F.col("rep.twin").alias("rep_twin"), "bands"))

    def profile(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id", "left_semi").select("id", F.col("rep").alias("doc_id"), F.col("rep_twin").alias("twin"))
        texts = rows.withColumn("twin", F.xxhash64("text")).join(wanted, ["doc_id", "twin"]).select("id", "text")
        return texts.mapInArrow(K.lean(_profile(near)), "id long, sig binary, bands binary, body binary").dropDuplicates(["id"])

    labels = linked(shared_buckets(classes.select("id", "bands")), profile, near.similarity, _expand(near))
    labelled = classes.join(labels, "id", "left").select(*set_key, "rep", "label")
    least = labelled.where("label is not null").groupBy("label").agg(F.min("rep").alias("least"))
    named = labelled.join(least, "label", "left").select(*set_key, F.coalesce("least", "rep").alias("component"))
    out = described.drop("bands").join(named, set_key, "left")
    return out.select("doc_id", "twin", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``documents`` whose component they represent, all columns as they were."""
    gone = near_duplicates(documents, near).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_doc"), F.col("twin").alias("_gone_twin"))
    names = documents.columns
    spine = documents.toDF(*[f"c{k}" for k in range(len(names))])
    doc, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}")
    return spine.join(gone, (doc == F.col("_gone_doc")) & (F.xxhash64(text) == F.col("_gone_twin")), "left_anti").toDF(*names)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), Near(width=3, similarity=Similarity(percent=85))).drop("twin")
