"""A training-corpus pipeline over the documents table: each stage works on all that the last one kept.

toxicity (toxic documents go), line dedup (repeated lines go), near dedup (one document of each
group stays), mixing (documents repeated or left out to meet the sources' weights), encoding.

Whole texts make wide rows: each stage asks the session for smaller Arrow batches (``ROWS``) than Spark's
10,000 rows, which would be tens of MB for each task, outside the executor's heap and in its Python worker.
The setting stays, as what a stage returns runs later; a smaller one is left as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from panelworks.llm import line_dedup, mixing, near_dedup, piece_encoding, toxicity
from panelworks.llm.learning import remainder
from panelworks.sources.durable import checkpoint_dir


ROWS = 500  # of an Arrow batch at most, about 2 MB of texts
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= ROWS:  # zero or less: no limit
            spark.conf.set(key, ROWS)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Null and empty texts stay; without labels of both kinds all documents share one score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, model)


@small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, no document does; rows without a doc_id or a text stay as they are."""
    return line_dedup.dedup_lines(docs)


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; null and empty texts, being like nothing, all stay, and so do rows equal in doc_id and text."""
    return near_dedup.keep_one(docs)


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet the sources' weights; null texts have size 0, rows without a doc_id are drawn like others."""
    return mixing.mix(docs, places=False)


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A digest of each document's tokens; null texts count as empty, repeated rows are encoded one by one."""
    return piece_encoding.encode_documents(docs, piece_encoding.default_model())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("piece_encoding", encode)]

#: The trained classifier, the hash-seeded draws and the encoder have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written as Parquet to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
