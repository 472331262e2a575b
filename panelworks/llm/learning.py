"""What the trained operators share: label gates, bounded samples and sums over partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus`` (null ids count as empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """One row per document with a label of 0 or 1; of several labels the largest counts."""
    return labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
