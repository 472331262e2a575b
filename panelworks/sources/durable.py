"""Cutting lineage in storage that every executor can read."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[str, str | None] = {}  # of each session with writers: the setting as it was; and how many there are
_count: dict[str, int] = {}


@contextmanager
def _releasing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are released after each query; jobs may be written from several threads, the last one restores the setting."""
    key = spark.sparkContext.applicationId
    with _lock:
        if not _count.get(key):
            _writers[key] = spark.conf.get(RELEASE, None)
            spark.conf.set(RELEASE, "true")
        _count[key] = _count.get(key, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _count[key] -= 1
            if not _count[key]:
                before = _writers.pop(key)
                spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all runs in one local process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="panelworks-"))
    return sc.getCheckpointDir()


FEW = 24  # files of a small table


def durable(df: DataFrame, rows: int | None = None, per_file: int = 20_000) -> DataFrame:
    """Writes ``df`` once as a Parquet table in the checkpoint folder and reads it from there.

    A lost executor costs no recomputation, the table is packed by column, and the shuffle files that led
    to it are released as soon as it is written. Column names must differ.

    ``rows``: about as many as it has at most, if known. A small table is then written by few tasks into few
    files, however many partitions it comes in; a large one as it is.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(FEW, -(-rows // per_file)))
    with _releasing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
