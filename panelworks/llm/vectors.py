"""Vectors of whole numbers as bytes, between Spark's arrays and numpy's matrices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.learning import blob


def packed(df: DataFrame, column: str, kind: str) -> DataFrame:
    """``df`` with its array ``column`` of whole doubles as the bytes of numpy's ``kind``."""
    others = [f for f in df.schema.fields if f.name != column]
    names = [f.name for f in others]
    low, high = (np.iinfo(kind).min, np.iinfo(kind).max) if np.dtype(kind).kind == "i" else (-np.inf, np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(column)
            data = np.clip(v.flatten().to_numpy(zero_copy_only=False), low, high).astype(kind)
            at = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            rows = pa.array([blob(data[at[i] : at[i + 1]]) for i in range(len(v))], pa.binary())
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {column: rows})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{column}` binary"])
    return df.select(*[F.col(n) for n in names], column).mapInArrow(run, schema)


def matrix(rows: Iterable[bytes], kind: str, *shape: int) -> np.ndarray:
    """The rows' bytes as one array, a line for each; ``shape`` is a line's, flat unless given."""
    rows = list(rows)
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), *(shape or (-1,)))
