"""Isotonic regression by pooling adjacent violators, within ranges of the score first and then across them.

Pooling gives the same blocks in whatever order violators are pooled. So rows with equal scores are summed,
each range of scores is pooled in its task, and the blocks left over are pooled again in ever fewer, wider
ranges. With labels of 0 and 1, n rows leave about n**(2/3) blocks at most, as their means are different
fractions; the last task and the driver hold those alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.sources.durable import durable

MOST = 2_000_000  # blocks of a fit; two numbers each go to every executor


@dataclass(frozen=True)
class Isotonic:
    """Scores at which blocks begin and end, ascending, and the fit there, never falling."""

    x: np.ndarray
    v: np.ndarray


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: blocks (lo, hi, s, n) in ascending order, pooled until their means s / n rise."""
    lo, hi, s, n = [], [], [], []
    for batch in batches:
        for a, b, t, m in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "s", "n")), strict=True):
            while n and s[-1] * m >= t * n[-1]:
                a, t, m = lo.pop(), s.pop() + t, n.pop() + m
                hi.pop()
            lo.append(a), hi.append(b), s.append(t), n.append(m)
    yield pa.RecordBatch.from_pydict({"lo": pa.array(lo, pa.float64()), "hi": pa.array(hi, pa.float64()), "s": pa.array(s, pa.float64()), "n": pa.array(n, pa.int64())})


def isotonic(train: DataFrame, score: str, y: str, fewer: int = 16) -> Isotonic:
    """The least-squares fit of ``y`` that never falls with ``score``. Rows with a missing score or label do not count."""
    x, t = F.col(score).cast("double"), F.col(y).cast("double")
    rows = train.select(x.alias("lo"), t.alias("y")).where("lo is not null and not isnan(lo) and y is not null")
    blocks = rows.groupBy("lo").agg(F.sum("y").alias("s"), F.count("*").alias("n")).select("lo", F.col("lo").alias("hi"), "s", "n")
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        blocks = durable(blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(_pool, "lo double, hi double, s double, n long"))
        if parts == 1:
            break
        parts = max(1, parts // fewer)
    if blocks.count() > MOST:
        raise ValueError(f"more than {MOST} steps: round the scores first")
    got = blocks.orderBy("lo").toPandas()
    return Isotonic(np.column_stack([got["lo"], got["hi"]]).ravel(), np.repeat(got["s"] / got["n"], 2).to_numpy())


def calibrated(model: Isotonic, df: DataFrame, score: str, out: str = "p_cal") -> DataFrame:
    """Adds ``out``: the fit at ``score``, within 0 and 1; straight between blocks, level beyond the ends. NULL without a score or a fit."""
    shared = df.sparkSession.sparkContext.broadcast((model.x, model.v))

    @F.pandas_udf("double")
    def at(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        x, v = shared.value
        for s in batches:
            s = s.astype(float)
            yield pd.Series(np.where(s.notna(), np.interp(s, x, v), np.nan) if len(x) else np.full(len(s), np.nan))

    value = at(F.col(score).cast("double"))
    return df.withColumn(out, F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))
