"""Exact samples by the order of a hash, found by counting: no sort of all rows, nothing merged in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS, BITS = 5, 12  # a hash is read in five digits of twelve bits
HIGHEST = (1 << DIGITS * BITS) - 1


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a long: its order is that of the hex digits."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_limits(df: DataFrame, hashed: str, entered: str | None, groups: int, cap: int) -> list[int]:
    """For each group g the least hash such that ``cap`` rows with ``entered`` <= g lie at or below it.

    Groups are nested: a row belongs to the group it enters and to all later ones, so each group's sample
    follows from the counts of those before, and a row is counted once. ``HIGHEST`` where a group has no
    more than ``cap`` rows. Each pass counts one digit; after the first, only rows that share a border's
    digits are read. The driver gets ``groups`` times 4096 counts at most.
    """
    high = (DIGITS - 1) * BITS
    at = F.col(entered).cast("int") if entered else F.lit(0)
    x = df.select(F.col(hashed).alias("_h"), at.alias("_g")).where("_h is not null and _g is not null")
    counts = np.zeros((groups, 1 << BITS), np.int64)
    for r in x.groupBy("_g", F.shiftright("_h", high).cast("int").alias("d")).count().collect():
        if r["_g"] < groups:
            counts[max(r["_g"], 0), r["d"]] += r["count"]
    counts = counts.cumsum(0)
    out, open_ = [HIGHEST] * groups, {}
    for g in range(groups):
        if counts[g].sum() > cap:
            _narrow(g, 0, cap, counts[g], high, out, open_)
    while open_:
        shift = next(iter(open_.values()))[2] - BITS
        borders = F.broadcast(df.sparkSession.createDataFrame([(g, prefix) for g, (prefix, _, _) in open_.items()], "g int, prefix long"))  # a row for each group
        near = x.join(borders, (F.shiftright("_h", shift + BITS) == F.col("prefix")) & (F.col("_g") <= F.col("g")))
        digit = F.shiftright("_h", shift).bitwiseAND((1 << BITS) - 1).cast("int")
        counts = np.zeros((groups, 1 << BITS), np.int64)
        for r in near.groupBy("g", digit.alias("d")).count().collect():
            counts[r["g"], r["d"]] = r["count"]
        was, open_ = open_, {}
        for g, (prefix, left, _) in was.items():
            _narrow(g, prefix, left, counts[g], shift, out, open_)
    return out


def _narrow(g: int, prefix: int, left: int, counts: np.ndarray, shift: int, out: list[int], open_: dict[int, tuple[int, int, int]]) -> None:
    """Finds the digit in which the group's border lies: either it is settled, or (prefix, rows left, shift) go on."""
    upto = np.cumsum(counts)
    digit = int(np.searchsorted(upto, left))
    prefix, left = prefix << BITS | digit, left - int(upto[digit] - counts[digit])
    if shift == 0 or left == counts[digit]:
        out[g] = (prefix + 1 << shift) - 1
    else:
        open_[g] = prefix, left, shift


def capped_sample(df: DataFrame, key: str, cap: int, seed: int = 7) -> DataFrame:
    """At most ``cap`` rows, the first by the MD5 of key and seed, then by key: the same rows for all who ask.

    Rows with a null key are left out once there are more than ``cap`` rows. Of rows that repeat the key
    at the border, any are taken. Counts read the key alone, several times: hand over a stored table.
    """
    if df.count() <= cap:
        return df
    text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))
    hashed = df.withColumn("_h", hash60(text))
    limit = hash_limits(hashed, "_h", None, 1, cap)[0]
    below = hashed.where(F.col("_h") < limit)
    border = hashed.where(F.col("_h") == limit)
    room, there = cap - below.count(), border.count()
    if there > room:
        border = border.orderBy(F.md5(text), key).limit(room)  # rows of one hash
    return below.unionByName(border).drop("_h")
