"""From banded MinHash buckets to verified links and components, whatever the size of a bucket.

All links within a bucket matter, but a bucket may hold a third of all items, so pairs are never
expanded. Instead:

1. *Stars*: each bucket's members are compared with two leaders that a hash of bucket and id picks,
   so the buckets of one large group have different leaders. That settles buckets of up to three
   members. Verified links unite most groups of copies at once, and members that share a component
   need no more comparing. Buckets of more than a block that are still open get further rounds.
2. *The rest*: buckets that still hold two components or more. Those of up to a block are packed
   into groups of bounded size; of larger ones each pair of blocks is a group. Blocks that hold the
   bucket's largest component only are not paired with each other. A group compares its pairs across
   components in memory and passes on only links that unite components.

Every pair across components that shares a bucket is thus compared; no cap drops any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.components import components
from panelworks.llm.learning import blob
from panelworks.sources.durable import durable


@dataclass(frozen=True)
class Similarity:
    percent: int = 80  # least Jaccard similarity
    rows: int = 4  # signature values in a band
    band_miss: float = 1e-6  # chance that a pair at the threshold shares no band
    verify_miss: float | None = 1e-6  # posterior chance of similarity below which a pair is dropped unread; None: all pairs are read
    batch: int = 16  # signature values compared at a time
    compared: int = 64  # signature values to compare at least
    stars: int = 2  # rounds of leaders at most
    small: int = 512  # members of a bucket that is compared in one piece
    block: int = 512  # members of larger buckets in one block
    block_bytes: int = 8 << 20  # bytes of bodies in one piece or block

    @property
    def bands(self) -> int:
        return int(np.ceil(np.log(self.band_miss) / np.log(1 - (self.percent / 100) ** self.rows)))

    @property
    def values(self) -> int:
        return -(-max(self.rows * self.bands, self.compared) // self.batch) * self.batch


_SEEDS = np.random.default_rng(7).integers(0, 2**32, (2, 4096), dtype=np.uint32)
_SEEDS[1] |= np.uint32(1)
TURN = 8  # values in a row that differ in their multiplier only


def signatures(items: np.ndarray, starts: np.ndarray, values: int) -> np.ndarray:
    """MinHash values (a row for each set); ``items`` are 64-bit hashes, set i from starts[i] on, none empty."""
    out = np.empty((len(starts), values), np.uint32)
    if not len(starts):
        return out
    low = (items >> np.uint64(32)).astype(np.uint32)
    turned, hashed = np.empty_like(low), np.empty_like(low)
    for k in range(values):
        if k % TURN == 0:
            np.bitwise_xor(low, _SEEDS[0, k], out=turned)
        np.multiply(turned, _SEEDS[1, k], out=hashed)
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(signature: np.ndarray, similarity: Similarity) -> np.ndarray:
    """A 64-bit bucket for each band of each signature, the band's number in its top byte."""
    used = signature[:, : similarity.rows * similarity.bands].astype(np.uint64).reshape(len(signature), similarity.bands, similarity.rows)
    out = np.broadcast_to(np.arange(1, similarity.bands + 1, dtype=np.uint64), used.shape[:2]).copy()
    for k in range(similarity.rows):
        out = K.mix(out * np.uint64(0xD6E8FEB86659FD93) + used[:, :, k])
    return (out >> np.uint64(8) | np.arange(similarity.bands, dtype=np.uint64) << np.uint64(56)).view(np.int64)


@lru_cache
def least_matches(similarity: Similarity) -> np.ndarray:
    """For each number n of compared values, the fewest matches at which a pair may still be similar.

    With a uniform prior the posterior of the similarity after m matches of n is Beta(m+1, n-m+1),
    and its mass above t is the chance of at most m successes in n+1 trials at t.
    """
    t, out = similarity.percent / 100, np.zeros(similarity.values + 1, np.int64)
    for n in range(similarity.batch, similarity.values + 1, similarity.batch):
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= similarity.verify_miss:
                break
            m += 1
        out[n] = m
    return out


def may_be_similar(left: np.ndarray, right: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Sequential Bayesian test of aligned signature rows: which pairs survive all batches."""
    least = least_matches(similarity)
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n in range(similarity.batch, similarity.values + 1, similarity.batch):
        part = slice(n - similarity.batch, n)
        matches = matches + (left[alive, part] == right[alive, part]).sum(1)
        keep = matches >= least[n]
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def packed_signatures(signature: np.ndarray) -> list[bytes]:
    """The lowest byte of each value: unequal values agree in it once in 256 times, which only keeps more pairs."""
    return [blob(row) for row in signature.astype(np.uint8)]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return K.utf8(column)[0].reshape(-1, width)


def _prune(similarity: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_be_similar(_rows(batch.column("sig_a"), similarity.values), _rows(batch.column("sig_b"), similarity.values), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


Expand = Callable[[pa.Array], list[np.ndarray]]


def _runs(batch: pa.RecordBatch, columns: list[str], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose binary columns have about ``limit`` bytes (or a single row)."""
    upto = np.sum([K.utf8(batch.column(c))[1] for c in columns], axis=0)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _each(bodies: pa.Array, expand: Expand) -> Iterator[np.ndarray]:
    """The set of each body; equal bodies are expanded once."""
    coded = bodies.dictionary_encode()
    sets = expand(coded.dictionary)
    return (sets[k] for k in coded.indices.to_pylist())


def _confirm(similarity: Similarity, expand: Expand):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _runs(whole, ["body_a", "body_b"]):
                keep = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(_each(batch.column("body_a"), expand), _each(batch.column("body_b"), expand), strict=True)):
                    if 100 * min(len(x), len(y)) >= similarity.percent * max(len(x), len(y)):
                        same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        keep[i] = 100 * same >= similarity.percent * (len(x) + len(y) - same)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, profiles: DataFrame, similarity: Similarity, expand: Expand) -> DataFrame:
    """The pairs (a, b) whose sets are similar: signature batches first, if asked for, then the sets themselves."""
    side = lambda column, end: profiles.select(F.col("id").alias(end), F.col(column).alias(f"{column}_{end}"))
    if similarity.verify_miss is not None:
        drawn = pairs.join(side("sig", "a"), "a").join(side("sig", "b"), "b").select("a", "b", "sig_a", "sig_b")
        pairs = drawn.mapInArrow(_prune(similarity), "a long, b long")
    full = pairs.join(side("body", "a"), "a").join(side("body", "b"), "b").select("a", "b", "body_a", "body_b")
    return full.mapInArrow(K.lean(_confirm(similarity, expand)), "a long, b long")


class Overlaps:
    """Sizes of intersections among a bounded number of sets, by bits for the members that two sets or more have."""

    WORDS = 1 << 22

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(counts > 1) - 1
        width = (int(rank[-1]) >> 6) + 1
        self.bits = None
        if width * len(sets) <= self.WORDS:
            use = counts[place] > 1
            at = rank[place[use]]
            word = np.repeat(np.arange(len(sets)), self.sizes)[use] * width + (at >> 6)
            self.bits = np.zeros(len(sets) * width, np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            if len(edge):  # sets are sorted, so the bits of a word stand in a row
                self.bits[word[edge]] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), edge)
            self.bits = self.bits.reshape(len(sets), width)

    def similar(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``others`` whose Jaccard similarity with set i is ``percent`` or more."""
        sizes = self.sizes[others]
        fits = 100 * np.minimum(sizes, self.sizes[i]) >= percent * np.maximum(sizes, self.sizes[i])
        others, sizes = others[fits], sizes[fits]
        if not len(others):
            return others
        if self.bits is not None:
            same = np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)
        else:
            x = self.sets[i]
            same = np.array([int((x[np.minimum(np.searchsorted(x, self.sets[j]), len(x) - 1)] == self.sets[j]).sum()) for j in others], np.int64)
        return others[100 * same >= percent * (sizes + self.sizes[i] - same)]


def _across(similarity: Similarity, expand: Expand):
    """Group: of the pairs across components in its buckets, or in two blocks of one, verified links that unite components.

    A pair that shares several bands is looked at by the first of them only, as told by the full
    keys of the bands: the bytes of the signatures may agree in a band whose bucket is not shared.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, first, place = np.unique(group["id"].to_numpy(), return_index=True, return_inverse=True)
        overlaps = Overlaps(expand(pa.array(group["body"].iloc[first], pa.binary())))
        bands = np.frombuffer(b"".join(group["bands"].iloc[first]), np.int64).reshape(-1, similarity.bands)
        sigs = np.frombuffer(b"".join(group["sig"].iloc[first]), np.uint8).reshape(-1, similarity.values) if similarity.verify_miss is not None else None
        names, root_at = np.unique(group["label"].to_numpy()[first], return_inverse=True)
        root = np.arange(len(names))
        buckets, own = group["bucket"].to_numpy(), group["own"].to_numpy()
        order = np.lexsort((own, buckets))
        links = []
        for part in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
            members, blocks = place[part], own[part]
            band = int(buckets[part[0]]) >> 56 & 255
            two = blocks[0] != blocks[-1]  # of two blocks, pairs within a block belong to another group
            left, right = (members[blocks == blocks[0]], members[blocks != blocks[0]]) if two else (members, members)
            for k, i in enumerate(left):
                others = right if two else right[k + 1 :]
                others = others[root[root_at[others]] != root[root_at[i]]]
                if len(others) and sigs is not None:
                    others = others[may_be_similar(np.broadcast_to(sigs[i], (len(others), similarity.values)), sigs[others], similarity)]
                if len(others) and band:
                    others = others[~(bands[others, :band] == bands[i, :band]).any(1)]
                for j in overlaps.similar(i, others, similarity.percent) if len(others) else ():
                    if root[root_at[j]] != root[root_at[i]]:
                        root[root == root[root_at[j]]] = root[root_at[i]]
                        links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _star(held: DataFrame, seed: int, n: int) -> DataFrame:
    """Pairs (a, b) across components of each bucket's two leaders and its members; ``held``: (bucket, id, label), of ``n`` rows at most."""
    drawn = F.xxhash64("id", "bucket", F.lit(seed))
    pick = lambda end, by: F.struct(*[by(c, drawn).alias(c) for c in ("id", "label")]).alias(end)  # noqa: E731 - of longs one by one, which Spark sums up by hashing
    leaders = held.groupBy("bucket").agg(pick("x", F.min_by), pick("y", F.max_by), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    leaders = durable(leaders.select("bucket", "x", "y", "n"), n)
    pair = lambda one, two: F.struct(F.least(f"{one}.id", f"{two}.id").alias("a"), F.greatest(f"{one}.id", f"{two}.id").alias("b"), (F.col(f"{one}.label") != F.col(f"{two}.label")).alias("apart"))
    couples = leaders.where("n = 2").select(pair("x", "y").alias("p"))
    wide = leaders.where("n > 2").drop("n").join(held.select("bucket", F.struct("id", "label").alias("own")), "bucket")
    rays = wide.select(F.explode(F.array(pair("own", "x"), pair("own", "y"))).alias("p"))
    return couples.unionByName(rays).where("p.apart").select("p.a", "p.b").distinct()


def linked(hits: DataFrame, profile: Callable[[DataFrame], DataFrame], similarity: Similarity, expand: Expand) -> DataFrame:
    """(id, label) of the items with links. ``hits``: distinct (bucket, id) of buckets with two ids or more.

    ``profile`` turns a table of ids into a table (id, sig, bands, body), sig being needed only if
    signatures are compared and bands being the packed ``band_keys``; ``expand`` turns bodies into
    sorted sets of 64-bit hashes.
    """
    spark = hits.sparkSession
    hits = durable(hits.select("bucket", "id"))
    n = hits.count()  # no table below but the last has more rows, a few times as many at most
    profiles = durable(profile(hits.select("id").distinct()), n)
    links = durable(verified(_star(hits.withColumn("label", F.col("id")), 0, n), profiles, similarity, expand), n)
    sizes = profiles.select("id", F.octet_length("body").cast("long").alias("bytes"))
    for k in range(1, similarity.stars + 1):
        labelled = sizes.join(components(links, 1, settle=False), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "bytes")
        held = hits.join(durable(labelled, n), "id")
        open_ = held.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high and n > 3").select("bucket", "n", "total")
        rest = durable(held.join(open_, "bucket").withColumn("large", (F.col("n") > similarity.small) | (F.col("total") > similarity.block_bytes)), n)
        large = rest.where("large")
        wide = _tops(large).where(F.col("n") - F.col("m") > similarity.block)  # more than a block of members outside the largest component
        if k == similarity.stars or wide.isEmpty():
            break
        links = durable(links.unionByName(verified(_star(large.join(wide.select("bucket"), "bucket", "left_semi").select("bucket", "id", "label"), k, n), profiles, similarity, expand)), n)
    few = rest.where("not large")
    load = few.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    packs = max(1, -(-load[0] // (2 * similarity.small)), -(-load[1] // similarity.block_bytes))
    packed = few.select(F.pmod(F.xxhash64("bucket"), F.lit(packs)).alias("pack"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"), F.lit(0).cast("long").alias("own"), "bucket", "id", "label")
    groups = packed.unionByName(_blocks(large, similarity)).join(profiles, "id")
    across = groups.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pack", "lo", "hi").groupBy("pack", "lo", "hi").applyInPandas(_across(similarity, expand), "a long, b long")
    return components(durable(links.unionByName(across), n))


def _tops(large: DataFrame) -> DataFrame:
    """(bucket, n, top, m): the bucket's members, its largest component and that one's members."""
    counts = large.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    return counts.groupBy("bucket").agg(F.first("n").alias("n"), F.max_by("label", F.struct("m", "label")).alias("top"), F.max("m").alias("m"))


def _blocks(large: DataFrame, similarity: Similarity) -> DataFrame:
    """The members of large buckets, once for each pair of blocks that has to be compared."""
    share = lambda n: F.ceil(F.greatest(n / F.lit(similarity.block), n / F.col("n") * F.col("total") / F.lit(similarity.block_bytes)))
    sided = large.join(_tops(large).drop("n"), "bucket").withColumn("tops", share(F.col("m"))).withColumn("others", share(F.col("n") - F.col("m")))
    inside = F.col("label") == F.col("top")
    sided = sided.withColumn("own", F.when(inside, F.pmod(F.xxhash64("id"), F.col("tops"))).otherwise(F.col("tops") + F.pmod(F.xxhash64("id"), F.col("others"))))
    sided = sided.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("tops")).otherwise(F.lit(0).cast("long")), F.col("tops") + F.col("others") - 1)))
    return sided.select(F.col("bucket").alias("pack"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "bucket", "id", "label")
