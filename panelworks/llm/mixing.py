"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Each source's target is reached in units of *blocks*: small groups of documents
that a hash permutes. A source's quota is a number of blocks: its whole passes take every block
once, the last pass the first blocks in permuted order up to the target, and of the block at the
border the documents that fit. A splitting tree over the output shards hands the quotas out: at each
node the blocks of all sources that its shards get are split between left and right by a
multivariate hypergeometric draw, whose seed is the node's place, so any task can walk down to any
shard alone. A shard's blocks of a source are a run of that source's permuted order, thus disjoint
from all others; each shard is shuffled locally. Documents are in the mix only through a block that
a shard was handed, and a block of a quota that no shard got is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import table
from panelworks.sources.durable import durable


@dataclass(frozen=True)
class Plan:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by source in code point order, null last, repeating
    share: float = 1.5  # of all words
    most_passes: float = 2.0  # over a source
    block_words: int = 20_000
    shard_words: int = 2_000_000
    most_shards: int = 65_536
    seed: int = 5


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in K.chunks(batch.column("text")):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "key": batch.column("key").slice(lo, hi - lo), "source": batch.column("source").slice(lo, hi - lo), "size": pa.array(np.diff(K.word_spans(data, at)[2]).astype(np.int64))})


def row_key(doc: Column, text: Column, source: Column) -> Column:
    """What a row is known by, with or without a doc_id; rows equal in all three have the same."""
    return F.xxhash64(doc.cast("long"), text, source, text.isNull())


def word_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, key (see ``row_key``), source and number of words of each row; texts go no further."""
    keyed = documents.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("key"), "source", "text")
    return keyed.mapInArrow(_sizes, "doc_id long, key long, source string, size long")


def targets(sizes: list[int], plan: Plan = Plan()) -> list[float]:
    """Words to take from each source: shares by weight, at most ``most_passes`` times its size, the excess shared anew."""
    weights = [plan.weights[k % len(plan.weights)] for k in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), plan.share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total > plan.most_passes * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = plan.most_passes * sizes[k]
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return out


def split(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks that a shard gets of each source, walking down the tree."""
    start, own, lo, hi, node = np.zeros(len(quotas), np.int64), quotas.astype(np.int64), 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = int(own.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(own, take, method="marginals")
        if shard < mid:
            own, hi, node = left, mid, 2 * node
        else:
            start, own, lo, node = start + left, own - left, mid, 2 * node + 1
    return start, own


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """Of a block in permuted order, every document that still fits into the room left, and one more if that comes nearer."""
    block = block.sort_values(["mixed", "row"])
    left, take = block["room"].iloc[0], []
    for size in block["size"]:
        take.append(size <= left)
        left -= size if take[-1] else 0
    over = [(size, k) for k, (size, taken) in enumerate(zip(block["size"], take, strict=True)) if not taken]
    if over and min(over)[0] - left < left:
        take[min(over)[1]] = True
    return block.loc[take, ["k", "block", "row", "mixed"]]


def draw(documents: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """Sizes (doc_id, key, row, source, size, source_size, target) and draws (row, copy, shard, place).

    ``row`` tells rows apart that share a doc_id. Per source, of which there are few, one row of
    sums comes to the driver; per document or block nothing does.
    """
    spark = documents.sparkSession
    hashed = F.xxhash64("doc_id", "source", "size", F.lit(plan.seed))
    sizes = word_sizes(documents)
    sized = durable(sizes.withColumn("mixed", hashed).withColumn("row", F.monotonically_increasing_id()))
    sums = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["size"] for r in sums], plan)
    rows, blocks_of = [], []
    for k, (r, t) in enumerate(zip(sums, wanted, strict=True)):
        passes = int(t // r["size"]) if r["size"] else 0
        blocks_of.append(max(1, -(-r["size"] // plan.block_words)))
        rows.append((k, r["source"], r["size"], float(t), passes, float(t - passes * r["size"]), blocks_of[-1]))
    schema = "k int, source string, source_size long, target double, passes int, rest double, n_blocks long"
    facts = spark.createDataFrame(rows, schema)
    sized = sized.join(F.broadcast(facts.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")  # a row per source
    placed = sized.withColumn("block", F.pmod(F.xxhash64("mixed", F.lit("block")), F.col("n_blocks")))

    # The part of the last pass: whole blocks in permuted order, then documents of the border block.
    # Sums of blocks are windowed by stretch of blocks, so that no source is in one task.
    stretch = F.floor(F.col("block") / 512)
    by_block = placed.groupBy("k", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("stretch", stretch)
    by_stretch = by_block.groupBy("k", "stretch").agg(F.sum("words").alias("stretch_words"))
    before = Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    by_stretch = by_stretch.withColumn("stretch_before", F.coalesce(F.sum("stretch_words").over(before), F.lit(0)))
    within = Window.partitionBy("k", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = by_block.join(by_stretch, ["k", "stretch"]).select("k", "block", "words", "rest", (F.col("stretch_before") + F.coalesce(F.sum("words").over(within), F.lit(0))).alias("words_before"))
    border = F.broadcast(edges.where("words_before < rest and words_before + words > rest").select("k", "block", "words_before"))  # a row per source at most
    cut = placed.where("size > 0").join(border, ["k", "block"]).select("k", "block", "row", "mixed", "size", (F.col("rest") - F.col("words_before")).alias("room"))
    some = cut.groupBy("k").applyInPandas(_fill, "k int, block long, row long, mixed long")  # one block of a source
    whole = edges.where("words > 0 and words_before + words <= rest").select("k", "block")
    everything = placed.where("passes > 0").select("k", "block", "row", "mixed", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("copy"))
    last = placed.join(whole, ["k", "block"]).select("k", "block", "row", "mixed", (F.col("passes") + 1).alias("copy"))
    edge_rows = some.join(F.broadcast(facts), "k").select("k", "block", "row", "mixed", (F.col("passes") + 1).alias("copy"))
    taken = everything.unionByName(last).unionByName(edge_rows)

    # Blocks of the mix, numbered through by pass: (k, copy, block) -> slot of the source's permuted order.
    counts = {r["k"]: r["n"] for r in edges.where("words > 0 and words_before < rest").groupBy("k").agg(F.max(F.col("block") + 1).alias("n")).collect()}
    quotas = np.array([r[4] * r[6] + counts.get(r[0], 0) for r in rows], np.int64)
    words = sum(wanted)
    shards = int(min(max(1, -(-words // plan.shard_words)), plan.most_shards))

    def hand_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                start, own = split(quotas, shards, int(shard), plan.seed)
                yield pd.DataFrame({"k": np.repeat(np.arange(len(own)), own).astype(np.int32), "slot": np.concatenate([np.arange(a, a + n) for a, n in zip(start, own, strict=True)]) if len(own) else np.zeros(0, np.int64), "shard": np.full(int(own.sum()), shard, np.int64)})

    handed = spark.range(shards).mapInPandas(hand_out, "k int, slot long, shard long")
    slotted = taken.join(F.broadcast(facts.select("k", "n_blocks")), "k").withColumn("slot", (F.col("copy") - 1) * F.col("n_blocks") + F.col("block"))
    lost = F.raise_error(F.lit("a block of a quota was handed to no shard")).cast("long")
    drawn = slotted.join(handed, ["k", "slot"], "left").select("row", "copy", F.coalesce("shard", lost).alias("shard"), F.xxhash64("mixed", "row", "copy", "shard").alias("place"))
    return sized.select("doc_id", "key", "row", "source", "size", "source_size", "target"), drawn


def mix(documents: DataFrame, plan: Plan = Plan(), places: bool = True) -> DataFrame:
    """The mix: rows of ``documents`` as often as drawn, with ``mix_shard`` and ``mix_place`` unless ``places`` is false.

    Each shard is in one partition and in its random order.

    Texts are joined to the numbers of their draws by a hash of doc_id, text and source, which rows
    without a doc_id have too. Rows that share it, thus equal in these, are matched in turn.
    """
    names = documents.columns
    spine = documents.toDF(*[f"c{k}" for k in range(len(names))])
    doc, text, source = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source"))
    sizes, drawn = draw(documents, plan)
    same = Window.partitionBy("_key")
    listed = sizes.select(F.col("key").alias("_key"), "row").withColumns({"_of": F.count("*").over(same), "_turn": F.row_number().over(same.orderBy("row"))})
    per_row = listed.join(drawn.groupBy("row").agg(F.collect_list(F.struct("copy", "shard", "place")).alias("_draws")), "row").drop("row")
    keyed = spine.withColumn("_key", row_key(doc, text, source))
    single = keyed.join(per_row.where("_of = 1").drop("_of", "_turn"), "_key")
    repeated = keyed.join(listed.where("_of > 1 and _turn = 1").select("_key"), "_key", "left_semi").withColumn("_turn", F.row_number().over(same.orderBy(text)))
    dealt = single.unionByName(repeated.join(per_row.where("_of > 1").drop("_of"), ["_key", "_turn"]).drop("_turn")).withColumn("_draw", F.explode("_draws"))
    shuffled = dealt.repartition("_draw.shard").sortWithinPartitions("_draw.shard", "_draw.place")
    return shuffled.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], *[F.col("_draw.shard").alias("mix_shard"), F.col("_draw.place").alias("mix_place")] * places)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 0; a source without words has target 0. Equal documents are drawn row by row.

    ``shards`` lists the shards that the tree put a document's copies into, ``places`` its places in
    them, in the order of the passes; a document is taken as often as the tree handed it out.
    """
    sizes, drawn = draw(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    copies = drawn.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "place"))).alias("draws"))
    taken = F.col("size") * F.coalesce(F.array_size("draws"), F.lit(0))
    return sizes.join(copies, "row", "left").select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("shards"), F.col("draws.place").alias("places"))
