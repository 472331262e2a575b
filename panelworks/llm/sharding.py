"""Resharding at the least movement: a minimum-cost flow from old shards to new capacities, block by block.

Each old shard supplies its bytes, each new one takes its capacity; bytes that stay where they are cost
nothing, all others one each. The flow is over shards, so the driver holds a number or two for each. What
leaves a shard and what enters one meet in the order of the shards, so that an entering shard has few
seams. An old shard's blocks (runs of rows of a file) lie on its line of bytes; the flow cuts that line.
A block inside one stretch goes there as a whole; the rows of the few blocks that a cut crosses are dealt,
largest first, to the stretch with most room left.

Stored tables are versions: a list that names each shard's folder. Resharding writes the folders of shards
that lose or gain rows and a new list; all others are taken over as they are.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.flow import Network
from panelworks.sources.durable import durable


@dataclass(frozen=True)
class Layout:
    overhead: int = 16  # bytes of a row beside its text
    block_rows: int = 1024
    stretch: int = 1024  # blocks that a running sum takes at once
    file_rows: int = 65_536  # rows of a written file
    broadcast_rows: int = 100_000


def capacities(total: int, shards: int) -> list[int]:
    """Equal to one byte."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def transfers(supply: list[int], rooms: list[int], home: list[int | None]) -> list[list[tuple[int, int]]]:
    """For each old shard the (new shard, bytes) that it is cut into, first what stays; the fewest bytes move.

    ``home``: the new shard that each old one's bytes are in already, if any. The rooms hold all supply.
    """
    if sum(rooms) < sum(supply):
        raise ValueError("the new capacities do not hold the rows")
    n, m = len(supply), len(rooms)
    pool, source, sink = n + m, n + m + 1, n + m + 2
    net = Network(n + m + 3)
    stay, leave = [], []
    for k, s in enumerate(supply):
        net.arc(source, k, s)
        stay.append(net.arc(k, n + home[k], s) if home[k] is not None else None)
        leave.append(net.arc(k, pool, s, 1))
    enter = [net.arc(pool, n + j, r) for j, r in enumerate(rooms)]
    for j, r in enumerate(rooms):
        net.arc(n + j, sink, r)
    net.push(source, sink)
    out, j = [], 0
    left = [net.flow(a) for a in enter]
    for k in range(n):
        cut = [(home[k], net.flow(stay[k]))] if stay[k] is not None and net.flow(stay[k]) else []
        rest = net.flow(leave[k])
        while rest:
            if not left[j]:
                j += 1
                continue
            step = min(rest, left[j])
            cut.append((j, step))
            left[j] -= step
            rest -= step
        out.append(cut)
    return out


def running(df: DataFrame, group: str, order: list[str], last: str, value: str, out: str, stretch: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's earlier rows by ``order`` and then ``last``, a number.

    Summed by stretches of ``last`` first, so that no task has all rows of a group.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(last) / stretch))
    keys = [group, *order, "_stretch"]
    upto = Window.partitionBy(group).orderBy(*order, "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    here = cut.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return here.join(sums, keys).withColumn(out, F.col("_before") + F.col("_here")).drop("_stretch", "_before", "_here")


def _deal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A cut block's rows, largest first, to the stretch with most room left; ties to the first stretch."""
    rows = rows.sort_values(["size", "pos"], ascending=[False, True])
    room = [(-int(r["room"]), k, int(r["shard"])) for k, r in enumerate(rows["cuts"].iloc[0])]
    heapq.heapify(room)
    shard = np.zeros(len(rows), np.int32)
    for i, size in enumerate(rows["size"]):
        left, k, to = room[0]
        shard[i] = to
        heapq.heapreplace(room, (left + int(size), k, to))
    return rows.drop(columns="cuts").assign(shard=shard)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its known number of rows allows it."""
    return F.broadcast(df) if rows <= most else df


def assign(rows: DataFrame, supply: dict[int, int], rooms: list[int], home: dict[int, int], cfg: Layout = Layout()) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's place in it, without gaps from 0.

    ``rows``: old (int), run (each in one old shard), pos (its place in the run; both not null and together
    unique), size, at least one byte; further columns stay. ``supply``: bytes of each old shard; ``rooms``: of each new one.
    """
    spark, kept = rows.sparkSession, rows.columns
    olds = sorted(supply)
    plan = transfers([supply[o] for o in olds], rooms, [home.get(o) for o in olds])
    lines = []
    for o, cuts in zip(olds, plan, strict=True):
        ends = np.cumsum([0, *(n for _, n in cuts)]).tolist()
        lines.append((o, [(s, lo, hi) for (s, _), lo, hi in zip(cuts, ends, ends[1:])]))
    stretches = spark.createDataFrame(lines, "old int, stretches array<struct<shard: int, lo: long, hi: long>>")
    rows = rows.withColumn("block", F.floor(F.col("pos") / cfg.block_rows))
    blocks = running(rows.groupBy("old", "run", "block").agg(F.sum("size").alias("bytes")), "old", ["run"], "block", "bytes", "lo", cfg.stretch)
    met = F.filter("stretches", lambda s: (s["lo"] < F.col("lo") + F.col("bytes")) & (s["hi"] > F.col("lo")))
    room = lambda s: F.least(s["hi"], F.col("lo") + F.col("bytes")) - F.greatest(s["lo"], F.col("lo"))
    cut = F.transform(met, lambda s: F.struct(s["shard"].alias("shard"), room(s).alias("room")))
    blocks = durable(blocks.join(small(stretches, len(lines), cfg.broadcast_rows), "old").select("run", "block", cut.alias("cuts")))
    dealt = rows.join(blocks, ["run", "block"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    whole = dealt.where(F.size("cuts") == 1).withColumn("shard", F.col("cuts")[0]["shard"]).drop("cuts")
    crossed = dealt.where(F.size("cuts") > 1).groupBy("run", "block").applyInPandas(_deal, schema + ", shard int")
    placed = durable(whole.select(*rows.columns, "shard").unionByName(crossed.select(*rows.columns, "shard")))
    pieces = running(placed.groupBy("shard", "old", "run", "block").agg(F.count("*").alias("n")), "shard", ["old", "run"], "block", "n", "before", cfg.stretch)
    at = F.row_number().over(Window.partitionBy("run", "block", "shard").orderBy("pos")) - 1
    return placed.withColumn("_at", at).join(pieces.select("run", "block", "shard", "before"), ["run", "block", "shard"]).select(*kept, "shard", (F.col("before") + F.col("_at")).alias("slot"))


def row_bytes(text: Column, cfg: Layout = Layout()) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + cfg.overhead


def crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def by_file(table: DataFrame, *columns: Column | str) -> tuple[DataFrame, dict[int, int]]:
    """A stored table's rows with old, run and pos, each file an old shard, numbered by path; bytes of each.

    ``columns``: further ones, ``size`` among them. The driver gets a row for each file.
    """
    rows = durable(table.select(*columns, F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("run"), F.col("_metadata.row_index").alias("pos")))
    files = sorted((r["path"], r["run"], r["n"]) for r in rows.groupBy("path", "run").agg(F.sum("size").alias("n")).collect())
    if len({r for _, r, _ in files}) < len(files):
        raise ValueError("two files' paths share a hash")
    numbers = table.sparkSession.createDataFrame([(r, k) for k, (_, r, _) in enumerate(files)], "run long, old int")
    return rows.drop("path").join(small(numbers, len(files), Layout.broadcast_rows), "run"), {k: n for k, (_, _, n) in enumerate(files)}


def reshard_files(table: DataFrame, shards: int, cfg: Layout = Layout(), *columns: str) -> DataFrame:
    """(columns, size, text_crc32, old, shard, slot): the files of a stored table of documents into near-equal shards.

    File k, by path, is the shard k so far; files past the last shard have to move. Rows are told apart
    by file and place, so repeated rows, null ids and null texts (16 bytes) are rows like others. An empty
    table gives no rows.
    """
    text = F.col("text")
    rows, supply = by_file(table, *columns, row_bytes(text, cfg).alias("size"), crc(text).alias("text_crc32"))
    home = {k: k for k in supply if k < shards}
    return assign(rows, supply, capacities(sum(supply.values()), shards), home, cfg).drop("run", "pos")


def write_sharded(documents: DataFrame, folder: str, shards: int, cfg: Layout = Layout()) -> str:
    """Stores ``documents`` in shards by a hash of text and doc_id; returns the path of the list of folders.

    Columns named shard or slot are replaced.
    """
    to = F.pmod(F.xxhash64("text", "doc_id"), F.lit(shards)).cast("int")
    return _store(documents.withColumns({"shard": to, "slot": F.monotonically_increasing_id()}), folder, {}, cfg)


def read_sharded(spark: SparkSession, version: str) -> DataFrame:
    """The rows of a stored version, with ``shard`` and ``slot``."""
    parts = [spark.read.option("basePath", base).parquet(*paths) for base, paths in _folders(spark, version)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("shard", F.col("shard").cast("int"))


def _folders(spark: SparkSession, version: str) -> list[tuple[str, list[str]]]:
    found: dict[str, list[str]] = {}
    for r in sorted(spark.read.parquet(version).collect()):  # a row for each shard
        found.setdefault(r["base"], []).append(f"{r['base']}/shard={r['shard']}")
    return list(found.items())


def _store(rows: DataFrame, folder: str, stay: dict[int, str], cfg: Layout) -> str:
    """Writes ``rows`` by shard and the list of all folders: those written and those that ``stay``."""
    spark, base, version = rows.sparkSession, f"{folder}/data-{uuid.uuid4().hex}", f"{folder}/version-{uuid.uuid4().hex}"
    cut = F.floor(F.col("slot") / cfg.file_rows)
    rows.repartition("shard", cut).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(base)
    written = spark.read.schema(rows.schema).parquet(base).select("shard").distinct().collect()  # a row for each shard
    new = {r["shard"]: base for r in written}
    spark.createDataFrame(sorted((stay | new).items()), "shard int, base string").coalesce(1).write.parquet(version)
    return version


def reshard_table(spark: SparkSession, version: str, folder: str, shards: int, cfg: Layout = Layout()) -> str:
    """A new version of a stored table with ``shards`` near-equal shards; returns the path of its list.

    Shards whose rows all stay, and to which none come, keep their folders and are not written again.
    The old version stays readable.
    """
    bases = {int(p.rsplit("=", 1)[1]): base for base, paths in _folders(spark, version) for p in paths}
    table = None
    for base, paths in _folders(spark, version):
        part = spark.read.option("basePath", base).parquet(*paths)
        part = part.withColumns({"_old": F.col("shard").cast("int"), "_run": F.xxhash64("_metadata.file_path"), "_pos": F.col("_metadata.row_index")}).drop("shard", "slot")
        table = part if table is None else table.unionByName(part)
    rows = durable(table.select(F.col("_old").alias("old"), F.col("_run").alias("run"), F.col("_pos").alias("pos"), row_bytes(F.col("text"), cfg).alias("size")))
    supply = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    placed = durable(assign(rows, supply, capacities(sum(supply.values()), shards), {k: k for k in supply if k < shards}, cfg).select("old", "run", "pos", "shard", "slot"))
    flows = placed.groupBy("old", "shard").agg(F.count("*").alias("n")).where("old <> shard").collect()  # as many as the flow has arcs
    touched = sorted({k for r in flows for k in (r["old"], r["shard"]) if k < shards})
    stay = {k: bases[k] for k in supply if k < shards and k not in touched}
    to = placed.where(F.col("shard").isin(touched)).select(F.col("run").alias("_run"), F.col("pos").alias("_pos"), "shard", "slot")
    return _store(table.join(to, ["_run", "_pos"]).drop("_old", "_run", "_pos"), folder, stay, cfg)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files resharded into 40: the law is ``bytes``, equal texts are rows like others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = reshard_files(docs, 40, Layout(), "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
