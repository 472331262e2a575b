"""Vector code compression: product codes whose codebooks come from Lloyd rounds with Elkan's bounds.

Vectors of whole numbers are cut into equal parts; each part position has a codebook. A table keeps, for
every part of every vector, its code, an upper bound of its distance to that entry and a lower bound of
its distance to each entry. When entries move, upper bounds grow by the movement of the code's entry and
lower bounds shrink by that of each. An entry is skipped if its lower bound, or half its distance to the
code's entry, is strictly greater than the upper bound; whatever is left is settled by exact integer
distances, ties by the lower index. Bounds are rounded outwards, so that rounding never skips a tie.

New entries are means: each task sums its parts by code, and the sums, one row for a part and entry, are
all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.learning import blob, table
from panelworks.llm.top_k import quantised
from panelworks.llm.vectors import matrix, packed
from panelworks.sources.durable import durable

MARGIN = 1e-12
MOST = 2**27  # of a component, so that a row's error fits a long


@dataclass(frozen=True)
class Codes:
    parts: int = 16
    entries: int = 64  # at most 256: a code is a byte
    rounds: int = 2
    chunk: int = 1024  # rows a task holds distances of
    broadcast_labels: int = 100_000


@dataclass
class Bounds:
    """Of n vectors: codes (n, parts), upper bounds (n, parts), lower bounds (n, parts, entries)."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def _up(x: np.ndarray) -> np.ndarray:
    """A float32 at least as large."""
    return np.nextafter((x * (1 + MARGIN)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """A float16 at most as large, not below zero."""
    return np.maximum(np.nextafter(np.minimum(x * (1 - MARGIN), 65_000).astype(np.float16), np.float16(-np.inf)), np.float16(0))


def _squares(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    return ((x[:, None, :] - books[None, :, :]) ** 2).sum(-1)


def first_bounds(x: np.ndarray, books: np.ndarray) -> Bounds:
    """Every distance computed. ``x``: (n, parts, width), ``books``: (parts, entries, width), of integers."""
    n, parts, _ = x.shape
    out = Bounds(np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts, books.shape[1]), np.float16))
    for p in range(parts):
        d2 = _squares(x[:, p], books[p])
        best = d2.argmin(1)  # the lowest index of ties
        out.code[:, p], out.lower[:, p] = best, _down(np.sqrt(d2))
        out.upper[:, p] = _up(np.sqrt(d2[np.arange(n), best]))
    return out


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry has moved, rounded up: (parts, entries)."""
    return np.sqrt(((old - new) ** 2).sum(-1).astype(np.float64)) * (1 + MARGIN)


def next_bounds(x: np.ndarray, kept: Bounds, books: np.ndarray, movement: np.ndarray, computed: list[int] | None = None) -> Bounds:
    """Codes and bounds under ``books``, whose entries have moved since ``kept``.

    ``computed`` gets the numbers of distances computed between vectors and entries.
    """
    n, parts, _ = x.shape
    code, lower, upper = kept.code.copy(), kept.lower.copy(), kept.upper.copy()
    for p in range(parts):
        own = kept.code[:, p].astype(np.int64)
        between = np.sqrt(_squares(books[p], books[p]).astype(np.float64)) * (1 - MARGIN) / 2
        np.fill_diagonal(between, np.inf)
        near = between.min(1)
        low = _down(np.maximum(lower[:, p].astype(np.float64) - movement[p], 0))
        high = _up(upper[:, p].astype(np.float64) + movement[p][own])
        rows = np.flatnonzero(~(near[own] > high))
        if len(rows):
            a = own[rows]
            exact = ((x[rows, p] - books[p][a]) ** 2).sum(-1)
            root = np.sqrt(exact.astype(np.float64))
            high[rows], low[rows, a] = _up(root), _down(root)
            ask = ~(low[rows] > high[rows, None]) & ~(between[a] > high[rows, None])
            ask[np.arange(len(rows)), a] = False
            i, j = np.nonzero(ask)
            d2 = ((x[rows[i], p] - books[p][j]) ** 2).sum(-1)
            low[rows[i], j] = _down(np.sqrt(d2.astype(np.float64)))
            grid = np.full(ask.shape, np.iinfo(np.int64).max)
            grid[np.arange(len(rows)), a], grid[i, j] = exact, d2
            best = grid.argmin(1)  # the lowest index of ties
            code[rows, p] = best
            high[rows] = _up(np.sqrt(grid[np.arange(len(rows)), best].astype(np.float64)))
            if computed is not None:
                computed.append(len(rows) + len(i))
        lower[:, p], upper[:, p] = low, high
    return Bounds(code, upper, lower)


def errors(x: np.ndarray, code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances to the codes' entries, summed over the parts of each vector."""
    return sum(((x[:, p] - books[p][code[:, p].astype(np.int64)]) ** 2).sum(-1) for p in range(x.shape[1]))


def _read(batch: pa.RecordBatch, parts: int, entries: int) -> tuple[np.ndarray, Bounds | None]:
    """A batch's vectors as (n, parts, width) integers, and its bounds if it has any."""
    x = matrix(batch.column("v").to_pylist(), "int32", parts, len(batch.column("v")[0].as_py()) // 4 // parts).astype(np.int64)
    if "code" not in batch.schema.names:
        return x, None
    shapes = {"code": ("uint8", parts), "upper": ("float32", parts), "lower": ("float16", parts, entries)}
    return x, Bounds(*(matrix(batch.column(c).to_pylist(), *s) for c, s in shapes.items()))


def _in_chunks(cfg: Codes, entries: int, work: Callable[[pa.RecordBatch, np.ndarray, Bounds | None], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, cfg.chunk):
                piece = batch.slice(lo, cfg.chunk)
                yield from work(piece, *_read(piece, cfg.parts, entries))

    return run


STATE = "vec_id long, label long, v binary, code binary, upper binary, lower binary"


def _assigned(rows: DataFrame, cfg: Codes, books: np.ndarray, movement: np.ndarray | None) -> DataFrame:
    """The table of bounds under ``books``: from vectors alone, or from the last such table."""

    def work(batch: pa.RecordBatch, x: np.ndarray, kept: Bounds | None) -> Iterator[pa.RecordBatch]:
        got = first_bounds(x, books) if kept is None else next_bounds(x, kept, books, movement)
        cols = {c: batch.column(c) for c in ("vec_id", "label", "v")}
        yield pa.RecordBatch.from_pydict(cols | {c: pa.array([blob(r) for r in getattr(got, c)], pa.binary()) for c in ("code", "upper", "lower")})

    return durable(rows.mapInArrow(_in_chunks(cfg, books.shape[1], work), STATE))


def _next_books(state: DataFrame, cfg: Codes, books: np.ndarray) -> np.ndarray:
    """Each entry's parts' componentwise mean, rounded down; entries without parts stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, code = _read(batch.select(["v"]), parts, entries)[0], matrix(batch.column("code").to_pylist(), "uint8", parts)
                for p in range(parts):
                    np.add.at(count[p], code[:, p], 1)
                    np.add.at(total[p], code[:, p], x[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"p": pa.array(p.astype(np.int32)), "e": pa.array(e.astype(np.int32)), "n": pa.array(count[p, e])} | {f"s{k}": pa.array(total[p, e, k]) for k in range(width)})

    names = [f"s{k}" for k in range(width)]
    sums = state.select("v", "code").mapInArrow(run, "p int, e int, n long, " + ", ".join(f"{c} long" for c in names))
    out = books.copy()
    for r in sums.groupBy("p", "e").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():  # parts * entries rows
        out[r["p"], r["e"]] = [r[c] // r["n"] for c in names]
    return out


def _with_label_sums(coded: DataFrame, cfg: Codes) -> DataFrame:
    """Adds ``label_error``. Labels are summed before they are dealt out; many labels meet their rows salted."""
    held = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = durable(coded.groupBy("label").agg(held.alias("label_error")).withColumnRenamed("label", "_label"))
    same: Column = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= cfg.broadcast_labels:
        return coded.join(F.broadcast(sums), same).drop("_label")
    salts = 64
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    spread = sums.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_salt_"))).drop("_label", "_salt", "_salt_")


def compress(rows: DataFrame, cfg: Codes = Codes()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of each row, and the codebooks (parts, entries, width).

    ``rows``: vec_id, label, ``v`` (an array of whole doubles) and any more columns. Nulls in ``v`` itself
    take no part; null labels are one label, rows with a null vec_id are coded like others and come last.
    The width is that of the first row by (vec_id, v) whose length the parts divide; rows of another
    length take no part. The codebooks start from the parts of the first rows in that order, fewer if
    there are fewer rows. Components beyond 2^27 are held there, sums of errors at the end of a long.
    Repeated rows count one by one. Without rows the result and the codebooks are empty.
    """
    use = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v").where((F.size("v") > 0) & (F.size("v") % cfg.parts == 0))
    order = F.asc_nulls_last("vec_id"), F.col("v")
    head = use.orderBy(*order).limit(1).collect()
    width = len(head[0]["v"]) if head else 0
    use = use.where(F.size("v") == width)
    start = use.orderBy(*order).limit(cfg.entries).select("v").collect()
    if not start:
        spark = rows.sparkSession
        return spark.createDataFrame([], "vec_id long, label long, code string, error long, label_error long"), np.zeros((cfg.parts, 0, 0), np.int64)
    held = np.clip(np.array([r["v"] for r in start]), -MOST, MOST).astype(np.int64)
    books = held.reshape(len(start), cfg.parts, width // cfg.parts).swapaxes(0, 1).copy()
    bounded = F.transform("v", lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x)))
    state, movement = packed(use.withColumn("v", bounded), "v", "int32"), None
    for _ in range(cfg.rounds):
        state = _assigned(state, cfg, books, movement)
        after = _next_books(state, cfg, books)
        books, movement = after, moved(books, after)

    def last(batch: pa.RecordBatch, x: np.ndarray, kept: Bounds | None) -> Iterator[pa.RecordBatch]:
        code = (first_bounds(x, books) if kept is None else next_bounds(x, kept, books, movement)).code
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array([blob(c).hex() for c in code]), "error": pa.array(errors(x, code, books))})

    coded = durable(state.mapInArrow(_in_chunks(cfg, books.shape[1], last), "vec_id long, label long, code string, error long"))
    return _with_label_sums(coded, cfg), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a row's code stands for."""
    return np.concatenate([books[p][e] for p, e in enumerate(bytes.fromhex(code))])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null or with null or non-finite components are left out."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("vec_id", "label", quantised(factor=256.0).alias("v"))
    coded, books = compress(rows)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_X = ", ".join(f"v[4 * p + {k + 1}] AS x{k}" for k in range(4))
_D2 = " + ".join(f"(a.x{k} - b.x{k}) * (a.x{k} - b.x{k})" for k in range(4))
_BEST = "SELECT vec_id, a.p, arg_min(e, ({d}) * 64 + e) AS e, min({d}) AS d2 FROM part a JOIN {books} b ON a.p = b.p GROUP BY vec_id, a.p"
_MEANS = "SELECT p, e, {x} FROM {books} c LEFT JOIN (SELECT p, e, {s} FROM {best} JOIN part USING (vec_id, p) GROUP BY p, e) m USING (p, e)"


def _mean(books: str, best: str) -> str:
    means = ", ".join(f"CAST(floor(sum(x{k}) / count(*)) AS BIGINT) AS m{k}" for k in range(4))
    return _MEANS.format(books=books, best=best, x=", ".join(f"coalesce(m.m{k}, c.x{k}) AS x{k}" for k in range(4)), s=means)


#: For vectors of 64 components and ids that do not repeat, as the tables have them.
ORACLE = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
part AS MATERIALIZED (SELECT vec_id, p, {_X} FROM v, (SELECT unnest(range(16)) AS p)),
c0 AS MATERIALIZED (SELECT * EXCLUDE vec_id, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM part QUALIFY e < 64),
a0 AS MATERIALIZED ({_BEST.format(d=_D2, books='c0')}), c1 AS MATERIALIZED ({_mean('c0', 'a0')}),
a1 AS MATERIALIZED ({_BEST.format(d=_D2, books='c1')}), c2 AS MATERIALIZED ({_mean('c1', 'a1')}),
a2 AS MATERIALIZED ({_BEST.format(d=_D2, books='c2')}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d2) AS BIGINT) AS error FROM a2 JOIN v USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM coded
"""
