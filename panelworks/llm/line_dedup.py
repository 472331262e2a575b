"""Line dedup: fuzzy lines by MinHash, one line kept per component of similar lines.

Lines are compared by sets of character shingles (A-Z lower-cased, white space all alike). A first
pass computes band keys and sends them, packed into arrays, to the partition of their bucket;
buckets with two different lines give candidates, which are verified on their exact sets and united
(see ``linking``). Of every component, and of every group of equal lines, the first line by
(doc_id, line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import blob, table
from panelworks.llm.linking import Similarity, band_keys, linked, signatures
from panelworks.sources.durable import durable

CHUNK = K.CHUNK // 16  # arrays over a chunk stay in a core's cache
NORMAL = np.where(K.WHITESPACE, np.uint8(32), K.LOWER)
_SHOWN = NORMAL.tobytes()
SIEVE_BITS = 25  # a bitmap of 4 MB


@dataclass(frozen=True)
class Lines:
    width: int = 8  # characters in a shingle, a power of two
    similarity: Similarity = field(default_factory=lambda: Similarity(percent=80, band_miss=1e-3, verify_miss=None))
    parts_per_shuffle_partition: int = 4
    hot: int = 1000  # lines of a bucket in one task beyond which they are candidates at once
    flush: int = 1 << 18  # packed entries a task holds
    remembered: int = 1 << 17  # lines a task has sent that it still knows


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the \\n-split lines of a chunk, and the bounds of each text's lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, at[1:]]))
    upto = np.searchsorted(breaks, at) + np.arange(len(at))
    return starts, ends, upto


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each line's content, white space at its end left out; 0 for blank lines and no others."""
    text = data.tobytes().translate(_SHOWN)
    parts = [text[a:b].rstrip() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.fromiter((xxh3_64_intdigest(x) or 1 if x else 0 for x in parts), np.uint64, len(parts))


def solid_lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that are not blank: starts, ends, place among all lines of the chunk, key; and the bounds of each text's lines."""
    starts, ends, upto = line_spans(data, at)
    keys = line_keys(data, starts, ends)
    some = np.flatnonzero(keys)
    return starts[some], ends[some], some, keys[some], upto


def line_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines in a row, and where each line's begin; a line shorter than a shingle has its key alone.

    Lines stand in the order of their starts and do not overlap; none is empty.
    """
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = ends - starts
    if 2 * sizes.sum() < len(data):  # only what the lines have is hashed
        data = np.concatenate([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        ends = np.cumsum(sizes)
        starts = ends - sizes
    shown = data.tobytes().translate(_SHOWN)
    first, last = starts, ends
    points = text = np.frombuffer(shown, np.uint8)
    if not shown.isascii():
        found = np.frombuffer(shown.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.cumsum((text & 0xC0) != 0x80, dtype=np.int32)
        if lead[-1] == len(found):  # else malformed text; bytes count as characters
            upto = np.concatenate([[0], lead])
            points, first, last = found, upto[starts].astype(np.int64), upto[ends].astype(np.int64)
    rolled = points.astype(np.uint64)
    rolled += np.uint64(1)
    rolled *= np.uint64(0x9E3779B97F4A7C15)
    rolled ^= rolled >> np.uint64(31)
    n, span, factor = len(rolled), 1, 0xD6E8FEB86659FD93
    while span < width:
        longer = rolled * np.uint64(factor)
        longer[: n - span] += rolled[span:]
        rolled, span, factor = longer, 2 * span, factor * factor % (1 << 64)
    short = last - first < width
    counts = np.where(short, 1, last - first - width + 1)
    flat = np.concatenate([rolled[a:b] for a, b in zip(first.tolist(), (first + counts).tolist(), strict=True)])
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    flat[begin[short]] = keys[short]
    flat ^= flat >> np.uint64(32)
    flat *= np.uint64(0xFF51AFD7ED558CCD)
    return flat, begin


def _list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: key and place of every line that is not blank."""
    for batch in batches:
        for lo, hi, data, at in K.chunks(batch.column("text"), CHUNK):
            _, _, place, keys, upto = solid_lines(data, at)
            owner = np.searchsorted(upto, place, "right") - 1
            take = pa.array(owner + lo)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "doc_id": batch.column("doc_id").take(take), "twin": batch.column("twin").take(take), "line": pa.array(place - upto[owner])})


ENTRY = np.dtype([("bucket", np.uint32), ("key", np.uint64)])
READY = np.dtype([("bucket", np.uint64), ("key", np.uint64)])


def _pack(lines: Lines, parts: int):
    """Task: (part, ready, entries); entries are packed (bucket, key) pairs, ready if known to share their bucket.

    Within a part the upper 32 bits tell buckets apart; the part itself comes from the lower ones.
    """

    def packed(buckets: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(buckets)  # a key that a bucket has twice, which is rare, is told by the bucket's own task
        buckets, keys = buckets[order], keys[order]
        edge = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        sizes = np.diff(np.append(edge, len(buckets)))
        hot = np.repeat(sizes > lines.hot, sizes)
        lead = np.zeros(len(buckets), bool)
        lead[edge] = True
        part = (buckets & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        for ready, own in ((False, np.flatnonzero(~hot | lead)), (True, np.flatnonzero(hot))):
            where = (K.mix(keys[own] ^ buckets[own]) >> np.uint64(20)) % np.uint64(parts) if ready else part[own]
            where = where.astype(np.uint16 if parts <= 1 << 16 else np.uint32)
            order = np.argsort(where, kind="stable")
            own, where = own[order], where[order]
            pairs = np.empty(len(own), READY if ready else ENTRY)
            pairs["bucket"] = buckets[own] >> np.uint64(32) << np.uint64(32) | part[own] if ready else buckets[own] >> np.uint64(32)
            pairs["key"] = keys[own]
            to, begin = np.unique(where, return_index=True)
            yield pa.RecordBatch.from_pydict({"part": pa.array(to.astype(np.int64)), "ready": pa.array(np.full(len(to), ready)), "entries": pa.array([blob(p) for p in np.split(pairs, begin[1:])] if len(to) else [], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, at in K.chunks(batch.column("text"), CHUNK):
                starts, ends, _, keys, _ = solid_lines(data, at)
                own = [i for i, key in enumerate(keys.tolist()) if key not in seen and not seen.add(key)]
                if len(seen) > lines.remembered:
                    seen.clear()
                if not own:
                    continue
                starts, ends, keys = starts[own], ends[own], keys[own]
                flat, begin = line_shingles(data, starts, ends, keys, lines.width)
                bands = band_keys(signatures(flat, begin, lines.similarity.rows * lines.similarity.bands), lines.similarity)
                held.append((bands.view(np.uint64).ravel(), np.repeat(keys, bands.shape[1])))
                if sum(len(b) for b, _ in held) >= lines.flush:
                    yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
        if held:
            yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Group: of one part's entries, those in buckets with two keys or more."""
    part = np.uint64(group["part"].iloc[0])
    pairs = np.frombuffer(b"".join(group.loc[~group["ready"], "entries"]), ENTRY)
    order = np.argsort(pairs["bucket"])
    pairs = pairs[order]
    same = pairs["bucket"][1:] == pairs["bucket"][:-1]
    pairs = pairs[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(pairs) else pairs  # most lines are alone in most of their buckets
    pairs = pairs[np.lexsort((pairs["key"], pairs["bucket"]))]
    buckets, keys = pairs["bucket"].astype(np.uint64) << np.uint64(32) | part, pairs["key"]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (buckets[1:] != buckets[:-1]) | (keys[1:] != keys[:-1])
    buckets, keys = buckets[fresh], keys[fresh]
    same = buckets[1:] == buckets[:-1]
    use = np.zeros(len(keys), bool)
    use[1:] |= same
    use[:-1] |= same
    ready = np.frombuffer(b"".join(group.loc[group["ready"], "entries"]), READY)
    return pd.DataFrame({"bucket": np.concatenate([buckets[use], ready["bucket"]]).view(np.int64), "id": np.concatenate([keys[use], ready["key"]]).view(np.int64)})


def _profile(lines: Lines, sieve):
    """Task: key, band keys and content of each line whose key passes the sieve; repeats soon after are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sieve.value, set()
        for batch in batches:
            for _, _, data, at in K.chunks(batch.column("text"), 8 * CHUNK):  # few of its lines are hashed
                starts, ends, _, keys, _ = solid_lines(data, at)
                spot = keys >> np.uint64(64 - SIEVE_BITS)
                use = np.flatnonzero((bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1))
                use = [i for i in use if keys[i] not in seen and not seen.add(keys[i])]
                if len(seen) > lines.remembered:
                    seen.clear()
                if use:
                    flat, begin = line_shingles(data, starts[use], ends[use], keys[use], lines.width)
                    bands = band_keys(signatures(flat, begin, lines.similarity.rows * lines.similarity.bands), lines.similarity)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(keys[use].view(np.int64)), "bands": pa.array([blob(b) for b in bands], pa.binary()), "body": pa.array([blob(data[starts[i] : ends[i]]) for i in use], pa.binary())})

    return run


def _expand(lines: Lines):
    """Shingle sets of lines given by their content."""

    def run(bodies: pa.Array) -> list[np.ndarray]:
        data, at = K.utf8(bodies)
        keys = line_keys(data, at[:-1], at[1:])
        flat, begin = line_shingles(data, at[:-1], at[1:], keys, lines.width)
        edges = np.append(begin, len(flat))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            flat[lo:hi].sort()
        fresh = np.ones(len(flat), bool)
        fresh[1:] = flat[1:] != flat[:-1]
        fresh[begin] = True
        upto = np.concatenate([[0], np.cumsum(fresh)])[edges]
        flat = flat[fresh]
        return [flat[lo:hi] for lo, hi in zip(upto[:-1], upto[1:], strict=True)]

    return run


def bitmap(ids: DataFrame) -> np.ndarray:
    """One bit for the upper bits of each id; of a fixed size, however many ids there are."""
    spots = ids.select(F.shiftrightunsigned("id", 64 - SIEVE_BITS).alias("spot"))
    words = spots.groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def removed_lines(documents: DataFrame, lines: Lines = Lines()) -> DataFrame:
    """(doc_id, twin, removed): for each document that loses lines, their numbers from 0.

    ``documents``: doc_id, twin (a hash of the text, telling apart rows that share a doc_id), text.
    """
    spark = documents.sparkSession
    documents = documents.where("doc_id is not null and text is not null")
    listed = durable(documents.mapInArrow(K.lean(_list_lines), "key long, doc_id long, twin long, line long"))
    n = listed.count()
    parts = lines.parts_per_shuffle_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select("text")
    hits = texts.mapInArrow(K.lean(_pack(lines, parts)), "part long, ready boolean, entries binary").groupBy("part").applyInPandas(_shared, "bucket long, id long").distinct()

    def profile(ids: DataFrame) -> DataFrame:
        ids = durable(ids)
        sieve = spark.sparkContext.broadcast(bitmap(ids))
        return texts.mapInArrow(K.lean(_profile(lines, sieve)), "id long, bands binary, body binary").join(ids, "id", "left_semi").dropDuplicates(["id"])

    labels = linked(hits, profile, lines.similarity, _expand(lines)).select(F.col("id").alias("key"), "label")
    counts = listed.groupBy("key").agg(F.count("*").alias("n"))
    met = durable(counts.join(labels, "key", "left").where("n > 1 or label is not null").select("key", F.coalesce("label", "key").alias("label")), n)
    places = durable(listed.join(met, "key").select("label", F.struct("doc_id", "twin", "line").alias("place")), n)
    kept = places.groupBy("label").agg(F.min("place").alias("kept"))
    gone = places.join(kept, "label").where("place <> kept")
    return gone.groupBy("place.doc_id", "place.twin").agg(F.sort_array(F.collect_set("place.line")).alias("removed"))


def _cut(text_at: int, chars_at: int | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            removed = columns.pop()
            hit = np.flatnonzero(removed.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                texts = columns[text_at].to_pylist()
                sizes = columns[chars_at].to_pylist() if chars_at is not None else None
                for i in hit:
                    parts, drop = texts[i].split("\n"), set(removed[i].as_py())
                    texts[i] = "\n".join([x for k, x in enumerate(parts) if k not in drop])
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if sizes is not None:
                    columns[chars_at] = pa.array(sizes, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_lines(documents: DataFrame, lines: Lines = Lines(), extra: bool = False) -> DataFrame:
    """``documents`` with repeated lines taken out of the texts; ``n_chars``, if there, follows.

    Of each component of similar lines the first by (doc_id, line number) stays. Blank lines stay.
    Null and empty texts, and rows without a doc_id, stay as they are; rows equal in doc_id and text
    count as one document. No row is dropped: a document may end with an empty text. Line keys have
    64 bits, so among N different lines about N**2 / 2**65 pairs are taken for equal by mistake.
    With ``extra`` a column ``_removed`` lists the numbers of the lines taken out.
    """
    names = documents.columns
    spine = documents.toDF(*[f"c{k}" for k in range(len(names))])
    at = {n: k for k, n in enumerate(names)}
    doc, text = F.col(f"c{at['doc_id']}"), F.col(f"c{at['text']}")
    keyed = spine.withColumn("_doc", doc.cast("long")).withColumn("_twin", F.xxhash64(text))
    gone = removed_lines(keyed.select(F.col("_doc").alias("doc_id"), F.col("_twin").alias("twin"), text.alias("text")), lines)
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("twin").alias("_twin"), F.col("removed").alias("_removed"))
    joined = keyed.join(gone, ["_doc", "_twin"], "left").select(*spine.columns, "_removed")
    columns = [*spine.columns, *[F.col("_removed").alias("_shown")] * extra]
    shown = joined.select(*columns)
    cut = _cut(at["text"], at.get("n_chars"), shown.columns)
    return joined.select(*columns, "_removed").mapInArrow(K.lean(cut), shown.schema).toDF(*names, *["_removed"] * extra)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of lines removed and the SHA-256 of the text that is left."""
    done = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), extra=True)
    n_removed = F.coalesce(F.array_size("_removed"), F.lit(0)).cast("long")
    return done.select("doc_id", n_removed.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
