"""Suffix-array dedup of repeated byte strings by a distributed difference-cover algorithm.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus. Equal
strings are brought together, and only they are sorted:

1. Every window of ``length`` bytes has an *anchor*: the ``seed`` bytes in it with the least
   hash, the leftmost of equals. It depends on the window's bytes alone, so equal windows have equal
   anchors at equal offsets. Anchors that occur once anywhere cannot lie in repeated windows.
2. The text around each repeated anchor (a *piece*: all windows anchored there) goes to the partition
   of its anchor. Equal pieces are collapsed before and after the exchange, the earliest stays.
   Anchors so frequent that their pieces would swamp a partition send single windows, keyed by
   their whole content, instead.
3. In a partition the suffixes that start at the anchors, and the reversed prefixes that end there,
   are sorted as strings of 8-byte words by the difference-cover algorithm: sampled triples are
   sorted and named, the string of names is sorted by recursion, the other suffixes are merged in.
   Prefixes of adjacent suffixes are compared, which gives for every offset the groups of equal
   windows; all but the earliest are reported.
4. The reported ranges of each document are united and its bytes cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import blob, table
from panelworks.sources.durable import durable

NAME_BITS = 21  # of a name, so that a triple fits into 64 bits


@dataclass(frozen=True)
class Spans:
    length: int = 100
    seed: int = 32  # bytes of an anchor
    sieve_bits: int = 27  # bitmaps of 16 MB
    hot: int = 50_000  # occurrences of an anchor beyond which its windows travel one by one
    parts_per_shuffle_partition: int = 4
    batch: int = 100_000  # pieces sorted at a time
    flush: int = 1 << 18  # pieces a task holds before it collapses and sends them


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by the difference cover {1, 2} modulo 3; symbols from 1 to 2**21 - 1, as many at most."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    bits = np.uint64(NAME_BITS)
    t = np.zeros(n + 3, np.uint64)
    t[:n] = text
    sample = np.arange(n + (n % 3 == 1))
    sample = sample[sample % 3 != 0]
    sample = np.concatenate([sample[sample % 3 == 1], sample[sample % 3 == 2]])
    triples = (t[sample] << (bits + bits)) | (t[sample + 1] << bits) | t[sample + 2]
    order = np.argsort(triples, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = triples[order[1:]] != triples[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(names)
    sampled = sample[order]
    rank = np.zeros(n + 3, np.uint64)
    rank[sampled] = np.arange(1, len(sampled) + 1, dtype=np.uint64)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    by_one = (t[rest] << bits) | rank[rest + 1]
    order = np.argsort(by_one, kind="stable")
    rest, by_one = rest[order], by_one[order]
    by_two = (t[rest] << (bits + bits)) | (t[rest + 1] << bits) | rank[rest + 2]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((t[ones] << bits) | rank[ones + 1], by_one)
    before += np.searchsorted((t[twos] << (bits + bits)) | (t[twos + 1] << bits) | rank[twos + 2], by_two)
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = sampled
    return out


def sorted_strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (rows of one width) by the suffix array of them all, and each one's common prefix with the one before."""
    n, width = rows.shape
    words = -(-max(width, 1) // 8)
    padded = np.zeros((n, 8 * words), np.uint8)
    padded[:, :width] = rows
    symbols = np.unique(padded.view(">u8").astype(np.uint64), return_inverse=True)[1].reshape(n, words) + n + 1
    text = np.concatenate([symbols, np.arange(1, n + 1)[:, None]], 1).ravel()  # a separator of its own ends each string
    order = suffix_array(text)
    order = order[order % (words + 1) == 0] // (words + 1)
    differs = padded[order[1:]] != padded[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), width) if n > 1 else np.zeros(0, np.int64)
    return order, np.concatenate([[0], common])


def seed_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each byte on."""
    level = K.mix(data.astype(np.uint64) + np.uint64(1))
    factor, span, out, done = 0xD6E8FEB86659FD93, 1, None, 0
    while True:
        if size & span:
            if out is None:
                out, done = level.copy(), span
            else:
                n = len(data) - done - span + 1
                out = out[:n] * np.uint64(pow(factor, span, 1 << 64)) + level[done : done + n]
                done += span
        if 2 * span > size:
            return K.mix(out)
        n = len(data) - 2 * span + 1
        level = level[:n] * np.uint64(pow(factor, span, 1 << 64)) + level[span : span + n]
        span *= 2


def anchored(data: np.ndarray, at: np.ndarray, spans: Spans) -> dict[str, np.ndarray]:
    """Pieces of a chunk: owner text, anchor position and hash, first and last window start (positions in the chunk)."""
    none = np.zeros(0, np.int64)
    n = len(data) - spans.length + 1
    if n <= 0:
        return {"owner": none, "anchor": none, "key": none.astype(np.uint64), "first": none, "last": none}
    hashes = seed_hashes(data, spans.seed)
    low = np.uint64((1 << 30) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = spans.length - spans.seed + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least[:n] & low).astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(owner[:n] == owner[spans.length - 1 :][:n])
    if not len(starts):
        return {"owner": none, "anchor": none, "key": none.astype(np.uint64), "first": none, "last": none}
    own = anchor[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(fresh)
    first, last = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    return {"owner": owner[first], "anchor": own[begin], "key": hashes[own[begin]], "first": first, "last": last}


def _count_anchors(spans: Spans, parts: int):
    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        part = ((keys >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        to, begin = np.unique(part[order], return_index=True)
        cut = lambda x: [blob(p) for p in np.split(x[order], begin[1:])] if len(to) else []
        return pa.RecordBatch.from_pydict({"part": pa.array(to), "keys": pa.array(cut(keys), pa.binary()), "counts": pa.array(cut(n.astype(np.uint32)), pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, at in K.chunks(batch.column("text")):
                held.append(anchored(data, at, spans)["key"])
                size += len(held[-1])
                if size > 1 << 20:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return run


def _bits(spans: Spans):
    """Group: words of the two bitmaps (0: repeated anchors, 1: hot ones) that a part's anchors set."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(group["keys"]), np.uint64)
        counts = np.frombuffer(b"".join(group["counts"]), np.uint32)
        found, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, counts)
        out = []
        for level, least in ((0, 2), (1, spans.hot)):
            spot = _spots(found[total >= least], spans).ravel()
            words, at = np.unique(spot >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (spot & np.uint64(63)))
            out.append(pd.DataFrame({"level": np.full(len(words), level, np.int32), "word": words.astype(np.int64), "bits": bits.view(np.int64)}))
        return pd.concat(out)

    return run


def _spots(keys: np.ndarray, spans: Spans) -> np.ndarray:
    """Two bits of a bitmap for each key."""
    return np.stack([keys, K.mix(keys)]) >> np.uint64(64 - spans.sieve_bits)


def _passes(bitmap: np.ndarray, keys: np.ndarray, spans: Spans) -> np.ndarray:
    spot = _spots(keys, spans)
    return ((bitmap[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1)).all(0)


PIECE = [("doc", np.int64), ("twin", np.uint32), ("start", np.uint32), ("left", np.uint8), ("low", np.uint8), ("high", np.uint8), ("alone", np.uint8)]


class Pieces:
    """Columns of pieces: document, start in it, bytes before the anchor, offsets low..high of its windows, whether a window of a hot anchor; and the bytes in rows."""

    def __init__(self, columns: dict[str, np.ndarray], rows: np.ndarray):
        self.columns, self.rows = columns, rows

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces({k: v[at] for k, v in self.columns.items()}, self.rows[at])

    @staticmethod
    def join(parts: list[Pieces]) -> Pieces:
        return Pieces({k: np.concatenate([p.columns[k] for p in parts]) for k, _ in PIECE}, np.concatenate([p.rows for p in parts]))

    def keys(self, spans: Spans) -> np.ndarray:
        """A hash of what pieces must share to be compared: the anchor, or all bytes for the windows of hot anchors."""
        at = self.columns["left"].astype(np.int64)[:, None] + np.arange(spans.seed)
        return np.where(self.columns["alone"], _row_hash(self.rows)[0], _row_hash(np.take_along_axis(self.rows, at, 1))[0])

    def __len__(self) -> int:
        return len(self.rows)


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes with ``size`` bytes from ``begin`` on, zeros after."""
    step = np.arange(width)
    rows = data[np.minimum(begin[:, None] + step, len(data) - 1)]
    rows[step >= size[:, None]] = 0
    return rows


def _row_hash(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row."""
    pad = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    pad[:, : rows.shape[1]] = rows
    a, b = np.full(len(rows), 17, np.uint64), np.full(len(rows), 91, np.uint64)
    for word in pad.view(np.uint64).T:
        a = K.mix(a * np.uint64(0xD6E8FEB86659FD93) + word)
        b = K.mix(b * np.uint64(0xA0761D6478BD642F) ^ word)
    return a, b


def collapse(pieces: Pieces) -> tuple[Pieces, Pieces]:
    """Of equal pieces (same bytes around the anchor, same windows) the earliest, and all others."""
    c = pieces.columns
    a, b = _row_hash(pieces.rows)
    shape = c["left"].astype(np.uint64) << np.uint64(16) | c["low"].astype(np.uint64) << np.uint64(8) | c["high"].astype(np.uint64)
    a = K.mix(a ^ K.mix(shape + np.uint64(1)))
    order = np.lexsort((c["start"], c["doc"], b, a))
    head = np.ones(len(order), bool)
    head[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    same = (c["doc"][order] == c["doc"][lead]) & (c["start"][order] == c["start"][lead])  # rows that repeat a doc_id are no earlier than each other
    return pieces.take(order[same]), pieces.take(order[~same])


def _ranges(doc: np.ndarray, twin: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Ranges of window starts, packed by document, those that touch joined."""
    order = np.lexsort((first, twin, doc))
    doc, twin, first, last = doc[order], twin[order], first[order], last[order]
    if len(doc):
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (first[1:] > last[:-1] + 1)
        begin = np.flatnonzero(fresh)
        last = np.maximum.reduceat(last, begin)
        doc, twin, first = doc[begin], twin[begin], first[begin]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])
        begin = np.flatnonzero(fresh)
        packed = [blob(x) for x in np.split(np.stack([first, last], 1), begin[1:])]
        doc, twin = doc[begin], twin[begin]
    else:
        packed = []
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc), "twin": pa.array(twin), "ranges": pa.array(packed, pa.binary())})


def _windows(pieces: Pieces, spans: Spans) -> tuple[np.ndarray, ...]:
    """Document and range of window starts of whole pieces."""
    c = pieces.columns
    left, low, high = (c[k].astype(np.int64) for k in ("left", "low", "high"))
    return c["doc"], c["twin"].astype(np.int64), c["start"].astype(np.int64) + left - high, c["start"].astype(np.int64) + left - low


def _send_pieces(spans: Spans, parts: int, sieves):
    """Task: pieces of repeated anchors, packed by part; ranges of those that repeat an earlier one of the task, spread over the parts."""

    def packed(held: list[Pieces]) -> Iterator[pa.RecordBatch]:
        first, others = collapse(Pieces.join(held))
        empty = pa.nulls(0, pa.binary())
        done = _ranges(*_windows(others, spans))
        n = done.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.asarray(done.column("twin")) % parts), "doc_id": done.column("doc_id"), "twin": done.column("twin"), "ranges": done.column("ranges"), "body": pa.nulls(n, pa.binary()) if n else empty})
        keys = first.keys(spans)
        part = ((keys >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((keys, part))
        to, begin = np.unique(part[order], return_index=True)
        bodies = []
        for own in np.split(order, begin[1:]):
            p = first.take(own)
            raw = len(own).to_bytes(8, "little") + b"".join(blob(p.columns[k]) for k, _ in PIECE) + blob(p.rows)
            bodies.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
        m = len(to)
        yield pa.RecordBatch.from_pydict({"part": pa.array(to), "doc_id": pa.array(np.zeros(m, np.int64)), "twin": pa.array(np.zeros(m, np.int64)), "ranges": pa.nulls(m, pa.binary()), "body": pa.array(bodies if m else [], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = sieves.value
        held, size, width = [], 0, 2 * spans.length - spans.seed
        for batch in batches:
            ids, twins = np.asarray(batch.column("doc_id")), np.asarray(batch.column("twin"))
            for lo, _, data, at in K.chunks(batch.column("text")):
                found = anchored(data, at, spans)
                use = _passes(repeated, found["key"], spans)
                owner, anchor, key, first, last = (found[k][use] for k in ("owner", "anchor", "key", "first", "last"))
                single = _passes(hot, key, spans)
                for alone in (False, True):
                    own = np.flatnonzero(single == alone)
                    if alone:
                        counts = last[own] - first[own] + 1
                        own = np.repeat(own, counts)
                        begin = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
                        end = begin
                    else:
                        begin, end = first[own], last[own]
                    if not len(own):
                        continue
                    rows = _gather(data, begin, end + spans.length - begin, width)
                    columns = {"doc": ids[lo + owner[own]], "twin": twins[lo + owner[own]].astype(np.uint32), "start": (begin - at[owner[own]]).astype(np.uint32), "left": (anchor[own] - begin).astype(np.uint8), "low": (anchor[own] - end).astype(np.uint8), "high": (anchor[own] - begin).astype(np.uint8), "alone": np.full(len(own), alone, np.uint8)}
                    held.append(Pieces(columns, rows))
                    size += len(own)
                if size >= spans.flush:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    return run


def equal_windows(pieces: Pieces, spans: Spans) -> tuple[np.ndarray, ...]:
    """Document and start of every window of distinct pieces that equals an earlier one among them."""
    c = pieces.columns
    left, low, high = (c[k].astype(np.int64) for k in ("left", "low", "high"))
    place = np.lexsort((c["start"].astype(np.int64) + left, c["doc"]))
    pieces = pieces.take(place)
    c, left, low, high = pieces.columns, left[place], low[place], high[place]
    n, most = len(pieces), spans.length - spans.seed
    if n < 2:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchor = c["start"].astype(np.int64) + left
    spot = np.cumsum(np.concatenate([[1], (c["doc"][1:] != c["doc"][:-1]) | (anchor[1:] != anchor[:-1])]))
    size = left + spans.length - low
    after = _gather(pieces.rows.ravel(), np.arange(n) * pieces.rows.shape[1] + left, size - left, spans.length)
    step = np.arange(most)
    before = np.take_along_axis(pieces.rows, np.maximum(left[:, None] - 1 - step, 0), 1)
    before[step >= left[:, None]] = 0
    order_r, common_r = sorted_strings(after)
    order_l, common_l = sorted_strings(before)
    docs, twins, starts = [], [], []
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= offset) & (high >= offset))
        if len(own) < 2:
            continue
        class_r[order_r] = np.cumsum(common_r < spans.length - offset)
        class_l[order_l] = np.cumsum(common_l < offset) if offset else 1
        both = class_r[own] * (n + 1) + class_l[own]
        order = np.argsort(both, kind="stable")  # pieces are in order of place already
        both = both[order]
        head = np.ones(len(order), bool)
        head[1:] = both[1:] != both[:-1]
        lead = own[order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]]
        hit = own[order[spot[own[order]] > spot[lead]]]
        docs.append(c["doc"][hit]), twins.append(c["twin"][hit].astype(np.int64)), starts.append(anchor[hit] - offset)
    docs, twins, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, twins, starts))
    return docs, twins, starts, starts


def _sort_part(spans: Spans):
    """Group: ranges of repeated windows among a part's pieces."""
    width = 2 * spans.length - spans.seed

    def unpack(body: bytes) -> Pieces:
        raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
        n, at, columns = int.from_bytes(raw[:8], "little"), 8, {}
        for name, kind in PIECE:
            columns[name] = np.frombuffer(raw, kind, n, at)
            at += columns[name].nbytes
        return Pieces(columns, np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ready, bodies = group.loc[group["body"].isna(), ["doc_id", "twin", "ranges"]], group["body"].dropna()
        if not len(bodies):
            return ready
        first, others = collapse(Pieces.join([unpack(b) for b in bodies]))
        found = [_windows(others, spans)]
        keys = first.keys(spans)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
        lo = 0
        while lo < len(keys):  # whole keys, about a batch of pieces at a time
            hi = int(edges[max(np.searchsorted(edges, lo + spans.batch, "right") - 1, np.searchsorted(edges, lo, "right"))])
            found.append(equal_windows(first.take(order[lo:hi]), spans))
            lo = hi
        return pd.concat([ready, _ranges(*(np.concatenate(x) for x in zip(*found, strict=True))).to_pandas()])

    return run


def repeated_ranges(rows: DataFrame, spans: Spans = Spans()) -> DataFrame:
    """(doc_id, twin, ranges): ranges of starts of windows that also start earlier, packed as pairs of 64-bit integers."""
    spark = rows.sparkSession
    parts = spans.parts_per_shuffle_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select("text").mapInArrow(_count_anchors(spans, parts), "part long, keys binary, counts binary")
    words = counted.groupBy("part").applyInPandas(_bits(spans), "level int, word long, bits long").groupBy("level", "word").agg(F.bit_or("bits").alias("bits"))
    words = durable(words).toArrow()  # the anchors' exchange is over and released before the pieces' begins
    bitmaps = np.zeros((2, 1 << (spans.sieve_bits - 6)), np.int64)  # of a fixed size, however much is repeated
    bitmaps[words.column("level").to_numpy(), words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sieves = spark.sparkContext.broadcast(tuple(bitmaps.view(np.uint64)))
    sent = rows.mapInArrow(_send_pieces(spans, parts, sieves), "part long, doc_id long, twin long, ranges binary, body binary")
    return sent.groupBy("part").applyInPandas(_sort_part(spans), "doc_id long, twin long, ranges binary")


def _cut(spans: Spans, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.utf8(batch.column("text"))
            n = batch.num_rows
            sizes, gone, runs, digests, texts = np.diff(at), np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for i, packed in enumerate(batch.column("ranges").to_pylist()):
                own = data[at[i] : at[i + 1]]
                if packed:
                    ranges = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
                    steps = np.zeros(len(own) + 1, np.int32)
                    np.add.at(steps, ranges[:, 0], 1)
                    np.add.at(steps, ranges[:, 1] + spans.length, -1)
                    cut = np.cumsum(steps[:-1]) > 0
                    gone[i] = cut.sum()
                    runs[i] = (cut[1:] & ~cut[:-1]).sum() + cut[0]
                    own = own[~cut]
                digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                if with_text:
                    texts.append(own.tobytes().decode("utf-8", "ignore"))
            columns = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes), "n_removed": pa.array(gone), "n_spans": pa.array(runs), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return run


def dedup_spans(documents: DataFrame, spans: Spans = Spans(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with the text that is left on request.

    Null texts count as empty. Rows that share a doc_id are one document with several texts: what
    starts at the same byte of two of them is no earlier in either, so exact repeats of a row are
    treated alike. Rows without a doc_id stay whole and repeat nothing. The kept text may lack bytes
    of characters that a cut went through; the digest is of the exact bytes.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("twin", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    found = durable(repeated_ranges(rows.where("doc_id is not null"), spans))  # likewise the pieces' before the texts'
    ranges = found.groupBy("doc_id", "twin").agg(F.collect_list("ranges").alias("ranges"))
    joined = rows.join(ranges, ["doc_id", "twin"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(_cut(spans, with_text), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
