"""Vectorised passes over Arrow string columns: words, hashes and byte histograms of many texts at once.

Everything works on the UTF-8 bytes of whole texts. A *chunk* is a run of whole texts of about
``CHUNK`` bytes (one longer text is a chunk of its own), so temporary arrays stay small.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_CODE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODE[WHITESPACE] = 0
_MULT = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The task ``run``, giving free memory back at its end: Python workers outlive their tasks, and what one stage needed at most would be held through all later ones."""

    def task(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64, at least ``n`` of each."""
    size = max(CHUNK, 1 << max(n - 1, 1).bit_length())
    if size > 4 * CHUNK:
        _powers.pop(size, None)
    if size not in _powers:
        pair = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            pair.append(np.multiply.accumulate(run))
        if size > 4 * CHUNK:
            return pair[0], pair[1]
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of whole texts."""
    data, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the bounds of each text's words in them."""
    solid = ~WHITESPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:] = solid[:-1]
        before[at[:-1][at[:-1] < n]] = False
        after[:-1] = solid[1:]
        after[at[1:] - 1] = False
        after[-1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.add.reduceat(_CODE[data] * up[: len(data)], starts)
    return mix(sums * down[starts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` successive words, from every word on that has so many after it."""
    n = max(len(words) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : k + n]
    return mix(out)


def byte_histograms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of the 256 byte values in each text."""
    n = len(at) - 1
    out = np.empty((n, 256), np.int64)
    for i in range(n):
        out[i] = np.bincount(data[at[i] : at[i + 1]], minlength=256)
    return out


def repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    if len(values) < 2:
        return np.zeros(len(values), bool)
    order = np.argsort(values, kind="stable")
    run = values[order]
    same = run[1:] == run[:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def covered(hits: np.ndarray, width: int, length: int) -> int:
    """Positions below ``length`` that lie in a window of ``width`` starting at a hit."""
    steps = np.zeros(length + 1, np.int64)
    where = np.flatnonzero(hits)
    steps[where] += 1
    steps[np.minimum(where + width, length)] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())
