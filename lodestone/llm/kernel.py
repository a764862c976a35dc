"""Vectorised byte-level text kernels (numpy) shared by the operators.

Texts are handled as UTF-8 bytes. Words are ``[^\\x20\\x09-\\x0D]+`` after
A-Z is lower-cased; every separator is ASCII, so bytes and characters agree.

Defined results: a null text is an empty one; an empty text has no words, no
shingles and no features; a text longer than a slice stands alone in one; no
rows give empty arrays.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None
if not hasattr(_libc, "malloc_trim"):
    _libc = None
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_SHINGLE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes hashed at once; bounds the kernel's memory whatever a text's length.
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64))


def _power(base: U64, n: int) -> np.ndarray:
    key = hex(int(base))
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def tidy() -> None:
    """Give memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def small_batches(spark, most: int = 8 << 20) -> None:
    """From now on, batches that go to Python hold so many bytes at most, in the executor's and the worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut batches so that the column holds about ``max_bytes``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    tidy()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; the spans must not overlap and be in order."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        n = int(e[-1])
        part = data[base : base + n]
        value = _BYTE[LOWER[part] if lower else part]
        value *= _power(_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        out[at:to] = mix((total[e] - total[s]) * _power(_BASE_INVERSE, n + 1)[s] + (e - s).astype(np.uint64) * U64(0xA0761D6478BD642F))
        at = to
    return out


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive 64-bit values (len - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, U64(k * 0xE7037ED1A0B428DB % 2**64))
    for t in range(k):
        total += values[t : t + n] * _SHINGLE[t]
    return mix(total)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as sorted 64-bit hashes, and the row offsets.

    A row with fewer than k words has its whole sequence as one shingle; a row
    without words has none.
    """
    starts, ends, row = words(data, offs)
    hashes = span_hashes(data, starts, ends)
    rows = len(offs) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    every = window_hashes(hashes, k)
    out, size = [], np.zeros(rows + 1, np.int64)
    for i in range(rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            h = np.sort(every[a : b - k + 1])
            if len(h) > 1:
                h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        elif b > a:
            h = window_hashes(hashes[a:b], b - a)
        else:
            continue
        out.append(h)
        size[i + 1] = len(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(size)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of start .. start + size - 1."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)
