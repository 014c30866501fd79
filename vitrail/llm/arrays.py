"""Array helpers shared by the operators: UTF-8 views of Arrow columns, tiles
of documents, 64-bit mixing, and blob exchange between partitions.

Blob exchange: many small fixed-width records travel as one binary row per
destination bucket, so a shuffle moves a few large rows instead of millions of
small ones.  A bucket is a function of the record's own key only, hence a
retried task sends the same records to the same place.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
C1 = U64(0x9E3779B97F4A7C15)
C2 = U64(0xC2B2AE3D27D4EB4F)
C3 = U64(0xFF51AFD7ED558CCD)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, buffers = len(column), column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def groups_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with about `limit` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(a: np.ndarray, b: np.ndarray | np.uint64 | int = 0) -> np.ndarray:
    """A 64-bit hash of the pairs (a, b)."""
    if not isinstance(b, np.ndarray):
        b = U64(b)
    with np.errstate(over="ignore"):
        x = a * C1 + b * C2
        x ^= x >> U64(32)
        x *= C3
        x ^= x >> U64(29)
    return x


def pack(*columns: np.ndarray) -> bytes:
    """64-bit columns as one compressed blob."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    flat = np.frombuffer(raw, np.int64)
    return list(flat.reshape(n_columns, -1))


def unpack_all(blobs: list[bytes], n_columns: int) -> list[np.ndarray]:
    if not blobs:
        return [np.zeros(0, np.int64) for _ in range(n_columns)]
    parts = [unpack(b, n_columns) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts)]


def dealt(bucket: np.ndarray, n_buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for every bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    for k in np.flatnonzero(np.diff(ends)):
        s = slice(ends[k], ends[k + 1])
        yield int(k), pack(*[c[s] for c in columns])


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def taken(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices data[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return data[:0]
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal disjoint ones (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[new], ends[np.r_[new[1:] - 1, len(ends) - 1]]


def merged_by(group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`merged` within each group of (non-negative) ids, for all groups at once."""
    if not len(group):
        return group, starts, ends
    ids, g = np.unique(group, return_inverse=True)
    width = int(ends.max()) + 2
    s, e = merged(starts + g * width, ends + g * width)
    g = s // width
    return ids[g], s - g * width, e - g * width
