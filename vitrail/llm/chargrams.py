"""Hashed character n-grams of whole texts, and sums of bounded vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, each stretch of other characters
    than letters being one space; a space at both ends; empty without letters."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[cp]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    cp = np.concatenate(([32], np.where(is_letter, cp, 32), [32])).astype(np.uint32)
    return cp[np.r_[True, (cp[1:] != 32) | (cp[:-1] != 32)]]


def grams(cp: np.ndarray, sizes: range, bits: int) -> np.ndarray:
    """Hashed ids, below 2**bits, of all n-grams; one entry per occurrence."""
    out = []
    c = cp.astype(np.uint64)
    for n in sizes:
        m = len(c) - n + 1
        if m <= 0:
            break
        h = np.full(m, np.uint64(n), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = (h ^ c[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
        out.append((h & np.uint64((1 << bits) - 1)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text mod 5 is 0; a row without id is held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def summed(df: DataFrame, size: int, of_batch: Callable[[pa.RecordBatch, np.ndarray], None], groups: int = 16) -> np.ndarray:
    """Sum over all rows of a vector of fixed size.

    of_batch adds a batch's rows to a vector.  Each task sends one vector, the
    `groups` second-level tasks add theirs as they stream in, and the driver
    gets `groups` vectors whatever the input."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = np.zeros(size, np.int64)
        for batch in batches:
            of_batch(batch, v)
        g = TaskContext.get().partitionId() % groups
        yield pa.record_batch([pa.array([g], pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1)])], names=["g", "v"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, any_ = np.zeros(size, np.int64), False
        for batch in batches:
            for x in batch.column(1).to_pylist():
                v += np.frombuffer(zstandard.decompress(x), np.int64)
                any_ = True
        if any_:
            yield pa.record_batch([pa.array([zstandard.compress(v.tobytes(), 1)])], names=["v"])

    parts = df.mapInArrow(leaf, "g int, v binary").repartition(groups, "g").mapInArrow(inner, "v binary").collect()
    out = np.zeros(size, np.int64)
    for (x,) in parts:
        out += np.frombuffer(zstandard.decompress(bytes(x)), np.int64)
    return out
