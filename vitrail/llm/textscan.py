"""Hashes of the words and lines of many texts at once.

A polynomial prefix hash over the bytes of a tile of texts gives the hash of
any stretch in constant time; everything is whole-array arithmetic.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from vitrail.llm import arrays as A

_R = 0x5851F42D4C957F2D
_RINV = pow(_R, -1, 1 << 64)


@lru_cache(maxsize=2)
def _byte_codes(fold: bool) -> np.ndarray:
    t = A.mix(np.arange(1, 257, dtype=np.uint64), 7)
    if fold:
        t[65:91] = t[97:123]
    return t


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, r in enumerate((_R, _RINV)):
                x = np.full(n, A.U64(r))
                x[0] = 1
                _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


class Scan:
    """Texts, each with a space before it and one after the last."""

    def __init__(self, data: np.ndarray, off: np.ndarray, fold: bool):
        self.n = n = len(off) - 1
        at = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))
        self.text = text = np.full(len(data) + n + 1, 0x20, np.uint8)
        text[at + 1] = data
        self.first = off[:-1] + np.arange(n) + 1
        self.bounds = off + np.arange(n + 1)  # of the spaces before each text
        self.space = (text == 0x20) | ((text >= 9) & (text <= 13))
        power, self._inverse = _power_tables(len(text))
        with np.errstate(over="ignore"):
            self._prefix = np.cumsum(_byte_codes(fold)[text] * power[: len(text)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the stretches [start, end), start > 0."""
        with np.errstate(over="ignore"):
            raw = (self._prefix[ends - 1] - self._prefix[starts - 1]) * self._inverse[starts]
        return A.mix(raw, (ends - starts).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and n+1 offsets of the texts' words."""
        edge = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        return self.hashes(starts, ends), np.searchsorted(starts, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all \\n-split lines: hash, text index, whether it has a word."""
        cut = np.zeros(len(self.text), bool)
        cut[self.text == 10] = True
        cut[self.bounds] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1] + 1, at[1:]
        filled = np.r_[0, np.cumsum(~self.space)]
        doc = np.searchsorted(self.first, starts, side="right") - 1
        return self.hashes(starts, ends), doc, filled[ends] > filled[starts]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.r_[0, np.cumsum(values)]
        return total[self.bounds[1:]] - total[self.bounds[:-1]]
