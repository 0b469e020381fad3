"""Numpy kernels over the bytes of many texts at once: words, word hashes, windows.

All functions work on slices of a few megabytes, so memory follows the longest
single text and not the batch.  UTF-8 keeps bytes below 128 for ASCII alone, so
white space, symbols and letters A-Z can be told apart byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
#: Multipliers that make the hash of a window depend on the order of its words.
_STEP = 0xD6E8FEB86659FD93 | 1

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = [_powers(_MUL, SLICE), _powers(_INV, SLICE)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) > n:
        return _POW[0], _POW[1]
    return _powers(_MUL, n), _powers(_INV, n)


@dataclass
class Texts:
    """Consecutive texts: their bytes, where each begins and ends, and their words."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of each text."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes: a polynomial in them, from prefix sums."""
        up, down = _power_tables(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (fewer words: no window)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(_STEP) + words[i : i + count]
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of an Arrow column (null: empty), some megabytes at a time."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    whole = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        to = min(to, n)
        data = whole[bounds[at] : bounds[to]]
        yield _texts(at, lower_ascii(data) if lower else data, bounds[at : to + 1] - bounds[at])
        at = to


def _texts(first: int, data: np.ndarray, bounds: np.ndarray) -> Texts:
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Texts(first, data, bounds, starts, ends, np.searchsorted(starts, bounds))


SPACE = _SPACE
