"""Vectorised hashes over many texts at once."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _table(first: np.ndarray, step: np.uint64, n: int) -> np.ndarray:
    if len(first) >= n:
        return first
    out = np.full(max(n, 2 * len(first)), step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Polynomial hashes of any spans of an array of values, each in constant time."""

    def __init__(self, values: np.ndarray):
        global _powers, _inverses
        n = len(values)
        _powers, _inverses = _table(_powers, _MULTIPLIER, n + 1), _table(_inverses, _INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _inverses[starts])

    def hash_windows(self, size: int) -> np.ndarray:
        """Of the spans of ``size`` values at every place."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * _inverses[:n]) if n > 0 else np.empty(0, np.uint64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after the other, and where each text begins (and the last one ends)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + sizes, sizes)


def in_chunks(sizes: list[int], limit: int):
    """Slices of consecutive items of at most ``limit`` in all, or of one larger item."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def text_parts(column, limit: int):
    """(slice, UTF-8 texts) over an Arrow column of strings without nulls, of about ``limit`` bytes each."""
    import pyarrow.compute as pc

    for part in in_chunks(pc.binary_length(column).to_pylist(), limit):
        yield part, [t.as_buffer().to_pybytes() for t in column[part.start : part.stop]]
