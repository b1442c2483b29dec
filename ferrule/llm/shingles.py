"""Word shingles of many texts at once.

Words are what white space separates, in lower case.  A text of fewer words than a shingle has one shingle,
of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

from ferrule.llm.hashing import Spans, joined, ranges

SHINGLE = 5


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``normal`` texts in order, with repeats, and where those of each text begin."""
    data, bounds = joined([t + b" " if t else t for t in texts])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    words = Spans(data).hash(starts, ends)
    first = np.searchsorted(ends, bounds)  # of each text's words
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(1, n_words - size + 1))
    at = ranges(first[:-1], n)
    upto = np.minimum(at + size, np.repeat(first[1:], n))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    return Spans(words).hash(at, upto), offsets


def bags(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, how often each occurs, and where those of each text begin."""
    out, counts, bounds = [], [], np.zeros(len(offsets), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        h, c = np.unique(hashes[a:b], return_counts=True)
        out.append(h)
        counts.append(c)
        bounds[i + 1] = bounds[i] + len(h)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), bounds
    return np.concatenate(out), np.concatenate(counts), bounds
