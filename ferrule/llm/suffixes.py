"""Suffix-array machinery on one worker: anchors of windows, and repeats by interval expansion.

``anchors`` names every window of ``size`` bytes by the smallest hash of the short grams inside it (the leftmost
of equals).  Equal windows have equal anchors, and consecutive windows mostly share theirs, so a text becomes
few runs of windows.

``repeats`` finds which windows of a set of strings occur more than once.  It sorts the suffixes, takes their
Burrows-Wheeler transform and expands intervals breadth first: an interval of the suffixes that begin with a
string of l bytes is extended backwards by each byte that precedes it; where the new interval ends at a boundary
not seen before, the common prefix across that boundary is l.  So common prefixes come out by increasing value, and
the expansion stops at ``size``: boundaries not reached by then join suffixes that share ``size`` bytes or more.
"""

from __future__ import annotations

import numpy as np

from ferrule.llm.hashing import Spans, ranges

GRAM = 48
#: Windows named at once: positions must fit in the low bits of a key.
STRETCH = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: Windows of a run at most: equal parts of periodic text are equal runs.
LONGEST = 1024


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, bounds: np.ndarray, size: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows: text, first window's start in ``data``, number of windows, anchor, places at which it stands.

    ``bounds`` are where the texts in ``data`` begin and end; no window crosses them.
    """
    out = []
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for at in range(0, max(0, len(data) - size + 1), STRETCH):
        part = data[at : at + STRETCH + size - 1]
        h = Spans(part).hash_windows(gram)
        key = _sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), size - gram + 1)
        place = (key & _PLACE).astype(np.int64)
        fits = np.flatnonzero(np.arange(at, at + len(key)) + size <= ends[at : at + len(key)])
        if not len(fits):
            continue
        place = place[fits]
        name, gap = h[place], np.diff(fits) > 1
        moves = np.append(True, (place[1:] != place[:-1]) | gap)
        new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | gap))  # in periodic text many places have one name
        sizes = np.diff(np.append(new, len(fits)))
        parts = -(-sizes // LONGEST)
        if len(parts) < parts.sum():
            new = np.repeat(new, parts) + LONGEST * ranges(np.zeros(len(parts), np.int64), parts)
            sizes = np.diff(np.append(new, len(fits)))
        places = np.add.reduceat(moves.astype(np.int64), new)
        first = fits[new] + at
        out.append((np.searchsorted(bounds, first, "right") - 1, first, sizes, name[new], np.maximum(places, 1)))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*out))


_DIGITS, _BITS = 7, 9  # bytes packed in a first sort key, and bits for a byte or the end


def suffix_order(values: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """The suffix array of strings that each close with a value of 0; equal suffixes stand by place.

    ``values`` are bytes + 1, ``ends`` the place of each one's closing 0, ``longest`` the longest string with its 0.
    """
    n = len(values)
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(_DIGITS):
        key <<= _BITS
        if j >= n:
            continue
        inside = at[: n - j] + j <= ends[: n - j]
        key[: n - j] |= np.where(inside, values[j:], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.maximum.accumulate(np.where(head, at, 0))  # a group is named by its first rank
    rank = np.empty(n, np.int64)
    rank[order] = group
    depth = _DIGITS
    while depth < longest:
        alone = head & np.append(head[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        s = order[open_at]
        after = s + depth
        second = np.where(after <= ends[s], rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((second, group[open_at]))
        s, second, g = s[again], second[again], group[open_at][again]
        order[open_at] = s
        new_head = np.concatenate([[True], (g[1:] != g[:-1]) | (second[1:] != second[:-1])])
        head[open_at] = new_head
        group[open_at] = np.maximum.accumulate(np.where(new_head, open_at, 0))
        rank[s] = group[open_at]
        depth *= 2
    return order


def repeats(strings: list[bytes], size: int) -> list[np.ndarray]:
    """For each string, whether the window at each of its starts occurs at another start too."""
    lengths = np.array([len(s) for s in strings], np.int64)
    closing = np.cumsum(lengths + 1) - 1
    values = np.zeros(int(closing[-1]) + 1 if len(strings) else 0, np.int64)
    n = len(values)
    if not n:
        return []
    values[np.delete(np.arange(n), closing)] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    ends = np.repeat(closing, lengths + 1)
    order = suffix_order(values, ends, int(lengths.max()) + 1)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)

    before = order - 1
    starts = np.zeros(n, bool)
    starts[0] = True
    starts[closing[:-1] + 1] = True
    bwt = np.where(starts[order], 0, values[before])  # 0: nothing precedes
    back = np.where(bwt > 0, rank[before], -1)
    by_byte = np.argsort(bwt, kind="stable")
    same = bwt[by_byte][1:] == bwt[by_byte][:-1]
    previous, following = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    previous[by_byte[1:][same]] = by_byte[:-1][same]
    following[by_byte[:-1][same]] = by_byte[1:][same]

    reached = np.zeros(n + 1, bool)  # boundary r is before rank r
    reached[0] = reached[n] = True
    # strings of one byte, and of one closing mark each, which all differ
    heads = np.concatenate([[True], (values[order][1:] != values[order][:-1]) | (values[order][1:] == 0)])
    low = np.flatnonzero(heads)
    high = np.append(low[1:], n) - 1
    reached[high + 1] = True
    for _ in range(1, size):
        if not len(low):
            break
        one = low == high
        single = back[low[one]]
        single = single[single >= 0]
        lo, hi = low[~one], high[~one]
        if len(lo):
            sizes = hi - lo + 1
            place = ranges(lo, sizes)
            own = np.repeat(np.arange(len(lo)), sizes)
            extends = bwt[place] > 0
            first = extends & (previous[place] < lo[own])
            last = extends & (following[place] > hi[own])
            a, b = back[place[first]], back[place[last]]
            a = a[np.lexsort((a, own[first]))]
            b = b[np.lexsort((b, own[last]))]
            low, high = np.concatenate([single, a]), np.concatenate([single, b])
        else:
            low = high = single
        fresh = ~reached[high + 1]
        low, high = low[fresh], high[fresh]
        reached[high + 1] = True
    shared = ~reached[:-1] | ~reached[1:]
    flags = np.empty(n, bool)
    flags[order] = shared
    return [flags[e - m : e - m + max(0, m - size + 1)] for e, m in zip(closing.tolist(), lengths.tolist())]
