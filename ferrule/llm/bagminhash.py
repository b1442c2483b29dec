"""BagMinHash signatures of multisets.

Every element carries Poisson processes over its discretised weight: one of rate 1 for the first unit, then one
for each doubling of the weight, (1, 2], (2, 4], ..., whose rate is the interval's width.  The points of an interval
fall on its unit cells at random; an element whose count ends inside the interval keeps the points on the cells
below its count.  So an element of count c owns the points of exactly c unit cells, and the larger of two counts
owns all points of the smaller.  A point goes to one of the signature's slots at random, and each slot keeps its
earliest.  Two slots agree with probability sum(min) / sum(max): the weighted Jaccard similarity, without bias.

Processes run side by side in rounds, each ending as soon as it has passed the latest slot of its text.
"""

from __future__ import annotations

import numpy as np

from ferrule.llm.hashing import mix, ranges

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xD1342543DE82EF95)


def _processes(hashes: np.ndarray, counts: np.ndarray, text: np.ndarray):
    """text, seed, rate and cells kept of all processes."""
    parts = [(text, hashes, np.ones(len(hashes)), np.ones(len(hashes)))]
    level, more = 1, np.flatnonzero(counts > 1)
    while len(more):
        width = 1 << (level - 1)
        kept = np.minimum(counts[more] - width, width).astype(float)
        parts.append((text[more], mix(hashes[more] + np.uint64(level * int(_LEVEL) % 2**64)), np.full(len(more), float(width)), kept))
        more = more[counts[more] > 2 * width]
        level += 1
    return [np.concatenate(x) for x in zip(*parts)]


def signatures(hashes: np.ndarray, counts: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` values for each text, those of its earliest points; texts without elements get zeros.

    ``hashes`` are the distinct elements of each text, ``counts`` their numbers, ``bounds`` where each text's begin.
    """
    n = len(bounds) - 1
    first, point = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    sizes = np.diff(bounds)
    text, seed, rate, kept = _processes(hashes, counts, np.repeat(np.arange(n), sizes))
    weight = np.bincount(text, rate, n)
    pace = slots * (np.log(slots) + 1) / np.maximum(weight, 1) / 3  # a round's time: a few rounds fill all slots
    now, drawn = np.zeros(len(text)), np.zeros(len(text), np.uint64)
    while len(text):
        block = np.maximum(1, (rate * pace[text]).astype(np.int64))
        p = np.repeat(np.arange(len(text)), block)
        nth = ranges(np.zeros(len(text), np.int64), block).astype(np.uint64) + drawn[p]
        r = mix(seed[p] + (nth + np.uint64(1)) * _STEP)
        gap = -np.log1p((r >> np.uint64(11)) * -(2.0**-53)) / rate[p]
        run = np.cumsum(gap)
        ends = np.cumsum(block) - 1
        x = run - np.repeat(run[ends] - np.add.reduceat(gap, ends - block + 1) - now, block)
        r2 = mix(r ^ _LEVEL)
        slot = (r2 & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
        mine = ((r2 >> np.uint64(32)) * 2.0**-32 * rate[p]).astype(np.int64) < kept[p]
        at, x_mine, r_mine = text[p[mine]] * slots + slot[mine].astype(np.int64), x[mine], r[mine]
        np.minimum.at(first, at, x_mine)
        earliest = first[at] == x_mine
        point[at[earliest]] = r_mine[earliest]
        now, drawn = x[ends], drawn + block.astype(np.uint64)
        on = now < first.reshape(n, slots).max(axis=1)[text]
        text, seed, rate, kept, now, drawn = (a[on] for a in (text, seed, rate, kept, now, drawn))
    return point.reshape(n, slots)
