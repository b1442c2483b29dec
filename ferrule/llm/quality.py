"""Quality classifier: support vectors over naive Bayes features.

Features are indicators of n-grams, hashed into a fixed number of buckets: n-grams of bytes, and n-grams of word
shapes (case, digits, marks, whether a word repeats the one before).  Each indicator is scaled by the log of the
ratio of its smoothed frequencies in the two classes, then a linear hinge-loss model is fit by dual coordinate
descent, and a logistic curve over its margins turns them into probabilities.

The fit sees at most ``sample_rows`` labelled texts (the documented bound); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.columns import pick, text_of
from ferrule.llm.hashing import Spans, mix
from ferrule.llm.memory import tidy

BITS = 18
BYTE_GRAMS = (1, 2, 3, 4)
SHAPE_GRAMS = (1, 2, 3)
#: Bytes of text hashed at once; the pieces of a longer text overlap, so it has the features that it would have in one.
PIECE = 1 << 18

_KIND = np.zeros(256, np.uint64)  # of bytes: small, capital, digit, mark, beyond ASCII
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8
_KIND[48:58] = 4
_KIND[65:91] = 2
_KIND[97:123] = 1
_KIND[128:] = 1


def _shapes(data: np.ndarray) -> np.ndarray:
    """One value for each word of ``data``: its kinds of characters, first and last kind, length class, repetition."""
    blank = np.concatenate([[True], data <= 32, [True]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return np.empty(0, np.uint64)
    kinds = _KIND[data]
    held = np.bitwise_or.reduceat(np.append(kinds, np.uint64(0)), np.stack([starts, ends], 1).ravel())[::2]
    names = Spans(data).hash(starts, ends)
    same = np.concatenate([[False], names[1:] == names[:-1]]).astype(np.uint64)
    size = np.minimum(ends - starts, 15).astype(np.uint64) // np.uint64(4)
    last = np.where(kinds[ends - 1] == 8, data[ends - 1], 0).astype(np.uint64)
    return held | (kinds[starts] << np.uint64(4)) | (same << np.uint64(8)) | (size << np.uint64(9)) | (last << np.uint64(12))


def _mark(seen: np.ndarray, source: Spans, kind: int, sizes: tuple[int, ...]) -> None:
    for n in sizes:
        h = source.hash_windows(n)
        seen[(h + np.uint64(0x9E37 * (8 * kind + n))) >> np.uint64(64 - BITS)] = True


def features(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, ascending, each once."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(1 << BITS, bool)
    reach = max(BYTE_GRAMS)
    for at in range(0, len(data), PIECE):
        _mark(seen, Spans(data[at : at + PIECE + reach - 1]), 0, BYTE_GRAMS)
    word = np.concatenate([[False], data > 32, [False]]).astype(np.int8)
    edges = np.diff(word)
    starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    i, tail = 0, np.empty(0, np.uint64)
    while i < len(starts):  # pieces of whole words, each with the last word of the one before
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        shapes = _shapes(data[starts[max(0, i - 1)] : ends[j - 1]])
        tail = np.concatenate([tail, shapes[1:] if i else shapes])
        _mark(seen, Spans(tail), 1, SHAPE_GRAMS)
        tail, i = tail[-max(SHAPE_GRAMS) :], j
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = bias + sum of the weights of the text's features,
    divided by the root of their number."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        return self.bias + float(self.weights[x].sum()) / max(1.0, len(x)) ** 0.5

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -500, 500))))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights over scaled indicators, and a bias."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[x] / max(1.0, len(x)) ** 0.5 for x in rows]
    norms = np.array([1 + v @ v for v in values])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, by Newton's method with Platt's smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum(), (s * margins).sum()], [(s * margins).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-6), b


def fit(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> Model:
    """A model of labelled feature sets; without rows of both classes, one that scores the share of good rows."""
    n = 1 << BITS
    if not len(rows) or good.all() or not good.any():
        share = min(max(float(good.mean()) if len(rows) else 0.5, 0.01), 0.99)
        return Model(np.zeros(n), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = [np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(good == c)]), minlength=n) + smooth for c in (True, False)]
    ratio = np.log(counts[0] / (good.sum() + 2 * smooth)) - np.log(counts[1] / ((~good).sum() + 2 * smooth))
    y = np.where(good, 1.0, -1.0)
    balance = np.where(good, 0.5 / good.mean(), 0.5 / (~good).mean()) * cost

    def margins(train: np.ndarray, test: np.ndarray) -> np.ndarray:
        w, b = _descend([rows[i] for i in train], y[train], ratio, balance[train], epochs, seed)
        m = Model(w * ratio, b, 1.0, 0.0)
        return np.array([m.margin(rows[i]) for i in test])

    fold = np.random.default_rng(seed).permutation(len(rows)) % 3
    seen = np.zeros(len(rows))
    for k in range(3):  # margins of rows that their model has not seen
        seen[fold == k] = margins(np.flatnonzero(fold != k), np.flatnonzero(fold == k))
    slope, shift = _curve(seen, good)
    w, b = _descend(rows, y, ratio, balance, epochs, seed)
    return Model(w * ratio, b, slope, shift)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000) -> Model:
    """Fit on at most ``sample_rows`` rows of ``docs`` whose label counts, those of the smallest hashes of doc_id."""
    d = pick(docs, doc_id="long", text="string")
    marks = pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    chosen = marks.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "quality", "x"])

    # the sample is bounded, so it goes to the documents, not they to it
    picked = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text_of(F.col("text")).alias("text"))
    picked = picked.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of repeated ids one text
    found = picked.mapInArrow(tidy(run), "doc_id long, quality int, x array<int>").toArrow().sort_by([("doc_id", "ascending")])
    rows = [np.asarray(v.values, dtype=np.int32) for v in found["x"]] if found.num_rows else []
    return fit(rows, found["quality"].to_numpy() > 0)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Labels teach where crc32 of the id as text leaves a remainder other than 0 by 5; of several labels for one
    doc_id the highest counts.  Null text is empty and is scored too.  A null doc_id is kept, not held out.
    Repeated rows are scored each.  Extra columns are ignored.  No labels: every score is 0.5.  An empty table
    gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string")
    model = d.sparkSession.sparkContext.broadcast(train(d, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            s = [m.score(features(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= cut) for x in s], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = d.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_of(F.col("text")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample_rows: int = 3000) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and whatever else) that score ``cut`` or more, as they are.

    Scores as in ``quality_scores``; nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield b.filter(pa.array([m.score(features(t.as_py() or "")) >= cut for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
