"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the shortest string not parsed before.  The set of a text's phrases is its
dictionary; two texts that compress each other well share phrases.  The set is hashed and its MinHash signature
is the fingerprint; the share of equal slots estimates how much of two dictionaries is common.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.columns import pick, text_of
from ferrule.llm.hashing import Spans, mix

SLOTS = 64
_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
_EMPTY = np.full(SLOTS, 0xFFFF, np.uint16)
#: Phrases hashed at once.
_PART = 2048


class Parse:
    """An incremental parse: its phrases so far, and the one it has begun."""

    __slots__ = ("phrases", "begun")

    def __init__(self, phrases: set[str] | None = None, begun: str = ""):
        self.phrases, self.begun = phrases if phrases is not None else set(), begun

    def feed(self, text: str) -> "Parse":
        phrases, add, w = self.phrases, self.phrases.add, self.begun
        for c in text:
            w += c
            if w not in phrases:
                add(w)
                w = ""
        self.begun = w
        return self

    def copy(self) -> "Parse":
        return Parse(self.phrases.copy(), self.begun)


def signature(phrases: set[str]) -> np.ndarray:
    """The smallest of each slot's hashes over the phrases, cut to 16 bits; all ones if there are none."""
    if not phrases:
        return _EMPTY
    names = list(phrases)
    ends = np.cumsum([len(p) for p in names])
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = Spans(codes).hash(np.append(0, ends[:-1]), ends)
    least = np.full(SLOTS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), _PART):
        least = np.minimum(least, (h[at : at + _PART, None] * _SEEDS).min(axis=0))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str) -> str:
    return as_text(signature(Parse().feed(text).phrases))


def as_text(s: np.ndarray) -> str:
    """Four hex digits a slot."""
    return s.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


class _Document:
    """A document with its parse, kept as it stood where the edit begins."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 2
        self.half = Parse().feed(text[: self.cut])
        self.signature = signature(self.half.copy().feed(text[self.cut :]).phrases)

    def row(self, following: "_Document") -> tuple:
        tail = following.text[: len(self.text) - self.cut]
        edited = signature(self.half.feed(tail).phrases)
        digest = sha256((self.text[: self.cut] + tail).encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(self.signature, edited), likeness(self.signature, following.signature)
        return (self.doc_id, len(self.text), digest, as_text(self.signature), as_text(edited), *near)


_COLUMNS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_ROWS = 512


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the rows of ranges in order, each with the first row of the range after it at its end."""
    held: _Document | None = None
    at, out = None, []
    for b in batches:
        ranges_, extras = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, (p, extra) in enumerate(zip(ranges_, extras)):
            if p != at:
                at, held = p, None
            elif held is None:  # further rows that tie with the one that closed the range
                continue
            new = _Document(b.column(2)[i].as_py(), b.column(3)[i].as_py())
            if held is not None:
                out.append(held.row(new))
            held = None if extra else new
            if len(out) >= _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*out), _COLUMNS)], [n for n, _ in _COLUMNS])
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*out), _COLUMNS)], [n for n, _ in _COLUMNS])


def next_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and of their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document, by
    ascending doc_id, the first after the last.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  Null text is empty; a text without phrases is like itself alone.
    Null ids come before all others; rows of one doc_id follow each other by text, and repeated rows are
    documents of their own.  A lone document is its own next.  Extra columns are ignored; an empty table gives an
    empty result.

    Rows are dealt to ranges of doc_id whose bounds are ids that occur, so each range can be sent the row that
    follows it: the text is shuffled once, and no task sees more than its ranges, row by row.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id="long", text="string")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / (4 * n) for i in range(4 * n)]
    low, some, nulls = d.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 40 * n), F.count_if(F.col("doc_id").isNull())).first()
    bounds = np.array(sorted({low, *(some or [])}) if low is not None else [], np.int64)
    last = max(0, len(bounds) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its range, and first rows of a range to the one before, too."""
        for b in batches:
            ids = b.column(0)
            none = np.asarray(ids.is_null())
            x = np.asarray(ids.fill_null(0))
            p = np.where(none, 0, np.maximum(0, np.searchsorted(bounds, x, "right") - 1)).astype(np.int32)
            opens = ~none & (bounds[p] == x) if len(bounds) else none
            first = none if nulls else opens & (p == 0)  # may be the very first: it follows the last
            before = np.flatnonzero((opens & (p > 0)) | first)
            rows = pa.array(np.concatenate([np.arange(len(x)), before]))
            where = np.concatenate([p, np.where(first[before], last, p[before] - 1)]).astype(np.int32)
            extra = np.concatenate([np.zeros(len(x), bool), np.ones(len(before), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(extra), ids.take(rows), b.column(1).take(rows)], ["p", "extra", "doc_id", "text"])

    dealt = d.select("doc_id", text_of(d["text"]).alias("text")).mapInArrow(deal, "p int, extra boolean, doc_id long, text string")
    order = ("p", "extra", F.asc_nulls_first("doc_id"), "text")
    rows = dealt.repartition(n, "p").sortWithinPartitions(*order)
    return rows.mapInArrow(
        _pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
