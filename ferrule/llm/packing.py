"""Lexical retrieval packing: windows of one size, filled with texts that are about the same things.

Texts become token ids once, in a written table.  Whole windows of a long text are sequences as they are; what is
left of it, and shorter texts, are pieces to be packed.  The longest unused piece is the seed of a window; all its
terms are the query; the unused pieces of its index shard follow by BM25 score, then in order, until the window is
full, the last of them cut to fit, and its rest goes on.  What is less than a window at the end of a shard is dealt to
sequences whose sizes are powers of two, which need no padding.

The index is sharded by content.  Of a piece's terms, each stands for an exponential clock whose rate is the
term's BM25 weight in the piece; the first clocks to ring are the piece's key.  Two pieces share a first term with the
probability that weighs their common terms against all of theirs, so copies always do, near copies nearly always
and others where they share what is rare.  The corpus is sorted by key and cut into shards of about
``shard_tokens``: neighbours lie together whatever the size of the corpus, a key that is common spreads over as many
shards as it needs, and the work grows in proportion.  Term counts and weights are those of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.columns import pick, text_of
from ferrule.llm.hashing import in_chunks, mix, ranges
from ferrule.llm.memory import tidy
from ferrule.llm.store import keep
from ferrule.llm.word_tokens import worker

WINDOW = 4096
CLOSE = 2  # the id after each text
K1, B = 1.2, 0.75
TERMS = 1 << 16
#: Ids sorted at once.
STRETCH = 1 << 18
#: Terms of a piece's key.
KEY_TERMS = 3
#: Rounds of queries answered by one product of matrices.
BLOCK = 24


def terms_of(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of texts that lie one after the other: text, term, how often; by text, then by term."""
    parts, first = [], 0
    for some in in_chunks(sizes.tolist(), STRETCH):
        for at in range(some.start, some.stop, TERMS):  # numbers of texts and terms share 32 bits
            own = sizes[at : min(at + TERMS, some.stop)]
            upto = first + int(own.sum())
            keys = np.sort(np.repeat(np.arange(len(own), dtype=np.uint32) << np.uint32(16), own) | ids[first:upto])
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            found = keys[heads]
            parts.append(((found >> np.uint32(16)).astype(np.int64) + at, (found & np.uint32(0xFFFF)).astype(np.int64), np.diff(np.append(heads, len(keys)))))
            first = upto
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3


_IDS = "doc_id long, nth long, ids binary, df array<int>"


def _binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(2 * sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def _tokens(tokenizer: str):
    """The ids of texts; and rows (of no nth) that tell in how many texts of a task each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n, df = worker(tokenizer), 0, np.zeros(TERMS, np.int32)
        for b in batches:
            for part, ids, sizes in encoder.encode_array(b.column(1), (CLOSE,)):
                df += np.bincount(terms_of(ids, sizes)[1], minlength=TERMS).astype(np.int32)
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[part], pa.array(np.arange(n, n + k)), _binaries(ids, sizes), pa.nulls(k, pa.list_(pa.int32()))], ["doc_id", "nth", "ids", "df"]
                )
                n += k
        if n:
            last = [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([df], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(last, ["doc_id", "nth", "ids", "df"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binaries without nulls, and how many each row has."""
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 2
    ids = np.frombuffer(raw, np.uint16) if raw is not None else np.empty(0, np.uint16)
    return ids[at[0] : at[-1]], np.diff(at).astype(np.int64)


def _weights(idf: np.ndarray, mean: float, t: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BM25 weights of the terms of pieces of ``n`` ids, as multiples of 2**-16: their sums are exact in any order."""
    w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
    return np.round(w * (1 << 16)) / (1 << 16)


#: Ringing times of the terms' clocks at rate 1.
_CLOCKS = -np.log((mix(np.arange(1, TERMS + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)


def keys_of(ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """The key of each text: the terms whose clocks ring first, in that order, as one number."""
    text, term, tf = terms_of(ids, sizes)
    times = _CLOCKS[term] / np.maximum(_weights(idf, mean, term, tf, sizes[text]), 2.0**-16)
    out = np.zeros(len(sizes), np.int64)
    for _ in range(KEY_TERMS):
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.empty(0, np.int64)
        least = np.full(len(sizes), np.inf)
        least[text[starts]] = np.minimum.reduceat(times, starts) if len(text) else []
        hit = np.flatnonzero((times == least[text]) & (times < np.inf))
        hit = hit[np.append(True, text[hit][1:] != text[hit][:-1])] if len(hit) else hit
        out <<= 16
        out[text[hit]] |= term[hit]
        times[hit] = np.inf
    return out


def _keyed(idf: np.ndarray, mean: float, window: int):
    """Texts with the keys of what is left of them after whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = _flat(b.column(2))
            rest = sizes % window
            keys = keys_of(ids[ranges(np.cumsum(sizes) - rest, rest)], rest, idf, mean)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *b.columns], ["key", "doc_id", "nth", "ids"])

    return run


class Shard:
    """Texts of one shard, their index, and the sequences made of them."""

    def __init__(self, docs: list[tuple], idf: np.ndarray, mean: float, window: int):
        self.docs, self.idf, self.mean, self.window = docs, idf, mean, window
        self.rows: list[tuple] = []
        self.sequences = 0

    def put(self, doc: int, at: int, upto: int, offset: int) -> None:
        doc_id, ids = self.docs[doc]
        self.rows.append((doc_id, at, upto - at, ids[at:upto], len(ids), self.sequences, offset))

    def _index(self, pieces: list[int], begin: list[int]) -> None:
        """Postings by term; terms of many pieces as a matrix."""
        n = len(pieces)
        own = [self.docs[d][1][a:] for d, a in zip(pieces, begin)]
        sizes = np.array([len(x) for x in own], np.int64)
        piece, term, tf = terms_of(np.concatenate(own), sizes)
        weights = _weights(self.idf, self.mean, term, tf, sizes[piece])
        self.first = np.searchsorted(piece, np.arange(n + 1))  # of each piece's terms
        self.term = term
        by_term = np.argsort(term.astype(np.uint16), kind="stable")
        self.owner, self.weight = piece[by_term], weights[by_term]
        self.count = np.bincount(term, minlength=TERMS)
        self.start = np.cumsum(self.count) - self.count
        common = np.flatnonzero(self.count * 16 > n)
        self.column = np.full(TERMS, -1)
        self.column[common] = np.arange(len(common))
        self.table = np.zeros((len(common), n), np.float32)
        of = ranges(self.start[common], self.count[common])
        self.table[np.repeat(np.arange(len(common)), self.count[common]), self.owner[of]] = self.weight[of]

    def scores(self, asked: np.ndarray, n: int) -> np.ndarray:
        """Scores of all pieces for each piece asked."""
        sizes = self.first[asked + 1] - self.first[asked]
        terms, of = self.term[ranges(self.first[asked], sizes)], np.repeat(np.arange(len(asked)), sizes)
        common = self.column[terms] >= 0
        asks = np.zeros((len(asked), len(self.table)), np.float32)
        asks[of[common], self.column[terms[common]]] = 1
        terms, of = terms[~common], of[~common]
        posts = ranges(self.start[terms], self.count[terms])
        places = np.repeat(of * n, self.count[terms]) + self.owner[posts]
        return np.bincount(places, self.weight[posts], len(asked) * n).reshape(len(asked), n) + asks @ self.table

    def pack(self) -> None:
        size = self.window
        pieces, begin = [], []
        for d, (_, ids) in enumerate(self.docs):
            a = 0
            while a + size <= len(ids):
                self.put(d, a, a + size, 0)
                self.sequences += 1
                a += size
            if a < len(ids):
                pieces.append(d)
                begin.append(a)
        if not pieces:
            return
        n = len(pieces)
        self._index(pieces, begin)
        ends, at = np.array([len(self.docs[d][1]) for d in pieces]), np.array(begin)
        seeds = np.argsort(at - ends, kind="stable")
        unused = np.ones(n, bool)
        rest = int((ends - at).sum())
        answers: dict[int, np.ndarray] = {}
        while rest >= size:
            seeds = seeds[unused[seeds]]
            seed = int(seeds[0])
            if seed not in answers:
                block = seeds[:BLOCK]
                answers = dict(zip(block.tolist(), self.scores(block, n)))
            scores = answers[seed]
            scores[seed] = np.inf  # itself first
            free = np.flatnonzero(unused)
            room = size
            for k in free[np.argsort(-scores[free], kind="stable")].tolist():
                take = min(room, int(ends[k] - at[k]))
                self.put(pieces[k], int(at[k]), int(at[k]) + take, size - room)
                at[k] += take
                room -= take
                unused[k] = at[k] < ends[k]
                if not room:
                    break
            self.sequences += 1
            rest -= size
        left = seeds[unused[seeds]].tolist()
        while rest:  # less than a window: powers of two
            room = fit = 1 << (rest.bit_length() - 1)
            while room:
                k = left[0]
                take = min(room, int(ends[k] - at[k]))
                self.put(pieces[k], int(at[k]), int(at[k]) + take, fit - room)
                at[k] += take
                room -= take
                if at[k] == ends[k]:
                    left.pop(0)
            self.sequences += 1
            rest -= fit


_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


def _pack(idf: np.ndarray, mean: float, window: int, shard_tokens: int):
    """Over texts in the order of their keys: shards of about ``shard_tokens``, packed one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        sizes: list[int] = []

        def done(k: int) -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            shard = Shard(held[:k], idf, mean, window)
            shard.pack()
            for at in range(0, len(shard.rows), 2000):
                rows = [(*r[:3], r[3].astype("<u4").tobytes(), r[4], sequences + r[5], r[6]) for r in shard.rows[at : at + 2000]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in _OUT.split(", ")])
            sequences += shard.sequences
            del held[:k], sizes[:k]

        total = 0
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1)):
                held.append((doc_id, np.frombuffer(x.as_py(), np.uint16)))
                sizes.append(len(held[-1][1]))
                total += sizes[-1]
                if total >= 3 * shard_tokens // 2 and len(held) > 1:  # so the last shard is no small one
                    k = max(1, int(np.searchsorted(np.cumsum(sizes), shard_tokens)))
                    total -= sum(sizes[:k])
                    yield from done(k)
        if held:
            yield from done(len(held))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_tokens: int = 1 << 22) -> DataFrame:
    """Pieces of packed sequences of all rows of ``docs`` (doc_id, text).

    Returns doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset: ids
    ``start`` to ``start + length`` of a text stand at ``offset`` of a sequence.  Every id, the closing one included,
    is in one piece; sequences hold ``window`` ids, or fewer by a power of two.  Null and empty texts are the closing
    id alone.  Repeated rows and rows of a null doc_id are each packed.  Extra columns are ignored; an empty table
    gives an empty result.  ``window`` must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    d = pick(docs, doc_id="long", text="string").withColumn("text", text_of(F.col("text")))
    made = keep(d.mapInArrow(tidy(_tokens(tokenizer), "word tokens"), _IDS), "ids")
    ids = made.where("nth is not null").select("doc_id", "nth", "ids")
    total, texts = ids.agg(F.coalesce(F.sum(F.octet_length("ids") / 2), F.lit(0)), F.count("*")).first()
    # one number for each id of a vocabulary of 16 bits at most
    seen = made.where("df is not null").select(F.posexplode("df").alias("term", "n")).where("n > 0")
    counts = seen.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(TERMS)
    df[counts["term"].to_numpy()] = counts["n"].to_numpy()
    idf = np.log1p((texts - df + 0.5) / (df + 0.5))
    mean = total / max(1, texts)
    shards = max(1, round(total / shard_tokens))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = ids.mapInArrow(tidy(_keyed(idf, mean, window)), "key long, doc_id long, nth long, ids binary")
    order = ("key", "doc_id", "nth")
    dealt = keyed.repartitionByRange(min(shards, max(4 * n, shards // 16)), *order) if shards > 1 else keyed.coalesce(1)
    return dealt.sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(tidy(_pack(idf, mean, window, shard_tokens)), _OUT)
