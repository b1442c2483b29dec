"""SentencePiece ids of whole tables of texts (see ``pieces`` for the method).

Texts of up to ``giant`` characters are one chunk each and are encoded where they lie.  Longer ones are cut into
chunks that are worked on apart, by any executor: first the transfer matrix of every chunk, then, from a text's
matrices, the state at each cut, then the backtrace of every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.columns import pick, text_of
from ferrule.llm.memory import tidy
from ferrule.llm.pieces import Pieces, combine, worker
from ferrule.llm.store import keep

_CHUNKS = "row long, doc_id long, k int, chunks int, text string, left int, right int"


def _cut(model: str, chunk: int):
    """A giant text's chunks, each with as much of its neighbours as a piece can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n = worker(model), TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = p.prepared(text.as_py())
                cuts = [*range(chunk, len(s), chunk), len(s)]
                rows = []
                for k, (a, z) in enumerate(zip([0, *cuts], cuts)):
                    low = max(0, a - p.longest)
                    rows.append((n, doc_id, k, len(cuts), s[low : z + p.longest], a - low, z - low))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _CHUNKS.split(", ")])
                n += 1

    return run


def _sides(p: Pieces, text: str, k: int, left: int, right: int) -> tuple[list, list]:
    return (p.states(text, left) if k else [None]), p.states(text, right)


def _transfers(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = worker(model)
        for b in batches:
            sizes, out = [], []
            for k, text, left, right in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                before, after = _sides(p, text, k, left, right)
                m = p.transfer(text, right, before, after)
                sizes.append(m.shape[1])
                out.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["row", "k", "width", "m"])

    return run


def _combined(t: pa.Table) -> pa.Table:
    """Of one text: the state at both cuts of each chunk."""
    t = t.sort_by("k")
    matrices = [np.frombuffer(m, float).reshape(-1, w) for m, w in zip(t["m"].to_pylist(), t["width"].to_pylist())]
    ends = combine(matrices)
    return pa.table({"row": t["row"], "k": t["k"], "from_state": pa.array([0, *ends[:-1]], pa.int32()), "to_state": pa.array(ends, pa.int32())})


def _backtraces(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = worker(model)
        for b in batches:
            out = []
            for k, text, left, right, a, z in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6, 7))):
                before, after = _sides(p, text, k, left, right)
                out.append(p.backtrace(text, right, before[a], after[z]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int32()))], ["row", "doc_id", "k", "ids"])

    return run


def _whole(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = worker(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [p.encode(t.as_py()) for t in part.column(1)]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str, giant: int = 1 << 16, chunk: int = 1 << 14) -> DataFrame:
    """doc_id, ids (array of int) for every row of ``docs`` (doc_id, text): the ids that the library gives, without
    begin or end.

    Null and empty texts have no ids.  Null ids, repeated rows: one row each.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string").withColumn("text", text_of(F.col("text")))
    usual = d.where(F.char_length("text") <= giant).mapInArrow(tidy(_whole(model), "pieces"), "doc_id long, ids array<int>")
    # written once: rows are numbered in it
    chunks = keep(d.where(F.char_length("text") > giant).mapInArrow(tidy(_cut(model, chunk), "pieces"), _CHUNKS), "chunks")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = chunks.select("row", "k", "text", "left", "right").repartition(n, "row", "k")
    matrices = spread.mapInArrow(tidy(_transfers(model), "pieces"), "row long, k int, width int, m binary")
    ends = matrices.groupBy("row").applyInArrow(_combined, "row long, k int, from_state int, to_state int")
    work = chunks.join(ends, ["row", "k"]).select("row", "doc_id", "k", "text", "left", "right", "from_state", "to_state")
    # dealt out again: the join leaves the few rows in as few tasks
    work = work.repartition(n, "row", "k")
    parts = work.mapInArrow(tidy(_backtraces(model), "pieces"), "row long, doc_id long, k int, ids array<int>")
    joined = parts.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return usual.unionByName(joined.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids")))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text for every row of ``encoded`` (doc_id, ids); null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = worker(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [p.decode(np.asarray(x.values).tolist() if x.is_valid else []) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(tidy(run, "pieces"), "doc_id long, ids array<int>, text string")
