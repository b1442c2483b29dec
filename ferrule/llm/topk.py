"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates and queries meet in blocks.  Within a block of candidates every dimension has a list sorted by its
component.  A query walks the lists of all its dimensions in step, each from the end that its own component
favours, scores what it meets in full, and stops once its k-th score beats the bound: the inner product with
the components last seen, which nothing unseen can exceed.  The best k of every block are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.columns import pick

#: Products below these are exact in a float, and in a long.
EXACT, LONG = 1 << 53, 1 << 63
FIRST_STEP = 32


def whole_vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, vec: every component x as floor(scale * x); without null vectors or ids, or components that are null or not finite."""
    v = pick(df, vec_id="long", embedding="array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return v.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(scale))).alias("vec"))


class Block:
    """Candidates of one block with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.lists = np.take_along_axis(self.vectors, self.order, axis=0)

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but ``own``; ties to the smaller id."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        rows, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        depth, step = 0, FIRST_STEP
        while depth < n:
            upto = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[n - upto : n - depth, up]] = True
            met[self.order[depth:upto, down]] = True
            if not len(up) and not len(down):  # a query of zeros has no lists: all scores are 0
                met[:], upto = True, n
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ q])
            if len(rows) > k:  # rows stand by id, so a stable order breaks ties
                rows, scores = rows[o := np.argsort(rows)], scores[o]
                top = np.argsort(-scores, kind="stable")[:k]
                rows, scores = rows[top], scores[top]
            bound = self.lists[n - upto, up] @ q[up] + self.lists[upto - 1, down] @ q[down]
            if len(rows) >= k and scores.min() > bound:  # at equality an unseen row of smaller id could still tie
                break
            depth, step = upto, step * 2
        o = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[o]], scores[o]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of vectors; a shorter one is filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(flat.value_lengths())
    values = np.asarray(flat.flatten()).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def exact_top_k(candidates: DataFrame, is_query: Column, k: int = 5, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """The k candidates of highest inner product for every row of ``candidates`` (vec_id, vec) where ``is_query`` holds.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, a query is no candidate of
    its own, fewer rows than k are all returned.  Shorter vectors count as filled up with zeros.  Repeated
    candidates each take a place; repeated queries are answered once, those of one id but other vectors apart
    (query_id then repeats).  An empty table gives an empty result; null ids and vectors must be gone
    (``whole_vectors``).  Products are floats, longs or whole numbers of any size, whichever holds a block's sums exactly;
    only a score among the k best that is no long raises an error.
    """
    every = pick(candidates, vec_id="long", vec="array<long>")
    asked = every.where(is_query).dropDuplicates(["vec_id", "vec"]).withColumn("key", F.xxhash64("vec"))
    n, m = every.count(), asked.count()
    n_blocks, m_blocks = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    dealt = lambda df, blocks: F.pmod(F.xxhash64(df["vec_id"]), F.lit(blocks)).cast("int")
    copies = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = every.select("vec_id", "vec", dealt(every, n_blocks).alias("c"), copies(m_blocks).alias("q"))
    right = asked.select("vec_id", "vec", "key", dealt(asked, m_blocks).alias("q"), copies(n_blocks).alias("c"))

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if have.num_rows and want.num_rows:
            width = max(int(np.max(np.asarray(t["vec"].combine_chunks().value_lengths()))) for t in (have, want))
            c, q = _matrix(have["vec"], width), _matrix(want["vec"], width)
            most = max(map(abs, (int(c.min()), int(c.max())))) * max(map(abs, (int(q.min()), int(q.max())))) * width if width else 0
            # whole numbers of any size where a long does not hold all sums
            c, q = (x.astype(np.float64 if most < EXACT else np.int64 if most < LONG else object) for x in (c, q))
            block = Block(have["vec_id"].to_numpy(), c)
            for own, key, v in zip(want["vec_id"].to_pylist(), want["key"].to_pylist(), q):
                ids, scores = block.best(own, v, k)
                out += [(own, key, i, int(s)) for i, s in zip(ids.tolist(), scores.tolist())]
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "key", "vec_id", "score"])

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(search, "query_id long, key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
