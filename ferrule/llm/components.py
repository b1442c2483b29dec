"""Connected components of a graph of any size, by joins and sums only.

Edges are first contracted inside partitions of about ``PART`` of them, each to a forest of stars; a graph that fits in
one partition is done then.  After that large-star and small-star steps alternate: every node hands its larger neighbours, then its smaller ones, to the
smallest node it knows, until each component is a star around its smallest node.  The steps never gather a
node's neighbours, never hold more edges than they got, and need a number of rounds logarithmic in the longest
path.  Between rounds edges live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.store import drop, keep


#: Edges contracted in one task.
PART = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the smallest nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges a > b: large hands the larger neighbours of every node on, small the smaller ones."""
    if large:
        reach = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        reach = edges
    least = reach.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("k"), F.least("a", "least").alias("least"))
    if large:  # only neighbours above the node itself move
        moved = edges.select(F.col("b").alias("k"), F.col("a").alias("x")).join(least, "k").select(F.col("x").alias("a"), F.col("least").alias("b"))
    else:
        moved = edges.select(F.col("a").alias("k"), F.col("b").alias("x")).join(least, "k").select(F.col("x").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select(F.col("k").alias("a"), F.col("least").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge in ``edges`` (a, b: long).

    Loops, repeated edges and edges with a null end are dropped; no edges give an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    raw = keep(e.select("a", "b"), "edges")
    parts = max(1, -(-raw.count() // PART))
    e = keep(raw.repartition(parts).mapInArrow(_contract, "a long, b long"), "edges")
    drop(raw)
    sign = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(e) if parts > 1 else (0,)
    while before[0]:
        new = keep(_star(_star(e, large=True), large=False), "edges")
        drop(e)
        e, now = new, sign(new)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
