"""Near duplicates: BagMinHash signatures, bands, exact verification, connected components.

1. Texts equal up to case and white space are merged first; the smallest doc_id stands for them.
2. Signatures of the multisets of five-word shingles are cut into bands; equal bands share a bucket.
3. In a bucket everything is compared with one leader, never all with all: the member whose buckets are fullest,
   which in a group of copies is the text they were copied from.  Members within the threshold are linked to it.
4. A link between two other members, one of them below the threshold, needs differences from the leader that the
   two share: with v = L - X + Y for both, their overlap is |L| - |Xv| - |Xw| + |Xv & Xw| + |Yv & Yw|, and without
   the last two terms no pair is nearer than its farther half is to the leader.  So such members are compared by
   their differences alone, in blocks of one leader, through an index of differences.  That is exact; only links
   that join something new inside a block leave it.
5. Links are joined to classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.bagminhash import signatures
from ferrule.llm.columns import pick, text_of
from ferrule.llm.components import components
from ferrule.llm.hashing import Spans, in_chunks, mix, ranges, text_parts
from ferrule.llm.memory import tidy
from ferrule.llm.shingles import bags, normal, shingle_hashes
from ferrule.llm.store import drop, keep

#: Bytes of text handled at once.
CHUNK = 1 << 20
#: A text is hot if it makes up this share of the rows, one in so many; there are at most as many such texts.
HOT = 5000


def bands_of(texts: list[bytes], bands: int, rows: int) -> list[np.ndarray]:
    """The band values of each normal text, none for a text without words."""
    h, c, bounds = bags(*shingle_hashes(texts))
    points = signatures(h, c, bounds, bands * rows)
    n = len(texts)
    flat = Spans(points.reshape(-1))
    starts = np.arange(n * bands) * rows
    values = mix(flat.hash(starts, starts + rows) + np.tile(np.arange(bands, dtype=np.uint64), n))
    values = values.astype(np.int64).reshape(n, bands)
    return [v if t else v[:0] for v, t in zip(values, texts)]


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_parts(b.column(1), CHUNK):
                own = [normal(t.decode("utf-8", "replace")) for t in texts]
                keys = np.array([np.frombuffer(blake2b(t, digest_size=16).digest(), np.int64) for t in own]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[part.start : part.stop], pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bands_of(own, bands, rows), pa.list_(pa.int64()))],
                    ["doc_id", "k1", "k2", "bands"],
                )

    return run


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (hashes, counts)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(x[1][i], y[1][j]).sum())
    return common / (int(x[1].sum()) + int(y[1].sum()) - common)


Bag = tuple[np.ndarray, np.ndarray]


def differences(x: Bag, lead: Bag) -> tuple[int, int, np.ndarray]:
    """How many elements of the leader's bag are missing in x, how many x has beyond it, and a name for each."""
    names = np.union1d(x[0], lead[0])
    more = np.zeros(len(names), np.int64)
    more[np.searchsorted(names, x[0])] += x[1]
    more[np.searchsorted(names, lead[0])] -= lead[1]
    at = np.flatnonzero(more)
    nth = ranges(np.zeros(len(at), np.int64), np.abs(more[at])).astype(np.uint64)
    sign = np.repeat((more[at] > 0).astype(np.uint64), np.abs(more[at]))
    each = np.repeat(names[at], np.abs(more[at]))
    return int(-more[more < 0].sum()), int(more[more > 0].sum()), mix(each + (nth * np.uint64(2) + sign) * np.uint64(0x9E3779B97F4A7C15))


_COMPARED = "node long, lead long, sim double, size long, missing long, beyond long, names binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with their leaders: similarity, the leader's size, and the differences."""
    known: dict[int, Bag] = {}
    held = 0

    def bag(node: int, text: str) -> Bag:
        nonlocal held
        if node not in known:
            if held >= CHUNK:
                known.clear()
                held = 0
            known[node] = bags(*shingle_hashes([normal(text)]))[:2]
            held += len(known[node][0])
        return known[node]

    for b in batches:

        sizes = [x + y for x, y in zip(*(pc.binary_length(b.column(i)).to_pylist() for i in (2, 3)))]
        for part in in_chunks(sizes, CHUNK):
            out = []
            for row in range(part.start, part.stop):
                node, lead = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                other = bag(lead, b.column(3)[row].as_py())
                size = int(other[1].sum())
                missing, beyond, names = differences(bag(node, b.column(2)[row].as_py()), other)
                out.append((node, lead, (size - missing) / (size + beyond), size, missing, beyond, names.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split()[0] for c in _COMPARED.split(", ")])


def links_in_block(nodes: list[int], far: list[bool], size: int, missing: np.ndarray, beyond: np.ndarray, names: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of a block that are not both near the leader."""
    n = len(nodes)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    every = np.concatenate(names)
    owner = np.repeat(np.arange(n), [len(x) for x in names])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    total = size - missing + beyond
    out = []
    for v in range(n):
        if not far[v] or not len(names[v]):
            continue
        low, high = np.searchsorted(every, names[v], "left"), np.searchsorted(every, names[v], "right")
        shared = np.bincount(owner[ranges(low, high - low)], minlength=n)
        common = size - missing[v] - missing + shared
        for w in np.flatnonzero(common >= threshold * (total[v] + total - common)).tolist():
            a, b = find(v), find(w)
            if a != b:
                root[a] = b
                out.append((nodes[v], nodes[w]))
    return out


def _among(threshold: float):
    """Over members sorted by leader and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> pa.RecordBatch:
            nodes, sims, sizes, missing, beyond, names = zip(*rows)
            found = links_in_block(list(nodes), [s < threshold for s in sims], sizes[0], np.array(missing), np.array(beyond), [np.frombuffer(x.as_buffer(), np.uint64) for x in names], threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, *row in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), *(batch.column(i).to_pylist() for i in range(3, 8)), batch.column(8)):
                if key != at:
                    if len(rows) > 1:
                        yield done()
                    at, rows = key, []
                rows.append(row)
        if len(rows) > 1:
            yield done()

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 4, block_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) for every row of ``docs`` (doc_id, text).

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is at least
    ``threshold``; a class holds whatever links join.  A pair just at 0.8 shares none of 20 bands of 4 with
    probability 0.00003, a nearer pair still less.  Texts of fewer than five words are one shingle; null is
    empty; texts without words are equal to each other and near nothing else.  Rows of one doc_id are one
    document: their classes join, and its smallest text is the one compared.  A null doc_id has class null.
    Extra columns are ignored; an empty table gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string").withColumn("text", text_of(F.col("text")))
    n_parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = keep(d.mapInArrow(tidy(_sign(bands, rows)), "doc_id long, k1 long, k2 long, bands array<long>"), "signed")
    known = signed.where("doc_id is not null")
    first = keep(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "first")
    # texts of very many copies, at most HOT of them, go to their rows, not those rows to one task
    cut = (first.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(first.where(F.col("n") > cut).select("k1", "k2", "node"))
    keyed, rest = known.select("doc_id", "k1", "k2"), first.where(F.col("n") <= cut).select("k1", "k2", "node")
    some = keyed.join(hot, ["k1", "k2"]).unionByName(keyed.join(hot, ["k1", "k2"], "left_anti").join(rest, ["k1", "k2"]))
    members = keep(some.select("doc_id", "node"), "members")
    own = known.join(first.select("k1", "k2", F.col("node").alias("doc_id")), ["doc_id", "k1", "k2"]).withColumn("node", F.col("doc_id"))
    entries = own.select("node", F.explode("bands").alias("b")).distinct()
    entries = keep(entries.join(entries.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"), "b"), "entries")
    # how full a node's buckets are, and below that a hash, so that ties fall alike everywhere
    central = entries.groupBy("node").agg(F.sum("n").alias("full"))
    central = central.select("node", (F.col("full") * 1024 + F.pmod(F.xxhash64("node"), F.lit(1024))).alias("rank"))
    leads = entries.join(central, "node").groupBy("b").agg(F.max_by("node", "rank").alias("lead"))
    pairs = entries.join(leads, "b").where("node <> lead").select("node", "lead").distinct()
    texts = keep(d.join(central.select("node"), F.col("doc_id") == F.col("node")).groupBy("node").agg(F.min("text").alias("text")), "texts")
    left = texts.select("node", F.col("text").alias("t1"))
    right = texts.select(F.col("node").alias("lead"), F.col("text").alias("t2"))
    both = pairs.join(left, "node").join(right, "lead").select("node", "lead", "t1", "t2")
    compared = keep(both.mapInArrow(tidy(_compare), _COMPARED), "compared")
    for table in (texts, entries, first):
        drop(table)
    links = compared.where(F.col("sim") >= threshold).select(F.col("node").alias("a"), F.col("lead").alias("b"))

    groups = compared.groupBy("lead").agg(
        F.count_if(F.col("sim") < threshold).alias("far"), F.count("*").alias("n"), F.sum(F.octet_length("names")).alias("bytes")
    )
    groups = groups.where("far > 0 and n > 1").select("lead", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    work = compared.where(F.octet_length("names") > 0).join(groups, "lead")
    work = work.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "sim", "size", "missing", "beyond", "names")
    work = work.repartition(n_parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    links = links.unionByName(work.mapInArrow(tidy(_among(threshold)), "a long, b long"))

    found = components(links)
    named = members.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    # rows of one doc_id share the smallest class
    classes = named.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("class_id"), F.count("*").alias("copies"))
    rows_out = classes.select("doc_id", "class_id", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("x")).drop("x")
    out = keep(rows_out.unionByName(signed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))), "classes")
    for table in (signed, members, compared):
        drop(table)
    return out


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` (doc_id, text and whatever else) of each class: that of its smallest doc_id.

    Of repeated rows of that id the one of smallest text stays.  Rows of a null doc_id have no class and stay.
    """
    classes = near_duplicates(docs, threshold)
    gone = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    free = "n" + "_" * max(map(len, docs.columns))  # a name that no column has
    named = kept.where("doc_id is not null").withColumn(free, nth).where(F.col(free) == 1).drop(free)
    return named.unionByName(docs.where("doc_id is null"))
