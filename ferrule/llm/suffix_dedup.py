"""Removal of repeated byte strings, exact, over a corpus of any size.

A byte goes if a string of ``size`` bytes that covers it starts anywhere else too, in the same document or another.

1. Every document is cut into runs of windows that share an anchor (``suffixes.anchors``): equal windows have
   equal anchors.  Anchors met once in the corpus drop out, with all their windows.
2. Documents with other anchors send the contexts of their runs: the bytes that the run's windows cover.  A
   task sends equal contexts twice at most, so copies cost little.
3. The contexts of an anchor meet in one task, which finds repeated windows by threshold-bounded interval
   expansion on the Burrows-Wheeler transform of the contexts (``suffixes.repeats``).
4. Anchors of more than ``hot`` documents could meet in no task.  The distinct contexts of such anchors are
   taken apart into windows, which are counted by hash, partly before the shuffle.
5. Repeated windows go back to their documents as spans, and the spans are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.columns import text_of
from ferrule.llm.hashing import Spans, joined, text_parts
from ferrule.llm.memory import tidy
from ferrule.llm.store import drop, keep
from ferrule.llm.suffixes import anchors, repeats

#: Bytes of text searched for anchors at once, and of contexts sorted at once.
CHUNK = 1 << 19
SORTED = 1 << 18
#: Contexts that a task remembers to have sent.
REMEMBERED = 200_000


def _anchors_of(size: int, per_document: bool):
    """Rows of (h, dk, first, n) for each document's runs of windows, or of (h, n, docs) summed over a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for part, texts in text_parts(b.column(1), CHUNK):
                data, bounds = joined(texts)
                doc, first, n, h, places = anchors(data, bounds, size)
                if per_document:
                    begin = (first - bounds[doc]).astype(np.int32)
                    cols = [h.astype(np.int64), keys[part][doc], begin, n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "dk", "first", "n"])
                    continue
                # of each document its distinct anchors, then of each anchor its documents
                pairs, back = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1, return_inverse=True) if len(h) else (np.empty((2, 0), np.uint64), np.empty(0, np.int64))
                n = np.bincount(back.ravel(), places, pairs.shape[1]).astype(np.int64)
                each = pairs[0].astype(np.int64)
                at = np.flatnonzero(np.append(True, each[1:] != each[:-1])) if len(each) else np.empty(0, np.int64)
                sums = [np.add.reduceat(x, at) if len(at) else x for x in (n, np.ones_like(n))]
                yield pa.RecordBatch.from_arrays([pa.array(each[at]), pa.array(sums[0]), pa.array(sums[1])], ["h", "n", "docs"])

    return run


_RUNS = "did long, dk long, c1 long, c2 long, starts array<int>, h long, said boolean, body binary, windows array<long>"


def _contexts_of(size: int):
    """The runs of each document whose anchors others have: where each distinct context starts, and its bytes or,
    under a hot anchor, the hashes of its windows, if the task has not sent them twice yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for b in batches:
            for part, texts in text_parts(b.column(2), CHUNK):
                raw = b"".join(texts)
                data, bounds = joined(texts)
                spans = None
                out: list[tuple] = []
                for i, base_at in enumerate(bounds[:-1].tolist()):
                    row = part.start + i
                    wanted = b.column(3)[row].values
                    first, n, h, warm = (wanted.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                    order = np.argsort(first)
                    hot = set(h[warm].tolist())
                    own: dict[bytes, list] = {}
                    for f, m, a in zip((first[order] + base_at).tolist(), n[order].tolist(), h[order].tolist()):
                        body = raw[f : f + m + size - 1]
                        found = own.setdefault(blake2b(body, digest_size=16).digest(), [a, m, f, body, []])
                        found[4].append(f - base_at)
                    for key, (a, m, f, body, starts) in own.items():
                        times = min(2 - min(2, sent.get(key, 0)), len(starts))
                        sent[key] = sent.get(key, 0) + times
                        c1, c2 = np.frombuffer(key, np.int64).tolist()
                        base = (b.column(0)[row].as_py(), b.column(1)[row].as_py(), c1, c2)
                        for t in range(max(1, times)):
                            windows = None
                            if times and a in hot:
                                spans = spans or Spans(data)
                                at = np.arange(f, f + m)
                                windows = spans.hash(at, at + size).astype(np.int64)
                            out.append((*base, [] if t else starts, a, t < times, None if a in hot or t >= times or t else body, windows))
                    if len(sent) > REMEMBERED:
                        sent.clear()
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(),) * 4 + (pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())))],
                        ["did", "dk", "c1", "c2", "starts", "h", "said", "body", "windows"],
                    )

    return run


def _runs(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of true flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _find(size: int):
    """Over contexts sorted by anchor: the runs of repeated windows of each."""

    def flush(groups: list[dict]) -> pa.RecordBatch:
        found: list[tuple] = []
        alone = lambda g: len(g) == 1 and next(iter(g.values()))[0] > 1  # noqa: E731  copies only: all their windows repeat
        several = [(key, *v) for g in groups if not alone(g) for key, v in g.items()]
        for (key, n, body), flags in zip(several, repeats([x[2] for x in several], size)):
            found.append((key, _runs(flags | (n > 1))))
        for g in groups:
            if alone(g):
                found += [(key, [0, len(body) - size + 1]) for key, (_, body) in g.items()]
        found = [x for x in found if x[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.list_(pa.int32()))],
            ["c1", "c2", "runs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict] = []
        last, held = None, 0
        for b in batches:
            for h, c1, c2, body in zip(*(c.to_pylist() for c in b.columns)):
                if h != last:
                    if held >= SORTED:
                        yield flush(groups)
                        groups, held = [], 0
                    groups.append({})
                    last = h
                n, old = groups[-1].get((c1, c2), (0, None))
                if old is None and body is not None:
                    held += len(body)
                groups[-1][(c1, c2)] = (n + 1, old if old is not None else body)
        yield flush(groups)

    return run


def _merged(hits: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """The bytes that repeated windows cover, as runs: from where contexts start and which of their windows repeat."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((at + r[i], at + r[i + 1] - 1 + size) for x in hits or [] for r in [x["runs"]] for at in x["starts"] for i in range(0, len(r), 2)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_parts(b.column(1), CHUNK):
                out = [_without(text, _merged(hits.as_py(), size)) for text, hits in zip(texts, b.column(2)[part.start : part.stop])]
                cols = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                rest = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), *cols, *rest.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *b.schema.names[3:]]
                )

    return run


def _without(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str, str]:
    at, left = 0, []
    for s, e in spans:
        left.append(text[at:s])
        at = e
    left.append(text[at:])
    at, whole = 0, []
    for s, e in spans:  # for text: only characters that are covered in full
        while s < len(text) and s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e < len(text) and e > s and text[e] & 0xC0 == 0x80:
            e -= 1
        whole.append(text[at:s])
        at = e
    whole.append(text[at:])
    kept = b"".join(whole).decode("utf-8", "replace")
    return len(text), sum(e - s for s, e in spans), len(spans), sha256(b"".join(left)).hexdigest(), kept


def repeated_spans(docs: DataFrame, size: int = 200, hot: int = 2000) -> DataFrame:
    """did, dk, hits (array of starts, runs) of the documents of ``docs`` (did, dk, text) with repeated windows.

    did and dk name a document: its id, and a hash of id and text.  A hit is a context: the bytes at which it starts in
    the document, and begin and end of each run of its windows that repeat.
    """
    texts = docs.where(F.octet_length("text") >= size)
    keyed = texts.select("dk", "text")
    sums = keyed.mapInArrow(tidy(_anchors_of(size, False)), "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    common = keep(sums.where("n > 1").select("h", (F.col("docs") > hot).alias("hot")), "anchors")
    pairs = keyed.mapInArrow(tidy(_anchors_of(size, True)), "h long, dk long, first int, n int").join(common, "h")
    # equal rows of a document tell of the same runs
    wanted = pairs.groupBy("dk").agg(F.collect_set(F.struct("first", "n", "h", "hot")).alias("wanted"))
    some = texts.join(wanted, "dk").select("did", "dk", "text", "wanted")
    runs = keep(some.mapInArrow(tidy(_contexts_of(size)), _RUNS), "contexts")
    drop(common)

    cold = runs.where("said and windows is null").select("h", "c1", "c2", "body")
    n_parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cold.repartition(n_parts, "h").sortWithinPartitions("h").mapInArrow(tidy(_find(size)), "c1 long, c2 long, runs array<int>")

    windows = runs.where("said and windows is not null").select("c1", "c2", "h", F.posexplode("windows").alias("at", "w"))
    twice = windows.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    busy = windows.join(twice, ["h", "w"]).groupBy("c1", "c2").agg(F.sort_array(F.collect_set("at")).alias("at"))
    busy = busy.select("c1", "c2", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("runs"))

    where = runs.where("size(starts) > 0").select("did", "dk", "c1", "c2", "starts")
    hits = where.join(found.unionByName(busy), ["c1", "c2"]).select("did", "dk", F.struct("starts", "runs").alias("hit"))
    return hits.groupBy("did", "dk").agg(F.collect_list("hit").alias("hits"))


def remove_repeats(docs: DataFrame, size: int = 200, hot: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of what is left), kept, and the
    columns named in ``carry`` as they are, for every row of ``docs`` (doc_id, text).

    Texts are judged as UTF-8 bytes, on the input, and matches never cross documents; overlapping matches count.
    ``kept`` is text, so a character that is removed in part stays in it whole; kept_sha256 is of the very bytes.
    Null text is empty.  Every row is a document of its own, also a repeated one or one without an id: equal
    texts of ``size`` bytes or more remove each other.  Shorter texts stay as they are.  Other columns are
    ignored; an empty table gives an empty result.
    """
    kinds = {c: docs.schema[c].dataType for c in carry}
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"].cast("string")).alias("text"), F.struct(*[docs[c] for c in carry]).alias("more") if carry else F.lit(None).alias("more"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64("doc_id", "text").alias("dk"), "text", "more")
    spans = repeated_spans(d.select("did", "dk", "text"), size, hot)
    both = d.join(spans, ["did", "dk"], "left").select("doc_id", "text", "hits", *[F.col(f"more.{c}").alias(c) for c in carry])
    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    for c, kind in kinds.items():
        schema = schema.add(c, kind)
    return both.mapInArrow(tidy(_cut(size)), schema)
