"""Token counts: map-side two-tier lookup.

A byte-level BPE splits a text into pre-tokens and merges inside each of them only, so a text's count is the
sum of its pre-tokens' lengths.  Tier one is a compact table of frequent pre-tokens and their lengths, of at
most ``table_size`` entries, broadcast.  Tier two encodes what the table misses with the library and keeps the
lengths in the worker's own cache of at most ``cache_size`` entries.  Texts never leave their task: no shuffle.

The table holds the commonest pre-tokens of all texts, counted in a pass before.  It decides which tier answers,
never the answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.columns import pick, text_of
from ferrule.llm.memory import cache, tidy
from ferrule.llm.store import drop, keep

#: How a byte-level pre-tokenizer with its own pattern splits (a fixed value of the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blocks whose classes all versions of the character tables agree on (fixed values: Latin, Greek, Cyrillic, marks, kana, Han, Hangul).
_AGREED = "\x00-\u024f\u0391-\u03a1\u03a3-\u03e1\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20a0-\u20ac\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Where a text can be cut whatever stands around: before the space between two plain words.
_CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
#: Characters of a pre-token of the table at most.
LONGEST = 64

_workers: dict[str, "TwoTier"] = {}
cache("token counts", _workers.clear)


class TwoTier:
    """Counts the tokens of texts; one per worker and vocabulary."""

    def __init__(self, path: str, frequent: dict[str, int], cache_size: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies with the usual pattern and no normalizer")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take part of their surroundings")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.split = regex.compile(PATTERN).findall
        self.odd = re.compile(f"[^{_AGREED}]").search
        # longest first, as the library prefers among added tokens at one place
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.frequent, self.cache, self.cache_size = frequent, {}, cache_size

    def parts(self, text: str) -> list[str]:
        """What stands between special tokens."""
        return self.special.split(text) if self.special is not None and self.special.search(text) else [text]

    def pieces(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with their counts, and how many tokens there are besides."""
        parts = self.parts(text)
        if len(parts) == 1 and self.odd(text) is None:
            return Counter(self.split(text)), 0
        found: Counter = Counter()
        extra = len(parts) - 1
        for p in parts:
            if self.odd(p) is None:
                found.update(self.split(p))
                continue
            for q in _CUT.split(p):  # what the tables may class differently is left to the library
                if self.odd(q) is None:
                    found.update(self.split(q))
                else:
                    extra += len(self.library.encode(q, add_special_tokens=False))
        return found, extra

    def count(self, text: str) -> int:
        found, total = self.pieces(text)
        frequent, cache, missing = self.frequent.get, self.cache.get, []
        for piece, n in found.items():
            k = frequent(piece) or cache(piece)
            if k is None:
                missing.append(piece)
            else:
                total += n * k
        if missing:
            if len(self.cache) + len(missing) > self.cache_size:
                self.cache.clear()
            for piece, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False)):
                self.cache[piece] = k = len(e)
                total += found[piece] * k
        return total


def _worker(path: str, frequent: dict[str, int], cache_size: int) -> TwoTier:
    if path not in _workers:
        _workers[path] = TwoTier(path, frequent, cache_size)
    _workers[path].frequent, _workers[path].cache_size = frequent, cache_size
    return _workers[path]


def _counted(path: str, flush: int = 1 << 19):
    """Pre-tokens of a task's texts with their counts; in parts where there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier, seen = _worker(path, {}, 0), Counter()

        def done() -> pa.RecordBatch:
            short = [(p, n) for p, n in seen.items() if len(p) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["piece", "n"])

        for b in batches:
            for t in b.column(0):
                for part in tier.parts(t.as_py()):
                    seen.update(tier.split(part))
                if len(seen) > flush:
                    yield done()
        yield done()

    return run


def frequent_lengths(docs: DataFrame, path: str, table_size: int, sample_rows: int | None = None) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of all texts, or of ``sample_rows`` texts if given; of the last ties all or none."""
    texts = docs.select(text_of(docs["text"]).alias("text"))
    if sample_rows is not None:
        texts = texts.limit(sample_rows)
    counts = keep(texts.mapInArrow(tidy(_counted(path), "token counts"), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    # the least count of which all pieces fit, so that the driver gets no more than the table
    least, total = None, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).collect():
        total += r["count"]
        if total > table_size:
            break
        least = r.n
    names = [] if least is None else [r.piece for r in counts.where(F.col("n") >= least).collect()]
    drop(counts)
    tier = TwoTier(path, {}, 0)
    return {p: len(e) for p, e in zip(names, tier.library.encode_batch_fast(names, add_special_tokens=False))}


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, table_size: int = 65_536, cache_size: int = 500_000, sample_rows: int | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text is empty: no bytes, no tokens.  Null ids and repeated rows are kept, one row each.  Extra columns
    are ignored.  An empty table gives an empty result.
    """
    docs = pick(docs, doc_id="long", text="string")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, table_size, sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier = _worker(tokenizer, frequent.value, cache_size)
        for b in batches:
            n = [tier.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = text_of(docs["text"])
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(tidy(count, "token counts"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
