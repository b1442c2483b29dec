import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from ferrule.llm.hashing import joined
from ferrule.llm.sources import table
from ferrule.llm.suffix_dedup import remove_repeats
from ferrule.llm.suffixes import anchors, repeats


def windows(strings, size):
    return Counter(s[i : i + size] for s in strings for i in range(len(s) - size + 1))


def test_repeats_equal_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        size = rng.randrange(1, 9)
        base = [bytes(rng.choice(b"abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 6))]
        strings = base + [b[rng.randrange(5) :] for b in base] + [b""]
        count = windows(strings, size)
        for s, flags in zip(strings, repeats(strings, size)):
            assert flags.tolist() == [count[s[i : i + size]] > 1 for i in range(len(s) - size + 1)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab ") for _ in range(400)) for _ in range(3)] + [b"xyz" * 100, b"short"]
    texts.append(texts[0][50:300])
    names: dict = {}
    data, bounds = joined(texts)
    n = 0
    for doc, first, m, h, _ in zip(*anchors(data, bounds, 40, 8)):
        assert bounds[doc] <= first and first + m + 39 <= bounds[doc + 1]
        for i in range(first, first + m):
            assert names.setdefault(data[i : i + 40].tobytes(), h) == h
            n += 1
    assert n == sum(max(0, len(t) - 39) for t in texts)


def expected(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = windows([b for _, b in texts], size)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), sha256(left).hexdigest()))
    return sorted(out, key=str)


def got(df, size, hot):
    return sorted((tuple(r)[:5] for r in remove_repeats(df, size, hot).collect()), key=str)


@pytest.mark.parametrize("hot", [2000, 2])
def test_corpus(spark, sf_dir, hot):
    docs = table(spark, sf_dir, "documents")
    assert got(docs, 200, hot) == expected([(r.doc_id, r.text) for r in docs.collect()], 200)


@pytest.mark.parametrize("hot", [2000, 1])
def test_edges(spark, hot):
    p = "A passage of some length that stands in more than one text, with é and 日本. " * 3
    rows = [(1, None), (2, ""), (3, p), (4, "x" + p + "y"), (5, "zz" * 300), (6, "one of a kind " + "".join(map(str, range(200)))), (7, p[:199]), (None, p + "q"), (8, "same " * 60), (8, "same " * 60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    assert got(df, 200, hot) == expected(rows, 200)
    assert remove_repeats(df.limit(0)).count() == 0


def test_carried_columns_and_whole_characters(spark):
    t = "ü" * 300
    df = spark.createDataFrame([(1, "a" + t, "en"), (2, "b" + t, "de")], "doc_id long, text string, lang string")
    rows = sorted(remove_repeats(df, carry=("lang",)).collect())
    assert [(r.kept, r.lang, r.n_removed) for r in rows] == [("a", "en", 600), ("b", "de", 600)]
    odd = spark.createDataFrame([(1, "é" + "x" * 200), (2, "é"[:0] + "ã" + "x" * 200)], "doc_id long, text string")
    assert all(r.kept in ("é", "ã") for r in remove_repeats(odd).collect())


def test_periodic_and_long_texts(spark):
    """Repeats inside one text, at any offset, and long ones of one character or a short period."""
    rows = [(1, "a" * 5000), (2, "abc" * 900 + "q"), (3, "z" + "a" * 260), (4, "ab" * 99), (5, "no repeat " + "".join(map(str, range(300)))), (6, "ab" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2000, 1):
        assert got(df, 200, hot) == expected(rows, 200)
    long = spark.createDataFrame([(1, "x" * 10_000_000), (2, "ab" * 2_000_000 + "!" * 150)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(long).collect()) == [(1, 10_000_000, 10_000_000, 1), (2, 4_000_150, 4_000_000, 1)]
