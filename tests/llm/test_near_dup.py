import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ferrule.llm.bagminhash import signatures
from ferrule.llm.components import _star, components
from ferrule.llm.near_dup import deduplicated, links_in_block, near_duplicates
from ferrule.llm.sources import table


def bag(text):
    w = (text or "").lower().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def jaccard(a, b):
    m = sum(min(c, b[s]) for s, c in a.items())
    return m / (sum(a.values()) + sum(b.values()) - m)


def brute(docs, threshold=0.8):
    bags = {k: bag(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    by = defaultdict(set)
    for k, b in bags.items():
        for s in b:
            by[s].add(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        if jaccard(bags[a], bags[b]) >= threshold:
            join(a, b)
    empty = [k for k, b in bags.items() if not b]
    for k in empty[1:]:
        join(empty[0], k)
    return {k: find(k) for k in docs}


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    x, y = rng.integers(1, 40, len(h)), rng.integers(1, 40, len(h))
    s = signatures(np.concatenate([h, h]), np.concatenate([x, y]), np.array([0, len(h), 2 * len(h)]), 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03
    alone = signatures(h, x, np.array([0, len(h)]), 4096)
    assert (alone[0] == s[0]).all()  # whatever else is in the batch


def test_same_classes_as_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert classes(near_duplicates(docs)) == brute({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})


def test_group_of_copies_around_one_text(spark):
    """Copies are near their source, but not each other; some are only near another copy."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = {0: " ".join(base)}
    for k in range(1, 60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs[k] = " ".join(w)
        if k % 5 == 0:
            w[rng.randrange(len(w))] = "far"
            docs[1000 + k] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    expected = brute(docs)
    assert len(set(expected.values())) > 1
    got = classes(near_duplicates(df, block_bytes=1 << 13))
    assert got == expected


def test_links_through_differences_are_exact():
    rng = random.Random(2)
    lead = Counter({rng.randrange(1000): rng.choice([1, 1, 2, 5]) for _ in range(80)})
    others = []
    for _ in range(40):
        b = Counter(lead)
        for _ in range(rng.randrange(30)):
            b[rng.choice([*lead, rng.randrange(60)])] = rng.randrange(4)
        others.append(+b)
    for _ in range(10):
        b = Counter(rng.choice(others))
        b[rng.randrange(1000)] += 1
        others.append(+b)
    arrays = [(np.array(sorted(b), np.uint64), np.array([b[k] for k in sorted(b)])) for b in [lead, *others]]
    from ferrule.llm.near_dup import differences

    diffs = [differences(x, arrays[0]) for x in arrays[1:]]
    size = sum(lead.values())
    far = [(size - m) / (size + y) < 0.8 for m, y, _ in diffs]
    found = links_in_block(list(range(len(others))), far, size, np.array([d[0] for d in diffs]), np.array([d[1] for d in diffs]), [d[2] for d in diffs], 0.8)
    root = list(range(len(others)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in found:
        assert jaccard(others[a], others[b]) >= 0.8
        root[find(a)] = find(b)
    for a in range(len(others)):
        for b in range(a):
            if (far[a] or far[b]) and jaccard(others[a], others[b]) >= 0.8:
                assert find(a) == find(b)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "z " * 30_000), (9, "z " * 30_001)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.class_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (8, 8), (9, 8), (None, None)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = sorted((r.doc_id for r in deduplicated(df).collect()), key=str)
    assert kept == sorted([1, 4, 6, 7, 8, None], key=str)


@pytest.mark.parametrize("part", [3, 10**6])
def test_components(spark, part, monkeypatch):
    import ferrule.llm.components as c

    monkeypatch.setattr(c, "PART", part)
    edges = [(i, i + 1) for i in range(20)] + [(100, 105), (105, 103), (7, 7), (None, 3), (200, 201), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 103: 100, 105: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
