"""Operators against plain versions that share none of their code but the hashes of features."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import fingerprints, html_text, near_dup, quality, token_counts, topk
from ferrule.llm.sources import table, vocabulary

PLANES = [range(0x20, 0x7F)] * 4 + [range(0xA0, 0x250), range(0x20), range(0x250, 0x3000), range(0x3000, 0x20000), [0x16EB2, 0x16EC8, 0x1F9FF, 0x378, 0x301, 0x2028, 0x200B]]


def test_margins_are_those_of_a_dense_solver():
    """The dual problem of the hinge loss over explicit feature vectors, solved to the end by projected gradients."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60, 14)) + (0 if i % 2 else 25) for i in range(40)]
    good = np.array([i % 2 == 1 for i in range(40)])
    x = np.zeros((40, 1 << quality.BITS))
    for i, r in enumerate(rows):
        x[i, r] = 1
    p, q = 1 + x[good].sum(0), 1 + x[~good].sum(0)
    ratio = np.log(p / (good.sum() + 2)) - np.log(q / ((~good).sum() + 2))
    scaled = x * ratio / np.sqrt(x.sum(1, keepdims=True))
    y = np.where(good, 1.0, -1.0)
    kernel = (scaled @ scaled.T + 1) * np.outer(y, y)
    alpha, step = np.zeros(40), 1 / np.linalg.norm(kernel, 2)
    for _ in range(100_000):
        alpha = np.clip(alpha + step * (1 - kernel @ alpha), 0, 1.0)
    expected = scaled @ (scaled.T @ (alpha * y)) + (alpha * y).sum()
    w, b = quality._descend(rows, y, ratio, np.ones(40), 3000, 7)
    model = quality.Model(w * ratio, b, 1.0, 0.0)
    assert np.abs([model.margin(r) for r in rows] - expected).max() < 0.02


def lz78(text):
    """Phrases by a tree of letters."""
    root: dict = {}
    out, node, phrase = set(), root, ""
    for c in text:
        phrase += c
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            out.add(phrase)
            node, phrase = root, ""
    return out


def test_fingerprints_estimate_what_phrase_sets_share(spark, sf_dir):
    rows = sorted((r.doc_id, r.text or "") for r in table(spark, sf_dir, "documents").collect())
    got = {r.doc_id: r for r in fingerprints.next_fingerprints(table(spark, sf_dir, "documents")).collect()}
    off = []
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        m = len(t) // 2
        edited = t[: len(t) - m] + following[:m]
        assert fingerprints.Parse().feed(t).phrases == lz78(t)
        for other, said in ((edited, got[k].near_edited), (following, got[k].near_next)):
            a, b = lz78(t), lz78(other)
            true = len(a & b) / len(a | b) if a or b else 1.0
            off.append(said - true)
            assert abs(said - true) <= 5 * math.sqrt(max(true * (1 - true), 0.01) / fingerprints.SLOTS)
    assert abs(np.mean(off)) < 0.02


@pytest.mark.parametrize("scale", [390.0, 3e8, 3e15])
def test_top_k_of_large_vectors(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-1000, 1000, 5 if i % 7 else 3) * scale).tolist()) for i in range(120)] + [(200, [0.0] * 5), (250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    expected = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    run = lambda: sorted(map(tuple, topk.exact_top_k(topk.whole_vectors(df), F.col("vec_id") % 50 == 0).collect()))
    if all(abs(s) < 1 << 63 for *_, s in expected):
        assert run() == sorted(expected)
    else:
        with pytest.raises(Exception, match="too large|overflow|Overflow|too big"):
            run()


def test_token_counts_of_all_planes(spark):
    rng = random.Random(8)
    texts = ["".join(chr(c) for c in (rng.choice(rng.choice(PLANES)) for _ in range(rng.randrange(1, 30))) if not 0xD800 <= c < 0xE000) for _ in range(6000)]
    texts += ["plain words here \U00016eb4\U00016eb5 and there 's x", " \U00016eb4" * 3, "ab" * 20_000]
    t = token_counts.TwoTier(vocabulary("byte_bpe_50k.json"), {}, 1000)
    for x, e in zip(texts, t.library.encode_batch_fast(texts, add_special_tokens=False)):
        assert t.count(x) == len(e.ids), ascii(x[:60])


def test_a_text_of_many_megabytes(spark):
    text = "word and, " * 1_000_000
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, vocabulary("byte_bpe_50k.json")).collect()}
    assert got[2] == 0 and 3_000_000 <= got[1] <= 3_000_001
    assert html_text.main_text("<article><p>" + text + "</p></article>") == text.strip()


FILL = "Some words, that go on; and on, until the end of it. "


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main><div class='wrap'>%s</div></main>", "<div id='content'>%s</div>"])
def test_pages_with_known_text(n, shell):
    rng = random.Random(n)
    blocks, source = [], []
    for i in range(n):
        text = FILL * rng.randrange(3, 9) + str(i)
        blocks.append(text)
        source.append(f"<p>{text}</p>")
    page = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>%s<footer>Imprint, terms.</footer></body></html>"
    assert html_text.main_text(page % (shell % "".join(source))) == "\n".join(blocks)


@pytest.mark.parametrize("depth", [10, 5000])
def test_pages_of_any_depth_and_open_quotes(depth):
    deep = "<div>" * depth + f"<nav>menu, menu</nav><p>{FILL}</p>" + "</div>" * depth
    assert html_text.main_text(deep) == FILL.strip()
    assert html_text.main_text(f'<p>{FILL}</p><script x="a>var q=1;</script>') == FILL.strip()


def test_columns_with_clashing_names(spark):
    import corpus_pipeline

    rows = [(i, FILL * (1 + i % 3), i, "k", [i]) for i in range(6)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __nth long, kept string, hits array<long>")
    for stage in (lambda d: near_dup.deduplicated(d), lambda d: corpus_pipeline.repeated_passages(spark, d, "")):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert near_dup.deduplicated(docs).where("doc_id is not null").count() == 3
    kept = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert kept[3].hits == [3] and kept[3].kept == "k" and len(kept) == 7
