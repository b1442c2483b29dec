"""Tokens, pieces, fingerprints, packing, pages: against the libraries and brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest

from ferrule.llm import fingerprints, html_text, packing, piece_encoding, pieces, token_counts, word_tokens
from ferrule.llm.sources import table, vocabulary

ODD = ["a<|endoftext|>B c'sd don't I'LL 12 x²½ ΑΣ İstanbul é ﬁ \x00\x1c\x1fz 　日本語 ​\xa0q 'S ''re ǅ ẞ", "<|startoftext|>", "", " \n", "   x", "😀" * 3, "a" * 5000]
ROWS = [(1, None), (None, "hello world"), (2, "hello world"), (2, "hello world"), *((i + 10, t) for i, t in enumerate(ODD))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 9) for r in ROWS], "doc_id long, text string, ids int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def key(r):
    return tuple(str(x) for x in r)


def test_token_counts(odd, docs):
    t = library("byte_bpe_50k.json")
    for df in (odd, docs):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        expected = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in rows]
        got = token_counts.token_counts(df, vocabulary("byte_bpe_50k.json"), cache_size=1000, table_size=50, sample_rows=20).collect()
        assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert token_counts.token_counts(odd.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_frequent_pieces_are_those_of_whole_texts(spark):
    rows = [(1, "a " * 3000 + " zebra" * 5000), (2, None), (3, "a<|endoftext|> zebra")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert list(token_counts.frequent_lengths(df, vocabulary("byte_bpe_50k.json"), 1, 100)) == [" zebra"]


def test_word_tokens():
    w = word_tokens.WordTokens(vocabulary("word_bpe_49k.json"), cache_size=20)
    for at in range(0, 0x3000, 64):
        texts = [f"ab{chr(c)}cd {chr(c)} {chr(c)}9" for c in range(at, at + 64)] + ODD
        for x, ids in zip(texts, w.encode(texts)):
            assert np.frombuffer(ids, np.uint16).tolist() == w.library.encode(x, add_special_tokens=False).ids, repr(x)


def in_chunks(p, text, size):
    s = p.prepared(text)
    cuts = [*range(size, len(s), size), len(s)] if s else []
    states = [[None], *(p.states(s, c) for c in cuts)]
    ends = pieces.combine([p.transfer(s, c, states[k], states[k + 1]) for k, c in enumerate(cuts)]) if cuts else []
    out, at = [], None
    for k, c in enumerate(cuts):
        out += p.backtrace(s, c, at, states[k + 1][ends[k]])
        at = states[k + 1][ends[k]]
    return out


def test_pieces_equal_the_library():
    import sentencepiece

    p, lib = pieces.Pieces(vocabulary("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(1)
    letters = [*"ab  the ing\n\t.,é日本😀▁12aeiou", "  ", "    ", "the", "tion", " ́"]
    for text in [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(400))]:
        expected = lib.encode(text)
        assert np.frombuffer(p.encode(text), np.int32).tolist() == expected
        assert in_chunks(p, text, rng.choice([1, 2, 3, 7, 16])) == expected
        assert p.decode(expected) == lib.decode(expected)


def test_piece_tables(odd, docs):
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    for df in (odd, docs):
        expected = [(r.doc_id, lib.encode(r.text or ""), lib.decode(lib.encode(r.text or ""))) for r in df.collect()]
        got = piece_encoding.decode(piece_encoding.encode(df, model, giant=1500, chunk=400), model).collect()
        assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert piece_encoding.encode(odd.limit(0), model).count() == 0


def fingerprinted(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (k, t) in enumerate(rows):
        x = rows[(i + 1) % len(rows)][1]
        m = len(t) // 2
        e = t[: len(t) - m] + x[:m]
        f, g, h = (fingerprints.signature(fingerprints.Parse().feed(s).phrases) for s in (t, e, x))
        out.append((k, len(t), sha256(e.encode()).hexdigest(), fingerprints.as_text(f), fingerprints.as_text(g), fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    return sorted(out, key=key)


def test_fingerprints(spark, odd, docs):
    cases = [odd, docs, spark.createDataFrame([(5, "x")], "doc_id long, text string"), spark.createDataFrame([(None, "x"), (None, "y")], "doc_id long, text string")]
    for df in cases:
        got = sorted(map(tuple, fingerprints.next_fingerprints(df).collect()), key=key)
        assert got == fingerprinted([(r.doc_id, r.text) for r in df.collect()])
    assert fingerprints.next_fingerprints(odd.limit(0)).count() == 0


def test_phrases_are_the_shortest_new_ones():
    p = fingerprints.Parse().feed("aabab")
    assert (p.phrases, p.begun) == ({"a", "ab"}, "ab")
    assert p.copy().feed("a").phrases == fingerprints.Parse().feed("aababa").phrases
    assert fingerprints.likeness(*(fingerprints.signature(fingerprints.Parse().feed(t).phrases) for t in ("abc" * 50, "xyz" * 50))) < 0.1


@pytest.mark.parametrize("shard_tokens", [2000, 1 << 20])
def test_packing(odd, docs, shard_tokens):
    t = library("word_bpe_49k.json")
    for df in (docs, odd):
        rows = packing.pack(df, vocabulary("word_bpe_49k.json"), window=1024, shard_tokens=shard_tokens).collect()
        expected: dict = {}
        for r in df.collect():
            expected.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [packing.CLOSE])
        pieces_of: dict = {}
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length > 0
            pieces_of.setdefault(r.doc_id, []).append((r.start, ids))
        for k, texts in expected.items():
            assert sorted(i for _, x in pieces_of[k] for i in x) == sorted(i for x in texts for i in x)
            if len(texts) == 1:
                assert [i for _, x in sorted(pieces_of[k]) for i in x] == texts[0]
        by: dict = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in by.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at == 1024 or (at < 1024 and at & (at - 1) == 0)
    assert packing.pack(odd.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_word_tokens_of_all_planes():
    rng = random.Random(5)
    pools = [range(0x20, 0x7F)] * 4 + [range(0xA0, 0x250), range(0x20), range(0x250, 0x3000), range(0x3000, 0x20000), [0x130, 0x31E, 0x301, 0x49, 0xD7, 0xF7, 0x1C, 0x85, 0xA0, 0x2028, 0x200B, 0x16EB4]]
    texts = ["".join(chr(c) for c in (rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 14))) if not 0xD800 <= c < 0xE000) for _ in range(8000)]
    texts += ["ab" * 30_000, "x" * 70 + " " + "y" * 64, ",'s ''re x'sd"]
    w = word_tokens.WordTokens(vocabulary("word_bpe_49k.json"), cache_size=3000)
    for x, ids, e in zip(texts, w.encode(texts), w.library.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, np.uint16).tolist() == e.ids, ascii(x[:50])


def test_word_tokens_of_long_texts(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "\n", "Other,", "\x1c", "é", "x" * 90, "\u3000", "it's "]) for _ in range(4000))
    w = word_tokens.WordTokens(vocabulary("word_bpe_49k.json"))
    monkeypatch.setattr(word_tokens, "CHUNK", 500)
    for x in (text, text.replace(" ", "").replace("\n", ""), "y" * 3000):
        assert np.frombuffer(w.encode([x])[0], np.uint16).tolist() == w.library.encode(x, add_special_tokens=False).ids


def test_packing_puts_neighbours_together():
    rng = np.random.default_rng(1)
    topics = [rng.choice(1000, 40, replace=False) + 1000 * k for k in range(4)]
    docs = [(i % 4, rng.choice(topics[i % 4], 64).astype(np.uint16)) for i in range(48)]  # three windows of each topic
    shard = packing.Shard(docs, np.ones(packing.TERMS), 100.0, 256)
    shard.pack()
    by: dict = {}
    for r in shard.rows:
        by.setdefault(r[5], []).append(r[0])
    assert np.mean([len(set(v)) == 1 for v in by.values()]) > 0.9


def test_packing_scores_are_bm25():
    rng = np.random.default_rng(2)
    own = [rng.integers(0, 400, n).astype(np.uint16) for n in rng.integers(1, 300, 60)]
    df = np.zeros(packing.TERMS)
    for x in own:
        df[np.unique(x)] += 1
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), float(np.mean([len(x) for x in own]))
    shard = packing.Shard([(i, x) for i, x in enumerate(own)], idf, mean, 1 << 12)
    shard._index(list(range(60)), [0] * 60)
    got = shard.scores(np.arange(60), 60)
    for q, x in enumerate(own):
        for d, y in enumerate(own):
            tf = [(t, int((y == t).sum())) for t in set(x.tolist())]
            plain = sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(y) / mean)) for t, n in tf)
            assert abs(got[q, d] - plain) < 1e-2


def test_packing_shards_by_content():
    """Copies and near copies share a first key term however many texts stand between them; the order of rows does not matter."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40_000, 200).astype(np.uint16) for _ in range(400)]
    near = [np.where(rng.random(200) < 0.05, rng.integers(0, 40_000, 200), x).astype(np.uint16) for x in texts]
    every = [*texts, *texts, *near]
    idf = np.ones(packing.TERMS)
    keys = packing.keys_of(np.concatenate(every), np.array([200] * 1200), idf, 200.0)
    assert (keys[:400] == keys[400:800]).all()
    first = keys >> 16 * (packing.KEY_TERMS - 1)
    assert (first[:400] == first[800:]).mean() > 0.8
    assert len(np.unique(first[:400])) > 200
    assert (packing.keys_of(np.concatenate(every[::-1]), np.array([200] * 1200), idf, 200.0)[::-1] == keys).all()
    assert packing.keys_of(np.empty(0, np.uint16), np.array([0, 0]), idf, 1.0).tolist() == [0, 0]


def test_packing_ranks_by_all_terms():
    """A piece that shares only light terms of a long seed comes before one that shares none."""
    rare = np.repeat(np.arange(100, 130), 4)
    docs = [(0, np.concatenate([rare, np.arange(10, 70)]).astype(np.uint16)), (1, np.arange(2000, 2076).astype(np.uint16)), (2, np.arange(10, 70).astype(np.uint16))]
    shard = packing.Shard(docs, np.ones(packing.TERMS), 100.0, 256)
    shard.pack()
    assert [r[0] for r in shard.rows][:2] == [0, 2]


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies,
ok? Long text here, and more text, here.</div><main><h2>Title &amp; more</h2><p>Hello&nbsp;<i>wor</i>ld, this is <a href="/x>">the article</a> text.<p>Second
<!-- <p>no</p> --> para<script>var t="</p>";</script><table><tr><td>A<td>B</table><ul><li>one<li>two</ul><form>Email <input><button>Go</button></form>
<div id=comments><p>Nice post, I agree, really.</p></div></main><aside>Related</aside><footer>c</footer></body></html>"""


def test_pages(spark, sf_dir):
    assert html_text.main_text(PAGE) == "Title & more\nHello world, this is the article text.\nSecond para\nA\nB\none\ntwo"
    assert html_text.main_text("just text &lt; more") == "just text < more"
    assert html_text.main_text("<div><p>Some text, that is long enough.</p><p>More.</p><ul><li><a href=1>x</a></li><li><a href=2>y</a></li></ul></div>") == "Some text, that is long enough.\nMore."
    assert html_text.main_text("<p>a<script>x") == "a"
    rows = [(1, "u", PAGE, 1), (None, None, None, 1), (2, "u", "", 1), (2, "u", "<p>", 1), (3, "v", "<div>" * 6000 + "deep", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(html_text.main_text(PAGE))), (None, 0), (2, 0), (2, 0), (3, 4)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_corpus(spark, sf_dir):
    import html
    import re

    for r in table(spark, sf_dir, "pages").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("odd_tag", ["<svg-icon name=a></svg-icon>", "<title-bar></title-bar>", "<select-menu></select-menu>", "<object-viewer></object-viewer>", '<svg width="1"/>', "<svg/>", "<math/>", "<svg><text>no</text></svg >", "<script>no</script x>"])
def test_pages_are_not_lost_after(odd_tag):
    assert html_text.main_text(f"<article><p>First text, of some length.</p>{odd_tag}<p>Second text, of some length.</p></article>") == "First text, of some length.\nSecond text, of some length."


def test_pages_keep_formulas():
    page = "<article><p>The area of the square is <math><msup><mi>side</mi><mn>2</mn></msup><mspace/></math>, as known.</p></article>"
    assert html_text.main_text(page) == "The area of the square is side2, as known."


ARTICLE = "<h1>The heading</h1><p>Text of the article, of some length, with marks.</p><p>More of it, and more.</p>"
ARTICLE_TEXT = "The heading\nText of the article, of some length, with marks.\nMore of it, and more."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout no-sidebar"><article>{ARTICLE}</article></div>',
        f'<div id=page class="site has-sidebar comments-open"><article>{ARTICLE}</article></div>',
        f'<div id=page class="site has-sidebar comments-open">{ARTICLE}</div>',
        f'<div class="layout sidebar"><div><article>{ARTICLE}</article></div></div>',
        f'<div class="layout sidebar">{ARTICLE}</div>',
        f'<div class="comments"><main>{ARTICLE}</main></div>',
        f'<article><header class="entry-header"><h1>The heading</h1></header>{ARTICLE[20:]}</article>'.replace("</h1></h1>", "</h1>"),
        f'<article><div class="header"><h1>The heading</h1></div>{ARTICLE[20:]}</article>',
        f'<article>{ARTICLE}</article><div class="comments-area"><article><p>I agree with all of it, really.</p></article></div>',
        f'<article>{ARTICLE}<div class="sidebar"><p>A box at the side, with text.</p></div></article>',
        f'<article>{ARTICLE}</article><div class="related sidebar"><article><p>A teaser of another text, here.</p></article></div>',
        f'<div>{ARTICLE}</div><div class="cookie-notice"><p>We use cookies, on all of our pages.</p></div>',
    ],
)
def test_pages_keep_the_article_in_a_layout(page):
    assert html_text.main_text(page) == ARTICLE_TEXT


@pytest.mark.parametrize("tag", ["article", "main"])
def test_pages_keep_long_tables_and_lists(tag):
    paragraph = "A paragraph that is rather long, as they are, and goes on. " * 6
    rows = [[f"{i % 10}{j}" for j in range(4)] for i in range(50)]
    table = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows)
    items = [f"i{k}" for k in range(200)]
    page = f"<nav><a href=x>Home</a></nav><{tag}>{f'<p>{paragraph}</p>' * 5}<table>{table}</table><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>{f'<p>{paragraph}</p>' * 5}</{tag}><p>x</p>"
    assert html_text.main_text(page).split("\n") == [paragraph.strip()] * 5 + [x for r in rows for x in r] + items + [paragraph.strip()] * 5
