"""Main text of web pages by tag-path ratios.

Every text node of a page hangs on a root-to-leaf path of tags (a tag carries its class and id words that mark
page furniture).  Paths, not single nodes, are judged: the text length and the punctuation of a path's nodes are
summed and set against the number of nodes, smoothed over neighbouring nodes in page order, fused, weighted by
what the path's tags say, and the paths above a share of the best one are content.  Within an article every path
but furniture is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ferrule.llm.columns import pick, text_of

#: Elements whose text is never the article's.
FURNITURE = frozenset("nav footer aside form button select option textarea head menu dialog fieldset label input".split())
#: Elements whose content is no text at all: it runs to their own end tag.
RAW = "script|style|noscript|template|svg|iframe|object|canvas|title|textarea|select"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Formulas are text within a line; their tags may close themselves.
MATHS = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml none".split()
)
INLINE |= MATHS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these, up to the limit.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
MAIN = frozenset(["article", "main"])
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social comment "
    "comments disqus reply replies respond footer header masthead related login search form widget toolbar pagination pager".split()
)
#: Parts that a class may have besides these words; with any other (no-sidebar, comments-open) it speaks of something else.
NEUTRAL = frozenset("site main global top bottom primary secondary area list section wrapper wrap container box bar block links buttons inner".split())
#: What an article inside does not clear: comments and teasers are articles too.  Only hidden holds against main.
HELD = frozenset(
    "ad ads adbox advert adverts advertisement sponsor sponsored promo promotion comment comments disqus reply replies respond related hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>"
    # a quote that nothing closes is a character like any other
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>])*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。、，！？]")
#: Weights of neighbours in page order, and the share of the best path's score that content needs.
KERNEL = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
SHARE = 0.25
#: What the tags of a path multiply its score by: outside of the article if there is one, and in links.
OUTSIDE, LINKED = 0.1, 0.4


def _hint(tag: str, rest: str, inside: bool) -> str:
    """The first word of class, id or role that marks page furniture; those that an article does not clear come first."""
    if not rest.strip() or tag in MAIN or tag in ("html", "body"):
        return ""
    found = ""
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "role":
            if value in ROLES:
                found = found or value
        else:
            for token in value.split():
                words = _WORDS.findall(token)
                hints = [w for w in words if w in HINTS and not (inside and w == "header")]
                if hints and all(w in hints or w in NEUTRAL for w in words):
                    for w in hints:
                        if w in HELD:
                            return w
                    found = found or hints[0]
    return found


class Page:
    """Text nodes of a page with their paths and blocks."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        # of paths: furniture by tag or held, furniture by a hint above, in the article, in a link
        self.kinds: list[tuple[bool, str, bool, bool]] = [(False, "", False, False)]
        self.nodes: list[tuple[int, int, str]] = []  # block, path, text
        self.open: list[tuple[str, int]] = [("", 0)]
        self.opened: Counter = Counter()  # tags of self.open
        self.block = 0
        at = 0
        for m in _TAG.finditer(source):
            self._text(source[at : m.start()])
            at = m.end()
            if m["raw"]:
                if m["raw"].lower() in ("textarea", "select"):
                    self.block += 1
            elif m["tag"]:
                (self._end if m["end"] else self._start)(m["tag"].lower(), m["rest"])
        self._text(source[at:])

    def _text(self, raw: str) -> None:
        if raw:
            self.nodes.append((self.block, self.open[-1][1], html.unescape(raw) if "&" in raw else raw))

    def _close(self, k: int) -> None:
        self.opened.subtract(tag for tag, _ in self.open[k:])
        del self.open[k:]

    def _push(self, tag: str, path: int) -> None:
        self.opened[tag] += 1
        self.open.append((tag, path))

    def _start(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self.block += 1
            closes, until = IMPLIED.get(tag, ({"p"}, {"table", "td", "th", "button", "li", "article", "section", "div", "body"}))
            for k in range(len(self.open) - 1, 0, -1) if any(self.opened[c] > 0 for c in closes) else ():
                name = self.open[k][0]
                if name in closes:
                    self._close(k)
                    break
                if name in until:
                    break
        if tag == "br":
            self._text(" ")
        if tag in VOID or (tag in MATHS and rest.endswith("/")):
            return
        parent = self.open[-1][1]
        if tag in MATHS:  # a formula is text of what it stands in
            self._push(tag, parent)
            return
        hint = _hint(tag, rest, self.kinds[parent][2])
        key = (parent, f"{tag}.{hint}" if hint else tag)
        if key not in self.paths:
            self.paths[key] = len(self.kinds)
            bad, hinted, inside, link = self.kinds[parent]
            if hinted and hinted != "hidden" and (tag == "main" or tag == "article" and hinted not in HELD):
                hinted = ""  # a layout's words do not speak of the article in it
            if not hinted or hint in HELD and hinted != "hidden":
                hinted = hint or hinted
            # an article's own header holds its heading
            bad = bad or tag in FURNITURE or (tag == "header" and not inside)
            self.kinds.append((bad, hinted, inside or tag in MAIN, link or tag == "a"))
        self._push(tag, self.paths[key])

    def _end(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self.block += 1
        for k in range(len(self.open) - 1, 0, -1) if self.opened[tag] > 0 else ():
            if self.open[k][0] == tag:
                self._close(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def scores(self) -> np.ndarray:
        """Of each path: its fused, smoothed ratio; 0 for furniture and for paths without text."""
        n = len(self.kinds)
        nodes = [(p, len(t.strip()), len(_MARKS.findall(t))) for _, p, t in self.nodes if not t.isspace()]
        if not nodes:
            self.whole = np.zeros(n, bool)
            return np.zeros(n)
        path, chars, marks = (np.array(x) for x in zip(*nodes))
        tagged, hinted, inside, link = (np.array(x) for x in zip(*self.kinds))
        bad = tagged | (hinted != "")
        if bad[path].all():  # hints alone do not empty a page
            bad = tagged | (hinted == "hidden")
        count = np.maximum(np.bincount(path, minlength=n), 1)
        fused = np.zeros(n)
        good = ~bad[path]  # furniture next to a node does not raise it
        smoothed = lambda x: np.convolve(x, KERNEL)[len(KERNEL) // 2 :][: len(path)]
        near = smoothed(good.astype(float))  # what there is of a kernel at the edges
        parts = []
        for amount in (chars, marks):
            ratio = (np.bincount(path, amount, n) / count)[path] * good
            parts.append(np.bincount(path, np.maximum(ratio, smoothed(ratio) / np.maximum(near, 1e-9)), n) / count)
        fused = np.log1p(parts[0]) * (1 + 0.25 * np.log1p(parts[1]))
        fused[bad | (np.bincount(path, chars, n) == 0)] = 0
        fused[link] *= LINKED
        self.whole = inside & ~bad
        if (fused[inside] > 0).any():
            fused[~inside] *= OUTSIDE
        return fused

    def text(self) -> str:
        scores = self.scores()
        content = self.whole | (scores >= max(1e-9, SHARE * scores.max()))
        blocks: list[list[str]] = []
        last = None
        for block, path, text in self.nodes:
            # spaces belong to the block around them, whatever their path
            if content[path] or (text.isspace() and block == last):
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def main_text(source: str) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) of every row of ``pages`` (page_id, url, html).

    Text is that of the content paths with character references decoded: white space inside a block becomes one
    space, blocks are trimmed and joined by a line feed in page order, empty ones left out.  Null html is empty,
    an empty page or one without content gives empty text.  Ill-formed pages are read as far as they go.  Null
    ids and urls, repeated rows and extra columns change nothing.  An empty table gives an empty result.
    """
    p = pick(pages, page_id="long", url="string", html="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return p.select("page_id", "url", text_of(p["html"]).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
