"""Main text of HTML pages as the best-scoring run of words and tags.

A page is read into a sequence of tokens: words of text and tags.  Words score
by what they are like: whether they lie in an element that is marked as main
text, beside one, or on a page without such marks; how many words their block
has, and whether a third of it is links.  Tags score negative, more so those that
mostly stand outside main texts.  All weights come from counts over labelled
pages (``html_labels``): a word's is the log-odds of its kind to be main text.
One linear scan finds the contiguous run with the greatest sum: that is the text.

Elements of the kinds that are never main text (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) say so by their tag, class,
id or role.  Their words have no weight: they neither extend nor break a run, and
are left out of it.  A class name counts word by word: one that speaks of the
layout or of an absence (``has-sidebar``, ``ad-free``) says nothing, and beside a
name of main text (``post social``) the others say nothing.  An element of such a
kind around over half of the page's words that also holds a main text, a heading
of first rank or a part of the page is taken for a wrapper.  An element marked as
main text is believed if it holds ``SHARE`` of the page's words.

Defined results: null or empty html gives an empty text; an unclosed element
ends with its parent, at a block that can't lie in it, or with the page, an
unclosed title or text field at the next tag; scripts, styles and markup comments
are never text; of equal runs the first counts; every row gives a row; other
columns are ignored.  All passes are linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_labels
from .common import load, small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|\"|')*+)(?:>|(?=<)|\Z)", re.S
)
_ATTR = re.compile(r"([A-Za-z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no text of the page; those whose end a page may lack.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
_TO_END = {"script", "style"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
    "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_KIND = {
    "nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "select": "form", "label": "form",
    "search": "form", "dialog": "notice", "article": "main", "main": "main",
}
#: Parts of a page that a menu can't hold.
_ENDS_NAV = {"article", "main", "footer", "aside", "header"}
#: Words of a class, id or role by the kind they tell.
_NAMES = {
    "comment": "comment comments commentlist commentary disqus respond replies reply discussion",
    "advert": "ad ads advert adverts advertisement advertising adsense adbox adslot banner promo promotion sponsor sponsored dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription paywall overlay toast disclaimer",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "side": "sidebar aside widget widgets related recommended recommendations share sharing social tags trending popular teaser teasers complementary",
    "foot": "footer foot copyright contentinfo colophon",
    "head": "masthead topbar header logo",
    "form": "form search login signup",
}
_KIND_OF = {w: k for k, words in _NAMES.items() for w in words.split()}
_MAIN = set("content article post entry main story body text hentry".split())
_LAYOUT = set("has with no without non free layout by col cols column columns grid is".split())
_SPLIT = re.compile(r"[^a-z]+")
#: Kinds that may be told of an element that is really around the page.
_WRAPS = {"side", "advert", "notice", "head", "foot", "form", "nav"}
#: Share of the page's words that a main text must hold, told by its tag or by a name.
SHARE = {True: 0.1, False: 0.25}
_GROUP = {"a": "a", "li": "li", "ul": "li", "ol": "li", "p": "p", "br": "p", **{f"h{k}": "p" for k in range(1, 7)}, "blockquote": "p", "td": "cell", "tr": "cell", "th": "cell", "table": "cell"}


def kind_of(tag: str, attrs: str) -> tuple[str, bool]:
    """The kind that an element tells ('' for none), and whether by its tag."""
    told = _KIND.get(tag, "")
    if attrs and tag not in ("html", "body"):
        kinds, main = [], False
        for m in _ATTR.finditer(attrs):
            if m[1].lower() in ("class", "id", "role"):
                for name in (m[2] or m[3] or m[4] or "").split():
                    words = [w for w in _SPLIT.split(name.lower()) if w]
                    if _LAYOUT.intersection(words):
                        continue
                    bad = next((_KIND_OF[w] for w in words if w in _KIND_OF), "")
                    if bad == "head" and _MAIN.intersection(words):  # a heading of the text
                        continue
                    if bad:
                        kinds.append(bad)
                    else:
                        main = main or bool(_MAIN.intersection(words))
        if told in ("", "main") and kinds and not main:
            return kinds[0], False
        if not told and main:
            return "main", False
    return told, bool(told)


class Page:
    """A page's tokens, and its elements in page order (parents first)."""

    def __init__(self, text: str):
        #: ``w`` (text as it stands), ``t`` (inline tag) or ``b`` (end of a block); element; value.
        self.rows: list[tuple[str, int, str, str]] = []
        self.up, self.kind, self.by_tag, self.link, self.part = [-1], [""], [False], [False], [False]
        self._read(text)
        self._resolve()

    def _read(self, text: str) -> None:
        stack, depth, at, n, never = [(0, "")], Counter(), 0, len(text), set()
        while at < n:
            m = _TOKEN.search(text, at)
            end = m.start() if m else n
            if end > at:
                self.rows.append(("w", stack[-1][0], "", text[at:end]))
            if not m:
                return
            at = max(m.end(), end + 1)
            if not m[2]:
                continue
            tag, closing = m[2].lower(), m[1] == "/"
            if closing:
                if depth[tag]:
                    while True:
                        name = stack.pop()[1]
                        depth[name] -= 1
                        if name == tag:
                            break
            elif tag in _RAW:
                if not m[3].rstrip().endswith("/"):
                    close = None if tag in never else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                    if close:
                        at = close.end()
                    else:
                        never.add(tag)
                        stop = n if tag in _TO_END else text.find("<", at)
                        at = stop if stop >= 0 else n
            elif tag not in _VOID and not m[3].endswith("/"):
                if tag in _BLOCK:  # an open inline element or paragraph ends here
                    while stack[-1][1] and (stack[-1][1] not in _BLOCK or stack[-1][1] == "p" or tag == stack[-1][1] == "li"):
                        depth[stack.pop()[1]] -= 1
                    if tag in _ENDS_NAV and depth["nav"]:
                        while True:
                            name = stack.pop()[1]
                            depth[name] -= 1
                            if name == "nav":
                                break
                kind, by_tag = kind_of(tag, m[3])
                self.up.append(stack[-1][0])
                self.kind.append(kind)
                self.by_tag.append(by_tag)
                self.link.append(tag == "a" or self.link[stack[-1][0]])
                self.part.append(kind == "main" or tag in ("h1", "nav", "header", "footer"))
                stack.append((len(self.up) - 1, tag))
                depth[tag] += 1
            self.rows.append(("b" if tag in _BLOCK else "t", stack[-1][0], tag, " " if tag == "br" else ""))

    def _resolve(self) -> None:
        """What surrounds each element: the kind that holds there, or ``main``,
        ``beside`` a main text, or ``free`` on a page without one."""
        n = len(self.up)
        self.size = [len(v.split()) if w == "w" else 0 for w, _, _, v in self.rows]
        words, talk = [0] * n, [False] * n  # words outside links, menus and comments
        for e in range(1, n):
            talk[e] = talk[self.up[e]] or self.kind[e] == "comment" or self.kind[e] == "nav" and self.by_tag[e]
        for (_, e, _, _), k in zip(self.rows, self.size):
            if k and not self.link[e] and not talk[e]:
                words[e] += k
        holds = [False] * n
        for e in range(n - 1, 0, -1):
            words[self.up[e]] += words[e]
            holds[self.up[e]] = holds[self.up[e]] or holds[e] or self.part[e]
        at = [""] * n
        for e in range(1, n):
            over, kind = at[self.up[e]], self.kind[e]
            if kind in _WRAPS and 2 * words[e] > words[0] and holds[e]:
                kind = ""
            if not kind or kind == "main" and over or kind == "head" and over == "main":
                at[e] = over
            else:
                at[e] = kind
        # Words of main texts, and of all that is of no other kind.
        held, of = {True: 0, False: 0}, [False] * n
        every = 0
        for e in range(1, n):
            of[e] = self.by_tag[e] if self.kind[e] == "main" else of[self.up[e]]
        for (_, e, _, _), k in zip(self.rows, self.size):
            if k and at[e] in ("", "main") and not self.link[e]:
                every += k
                if at[e]:
                    held[of[e]] += k
        marks = any(k and k >= SHARE[by_tag] * every for by_tag, k in held.items())
        self.at = [("main" if marks else "free") if a == "main" else a or ("beside" if marks else "free") for a in at]

    def kinds(self) -> list[tuple]:
        """The key of each token's weight."""
        out: list[tuple] = []
        start = 0
        for end in range(len(self.rows) + 1):
            if end < len(self.rows) and self.rows[end][0] != "b":
                continue
            n = sum(self.size[start:end])
            linked = sum(k for (_, e, _, _), k in zip(self.rows[start:end], self.size[start:end]) if self.link[e])
            look = (3 * linked > n, 0 if n < 4 else 1 if n < 15 else 2)
            for what, e, tag, _ in self.rows[start:end]:
                out.append(("w", self.at[e], *look) if what == "w" else ("t", self.at[e], _GROUP.get(tag, "")))
            if end < len(self.rows):
                out.append(("t", self.at[self.rows[end][1]], _GROUP.get(self.rows[end][2], "block")))
            start = end + 1
        return out


def weights(pages: list[str] | None = None) -> dict[tuple, float]:
    """The weights of words and tags by kind, from labelled pages."""
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text in html_labels.pages() if pages is None else pages:
        page, inside = Page(text), False
        for (what, _, _, value), key in zip(page.rows, page.kinds()):
            if what == "w":
                for k, part in enumerate(value.split(html_labels.MARK)):
                    inside ^= k > 0
                    seen[inside][key] += len(part.split())
            else:
                seen[inside][key] += 1
    out = {}
    for key in {*seen[True], *seen[False]}:
        a, b = seen[True][key] + 1, seen[False][key] + 1
        if key[1] in _NAMES:  # never main text, whatever is around it
            out[key] = 0.0
        elif key[0] == "w":
            out[key] = math.log(a / b)
        else:
            out[key] = -0.02 - 0.5 * b / (a + b)
    return out


_weights: list[dict[tuple, float]] = []


def _weight(key: tuple) -> float:
    """The weight of a kind; one that no label has counts as the least of its look."""
    if not _weights:
        _weights.append(weights())
    if key not in _weights[0]:
        like = [v for k, v in _weights[0].items() if k[:2] == key[:2]]
        _weights[0][key] = 0.0 if key[1] in _NAMES else min(like, default=0.0 if key[0] == "w" else -0.5)
    return _weights[0][key]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest positive sum, the
    first of equal ones; (0, 0) if there is none."""
    best, top, run, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, top = run, (start, k + 1)
    return top


def extract(text: str) -> str:
    """The main text of a page: blocks joined by newlines."""
    if not text:
        return ""
    page = Page(text)
    scores = [_weight(key) * (size if key[0] == "w" else 1) for key, size in zip(page.kinds(), page.size)]
    blocks, now = [], []
    for what, e, _, value in page.rows[slice(*best_run(scores))]:
        if what == "b":
            blocks.append("".join(now))
            now = []
        elif page.at[e] not in _NAMES:
            now.append(value)
    blocks.append("".join(now))
    lines = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n".join(t for t in lines if t)


def main_text(pages: DataFrame, keep: tuple[str, ...] = (), html_col: str = "html") -> DataFrame:
    """The kept columns, ``text`` and ``n_chars`` of every row."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(html_col).alias("_html"), *[F.col(k).alias(f"k_{k}") for k in keep])
    kinds, names = dict(rows.dtypes), [*keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p or "") for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(1 + k) for k in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return rows.mapInArrow(run, "".join(f"`{k}` {kinds[f'k_{k}']}, " for k in keep) + "text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return main_text(load(spark, sf_dir, "pages"), ("page_id", "url"))
