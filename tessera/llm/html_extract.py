"""Main text of web pages (operator 9): flat text blocks and a decision tree.

A page is cut into a flat list of text blocks at its block-level tags.  A block is described by its words and link
density, those of the blocks before and after it, and the kinds of elements that hold it; a decision tree,
trained on the small labelled table LABELLED, says which blocks are the article.  The tree is free to ask any of
these in any order.  Pages with and without landmarks (article, main, nav, ..) are in the table, so on pages that have none
the words and links of a block and its neighbours decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "canvas", "select", "option", "desc", "metadata"}
CONTROL = {"button", "datalist"}  # inside a paragraph, too, these are a form's
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = set("article aside body blockquote details dialog div dl fieldset figure footer form header html main menu nav ol search section table td ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "search"}
MAIN = {"article", "main"}
PLAIN = {"html", "body", "main"}  # what these are called says nothing about the texts in them

# Names in class, id and role attributes of what surrounds an article.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus discussion feedback sidebar"
    " widget related recommended trending share sharing social follow menu nav navbar navigation breadcrumb breadcrumbs header footer masthead topbar toolbar"
    " pagination pager skip legal copyright tagcloud contentinfo complementary search dialog form hidden".split()
)
# Words that such names are put together with.
WITH = set("area bar block bottom box buttons container content form global group icons inner item items left line link links list main outer page panel posts right row section site stories text top wrap wrapper".split())

# Words that name readers' comments, and those beside which they only tell of a page's state.
COMMENT = set("comment comments commentlist commentform commenter commenters reply replies respond disqus discussion".split())
STATE = set("open closed no has count counts enabled disabled on off allow allowed".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME = re.compile(r"[a-z]+")

FEATURES = ["side", "hint", "comment", "main", "beside", "header", "heading", "item", "words", "link_density", "words_before", "links_before", "words_after", "links_after"]


@dataclass
class Block:
    text: str
    links: int
    side: bool
    hint: bool
    comment: bool
    main: bool
    header: bool
    heading: bool
    item: bool
    keep: bool = False


def parts_of(name: str) -> list[str]:
    return NAME.findall(re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())


def named_aside(name: str) -> bool:
    """A whole name that is a hint, or hints put together with each other and with WITH."""
    parts = parts_of(name)
    return not HINTS.isdisjoint(parts) and all(x in HINTS or x in WITH for x in parts)


def hinted(attributes: str, element: str = "div") -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value.lower()):
            return True
        if element == "article":  # a comment may be one; an article's id is a topic
            if name == "class" and not HINTS.isdisjoint(value.lower().split()):
                return True
        elif element not in PLAIN and name in ("class", "id", "role") and any(map(named_aside, value.split())):
            return True
    return False


def commented(attributes: str, element: str) -> bool:
    """Does a part of a class or id name readers' comments?  What holds the whole page or an article is called so for its state."""
    names = [value.strip("\"'") for name, value in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id")]
    parts = [set(parts_of(n)) for value in names for n in value.split()]
    return element not in PLAIN and element != "article" and any(p & COMMENT and not p & STATE for p in parts)


def blocks_of(html: str | None) -> list[Block]:
    """The text blocks of a page, in its order."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    spans: list[list] = []  # open ones: is it set aside, where it begins in parts and linked, depth of the stack, inside a paragraph
    parts: list[str] = []
    linked: list[str] = []
    link = heading = item = keep = paragraph = False

    def add(words: list[str], links: list[str], aside: bool) -> None:
        text = " ".join(unescape("".join(words)).split())
        if text:
            names = {n for n, *_ in stack}
            out.append(
                Block(
                    text, len(unescape(" ".join(links)).split()), not SIDE.isdisjoint(names), aside or any(h for _, h, _ in stack), any(c for *_, c in stack),
                    not MAIN.isdisjoint(names), "header" in names, heading, item, keep,
                )
            )

    def close() -> None:
        """End a block.  What a span sets aside goes if it is a part of the block; if the span goes around it, that counts as a hint."""
        at, link_at, inside = next(((s[1], s[2], s[4]) for s in spans if s[0]), (len(parts), len(linked), False))
        around = at == 0 and not inside
        add(parts if around else parts[:at], linked if around else linked[:link_at], around and any(s[0] for s in spans))
        parts.clear()
        linked.clear()
        for s in spans:
            s[1] = s[2] = 0

    at, n = 0, len(html)
    while at < n:
        begin = html.find("<", at)
        m = TOKEN.match(html, begin) if begin >= 0 else None
        if begin < 0 or m is None:
            end = n if begin < 0 else begin + 1
            parts.append(html[at:end])
            if link:
                linked.append(html[at:end])
            at = end
            continue
        if begin > at:
            parts.append(html[at:begin])
            if link:
                linked.append(html[at:begin])
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if not name:
            continue
        closing = html[begin + 1] == "/"
        attributes = m[2] or m[4] or ""
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                found = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = found.end() if found else n
            continue
        if name in CONTROL:
            found = None if closing else re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = found.end() if found else at
            continue
        if name == "a":
            link = not closing
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "span":
            if not closing:
                if not attributes.rstrip().endswith("/"):
                    spans.append([bool(attributes) and (hinted(attributes) or commented(attributes, name)), len(parts), len(linked), len(stack), paragraph])
            elif spans:
                aside, p, q, *_ = spans.pop()
                if aside:  # its own words alone go; the text goes on behind it
                    del parts[p:], linked[q:]
            continue
        if name in BLOCK or name in HOLDERS:
            close()
            link = False
            paragraph = name == "p" and not closing
            spans = [s for s in spans if not s[4]]  # they end with their paragraph
            if name in ("p", "li", "dt", "dd", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section", "article", "ul", "ol"):
                heading = not closing and name[0] == "h" and name != "hr"
                item = not closing and (name == "li" or item and name == "p")
        if name in HOLDERS or name == "p" and attributes and not closing and (hinted(attributes) or commented(attributes, name)):
            if not closing:
                if name not in VOID and not attributes.rstrip().endswith("/"):
                    stack.append((name, hinted(attributes, name), commented(attributes, name)))
                    keep = keep or "data-keep" in attributes
            elif any(x == name for x, *_ in stack):
                while stack.pop()[0] != name:
                    pass
                spans = [s for s in spans if s[3] <= len(stack)]
                keep = keep and name != "section"
        elif closing and name == "p" and stack and stack[-1][0] == name:
            stack.pop()
        elif name == "p" and not closing and stack and stack[-1][0] == "p":
            stack.pop()
    close()
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    words = np.array([len(b.text.split()) for b in blocks], float)
    density = np.array([b.links for b in blocks], float) / np.maximum(words, 1)
    before, after = lambda x: np.concatenate(([0.0], x[:-1])), lambda x: np.concatenate((x[1:], [0.0]))
    has_main = any(b.main for b in blocks)
    flags = np.array([[b.side, b.hint, b.comment, b.main, has_main and not b.main, b.header, b.heading, b.item] for b in blocks], float).reshape(-1, 8)
    return np.column_stack([flags, words, density, before(words), before(density), after(words), after(density)]) if blocks else np.zeros((0, len(FEATURES)))


# The labelled table: small pages, each of a beginning, an article and an end; what lies in a section marked data-keep is
# the article.  _W, _S and _L are texts of one, a few and many words, in the numbers of LENGTHS.
_W, _S, _L = "@1", "@2", "@3"
_HEAD = f"<header><a href=/>Daily Post</a><p>{_S}</p></header><nav><ul><li><a href=/a>{_W}</a><li><a href=/b>{_S}</a></ul></nav>"
_FOOT = f"<aside><p>{_S}</p><p>{_L}</p></aside><footer><p>{_S}</p><a href=/c>us</a></footer>"
# Pages with landmarks.
BEGIN = [
    "",
    _HEAD,
    f"<nav><a href=/a>Home</a> {_L}</nav><div class=ad>{_S}</div>",
    f"<div><a href=/a>First story</a></div><div><a href=/b>{_S}</a> <a href=/c>Third</a></div>",
    f"<div class='cookie-notice'><p>{_L}</p><p>{_W}</p></div><aside><p>{_L}</p><p>{_S}</p></aside>",
    f"<div role=banner>{_L}</div><ul><li><a href=/a>{_S}</a></li><li><a href=/b>{_L}</a></li></ul><div>{_L}</div>",
    f"<form><label>Name</label><p>{_L}</p><button>{_S}</button></form><div id=menu>{_S}</div><div>{_S}</div>",
]
ARTICLE = [
    f"<article><section data-keep><h1>{_S}</h1><p>{_L}</p><p>{_S}</p><p>{_L} <a href=/x>More</a> {_S}</p><p>{_W}</p></section></article>",
    f"<article><section data-keep><h1>{_W}</h1><p>{_S}<br><p>{_L}<p>{_W}<p><a href=/x>{_S}</a> {_W}<p><a href=/x>{_L}</a></p></section><div class=comments><h3>Replies</h3><p>{_L}</p><p>{_S}</p></div></article>",
    f"<main><section data-keep><h2>{_S}</h2><p>{_L}</p><ul><li>{_S}</li><li><a href=/x>{_W}</a></li></ul><blockquote>{_S}</blockquote><table><tr><td>{_W}</td><td>{_L}</td></tr></table></section><aside><p>{_L}</p></aside></main>",
    f"<article><header><section data-keep><h1>{_W}</h1></section><p>By A. Writer, our reporter</p></header><section data-keep><p>{_L}</p><h2>{_S}</h2><p>{_S}</p></section><footer><p>{_L}</p></footer></article>",
    f"<main><nav><a href=/x>{_S}</a></nav><section data-keep><p>{_S}</p></section><form><p>{_S}</p></form></main>",
    f"<article><section data-keep><h1>{_S}</h1><p>{_L}</p><p>{_S}</p><p>{_L}</p></section><ol class=commentlist><li>{_L}</li><li><p>{_S}</p></li></ol></article>",
]
END = [
    "",
    _FOOT,
    f"<footer>{_L} <a href=/c>us</a></footer>",
    f"<div><a href=/d>Next page</a></div><div>{_W} <a href=/e>all rights</a></div><p>{_L}</p>",
    f"<div class=share><a href=/s>Share</a></div><div class=related><p>{_L}</p><p>{_S}</p></div>",
    f"<div class=comment-thread><div class=comment-body><p>{_L}</p><p>{_L}</p></div></div>",
    f"<section class=newsletter><p>{_L} {_L}</p><p>{_S}</p></section><p><a href=/c>{_L}</a></p><div>{_W}</div>",
]
# Pages that have none, or none around the article.
OPEN_BEGIN = [
    "",
    _HEAD,
    f"<div><a href=/a>{_W}</a></div><div><a href=/b>{_S}</a></div><div><a href=/c>{_W}</a> <a href=/d>{_W}</a></div>",
    f"<div>{_W}</div><ul><li><a href=/a>{_S}</a><li><a href=/b>{_W}</a></ul>",
    f"<div class=ad>{_S}</div><div class=sidebar><p>{_L}</p></div>",
    f"<table><tr><td><a href=/a>{_S}</a></td><td>{_W}</td><td><a href=/b>{_L}</a></td></tr></table>",
    f"<div>{_W}</div><div>{_S}</div><div><a href=/a>{_W}</a> {_W}</div>",
    f"<p>{_S}</p><p>{_W}</p><p><a href=/a>{_S}</a></p><div>{_W}</div>",
]
OPEN_ARTICLE = [
    f"<section data-keep><p>{_L}</p><p>{_L} {_L}</p><p>{_L} <a href=/x>here</a></p></section>",
    f"<div><section data-keep><h1>{_S}</h1><p>{_L}</p><p>{_S}</p><p>{_L}</p></section></div>",
    f"<section data-keep><h2>{_W}</h2><p>{_L} {_L}</p><p>{_S}</p><p>{_L} {_L}</p><h3>{_S}</h3><p>{_L}</p></section>",
    f"<div><section data-keep><div>{_L} {_L}</div><div>{_S} <a href=/x>{_W}</a></div><div>{_L}</div></section></div>",
    f"<div><section data-keep><h1>{_S}</h1><p>{_L} {_L}</p><ul><li>{_S}</li><li>{_L}</li></ul><p>{_L}</p></section></div>",
]
OPEN_END = [
    "",
    _FOOT,
    f"<div><a href=/d>Next page</a></div><div>{_W} <a href=/e>all rights</a></div>",
    f"<ul><li><a href=/c>{_S}</a></li><li><a href=/d>{_L}</a></li></ul><div>{_S}</div>",
    f"<div class=comments><p>{_L}</p><p>{_S}</p></div><div><a href=/d>{_W}</a></div>",
    f"<div id=post-comments><p>{_L}</p><p>{_L} {_L}</p><p>{_S}</p></div>",
    f"<p><a href=/d>{_S}</a></p><p>{_S}</p><p>{_W}</p><div>{_S} <a href=/d>{_W}</a></div>",
    f"<div>{_S}</div><div>{_W}</div><div><a href=/d>{_L}</a></div><div>{_S}</div>",
]
# Words of _W, _S and _L.
LENGTHS = [(1, 4, 25), (2, 7, 14), (1, 5, 40), (3, 9, 90), (1, 6, 20)]


def labelled_pages() -> list[str]:
    bodies = [a + b + c for a in BEGIN for b in ARTICLE for c in END]
    bodies += [a + b + c for a in OPEN_BEGIN for b in OPEN_ARTICLE for c in OPEN_END]
    fill = lambda body, sizes: re.sub("@[123]", lambda m: " ".join(["word"] * sizes[int(m[0][1]) - 1]), body)
    return [f"<body>{fill(body, sizes)}</body>" for body in bodies for sizes in LENGTHS]


def grown(x: np.ndarray, y: np.ndarray, depth: int = 14) -> tuple:
    """A decision tree by the Gini impurity: (feature, threshold, at or below, above), or a leaf's share of kept blocks."""
    share = float(y.mean()) if len(y) else 0.0
    start = share * (1 - share) * len(y)
    if depth == 0 or start == 0:
        return (share,)
    best = (0.5, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, kept_so_far = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])  # the last row at or below each threshold
        if not len(at):
            continue
        n, k = at + 1.0, kept_so_far[at]
        m, r = len(y) - n, kept_so_far[-1] - k
        gain = start - k * (1 - k / n) - r * (1 - r / m)
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), f, float(v[at[i]] + v[at[i] + 1]) / 2)
    if best[0] <= 0.5:
        return (share,)
    _, f, t = best
    low = x[:, f] <= t
    return (f, t, grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1))


def trained(pages: list[str] | None = None, without: tuple[str, ...] = ()) -> tuple:
    """The tree of the labelled pages; blocks that some features mark can be left out, so that they are never asked."""
    blocks = [blocks_of(p) for p in pages or labelled_pages()]
    x, y = np.concatenate([features_of(b) for b in blocks]), np.array([b.keep for p in blocks for b in p], float)
    told = x[:, [FEATURES.index(name) for name in without]].any(axis=1)
    return grown(x[~told], y[~told])


def asked(tree: tuple) -> set[str]:
    """The features that a tree asks."""
    return set() if len(tree) == 1 else {FEATURES[tree[0]]} | asked(tree[2]) | asked(tree[3])


def kept(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(html: str | None, tree: tuple) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, row in zip(blocks, features_of(blocks), strict=True) if kept(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line
    feed.  Of a paragraph that holds an advert or a notice as a span, the span's words alone go.  Blocks with the same features are alike
    for the tree, so ties among them fall one way.  Null and empty pages, and pages without an article, have an empty text.  Repeated rows and null ids or
    urls are kept.  Empty tables give empty results.  Other columns are not read.
    """
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), tree).encode("utf-8", "replace").decode() for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
