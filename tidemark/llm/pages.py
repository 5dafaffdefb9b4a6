"""Main text of web pages by scores on the element tree.

Paragraphs pass points for their length and commas to their ancestors, each level half of the one
below; a container's points shrink with the share of its text inside links.  The best container
is kept with those of its siblings that score well or are plain paragraphs.

A class, id or role that speaks of a menu, sidebar, advert and the like takes most of the points of what is
inside.  Only below the best container does such an element go, unless it holds the headline or an
article: it is then a wrapper and no part set apart.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import tidy

# Element names.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
APART = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "menu", "nav", "select"}
CONTENT = {"article", "main"}
#: Elements that the start of one of the second set ends.
CLOSES = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"},
    **{f"h{i}": BLOCKS for i in range(1, 7)},
}
#: Words of a class, id or role that set an element apart from the article.
APART_WORDS = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header legal login masthead menu modal nav navbar navigation"
    " newsletter notice notification pager pagination popup promo promoted promotion related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget".split()
)

#: First words of a class that says how a page is laid out, not what an element is.
STATES = {"has", "is", "no", "not", "with", "without"}
#: Share of the points that an element keeps whose class speaks against it.
MARKED = 0.1

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in RAW}


class _Node:
    __slots__ = ("name", "parent", "apart", "marked", "holds", "factor", "score", "chars", "linked")

    def __init__(self, name: str, parent: _Node | None, apart: bool, marked: bool):
        self.name, self.parent, self.apart, self.marked, self.holds = name, parent, apart, marked, False
        self.factor = max(1e-9, (parent.factor if parent else 1.0) * (MARKED if marked else 1.0))
        self.score, self.chars, self.linked = 0.0, 0, 0


def _marked(attributes: str) -> bool:
    """Whether a class, id or role sets the element apart."""
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _WORD.findall(token)
            if parts and parts[0] not in STATES and any(w in APART_WORDS for w in parts):
                return True
    return False


def _parse(page: str):
    """Nodes, parents first, and text blocks in page order as (text, characters in links, node)."""
    node = _Node("#root", None, False, False)
    nodes, blocks = [node], []
    parts: list[str] = []
    open_ = Counter()  # of the names of the node and its ancestors
    linked = at = links = 0

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text and not node.apart:
            blocks.append((text, min(linked, len(text)), node))
        parts.clear()
        linked = 0

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            linked += (len(page) - at) * (links > 0)
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                at = _END[name].search(page, at).end()
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS and name not in VOID:
            flush()
            links = 0
            if closing:
                while open_[name]:
                    open_[node.name] -= 1
                    last, node = node.name, node.parent
                    if last == name:
                        break
            else:
                while node.name in CLOSES and name in CLOSES[node.name]:
                    open_[node.name] -= 1
                    node = node.parent
                marked = bool(m[3]) and name not in ("body", "html") and _marked(m[3])
                if name == "h1" or name in CONTENT and not marked:
                    up = node
                    while up is not None and not up.holds:
                        up.holds, up = True, up.parent
                node = _Node(name, node, node.apart or name in APART or bool(m[3]) and name not in CONTENT and bool(_HIDDEN.search(m[3])), marked)
                nodes.append(node)
                open_[name] += 1
        elif name == "hr":
            flush()
    flush()
    return nodes, blocks


def main_text(page: str | None) -> str:
    """The article's blocks, joined by a line feed; empty if there is none."""
    nodes, blocks = _parse(page or "")
    for text, linked, node in blocks:
        node.chars += len(text)
        node.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    scored: list[_Node] = []
    for text, linked, node in blocks:
        if node.name in ("li", "td", "th") and 2 * linked > len(text):
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * node.factor
        up = node if node.name not in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li") else node.parent
        share = 1.0
        while up is not None and share > 0.01:
            if not up.score:
                scored.append(up)
                up.score = 25.0 * up.factor if up.name in CONTENT else 0.0
            up.score += points * share
            share /= 2
            up = up.parent
    if not scored:
        return ""
    value = lambda x: x.score * (1 - x.linked / max(1, x.chars))
    best = max(scored, key=value)
    kept = {id(best)}
    for other in nodes:
        if other.parent is best.parent and other is not best and not other.apart and not other.marked and other.chars and 4 * other.linked < other.chars and (value(other) >= max(10 * best.factor, 0.2 * value(best)) or other.name == "p" and other.chars > 80):
            kept.add(id(other))
    good: set[int] = set()  # nodes whose text is the article's
    for node in nodes:
        if id(node) in kept:
            good.add(id(node))
        elif id(node.parent) in good and not (node.marked and not node.holds) and not (node.name in ("ul", "ol", "table") and 2 * node.linked > node.chars):
            good.add(id(node))
    return "\n".join(text for text, _, node in blocks if id(node) in good)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``.

    A null or empty html, or one without an article, gives the empty text; a very long or deep page is read
    whole, in time that grows with its length.  Of equally good containers the first counts.  Repeated rows and
    rows without page_id stay; an empty table gives an empty result; other columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(_extracted), "page_id long, url string, text string, n_chars long")
