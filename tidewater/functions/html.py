"""HTML extraction with the standard library's parser, in Arrow batches.

One pass over a page builds a light tree; links, next pages, readable text and
search results are read off it. The rest (filters, first occurrences) is left
to DataFrame operators.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, parts that aren't text, and where articles are found.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNWANTED = {"script", "style", "nav", "header", "footer", "aside", "noscript"}
CONTENT = ("article", "main", ".article-content", ".contentDetail", ".content", ".TRS_Editor", ".news-content", "#content")
NEXT_TEXTS = {"下一页", "下页", "next", "Next", "NEXT", "»", "›"}
NAV_WIDE = ("nav", "menu", "header", "footer", "sidebar", "foot", "bottom", "friend", "copyright", "icp")
NAV_NARROW = ("nav", "menu", "header", "footer", "sidebar")
LEAST_CONTENT = 30
DATE = re.compile(r"[0-9]{4}[-./年][0-9]{1,2}[-./月][0-9]{1,2}")


#: A name after an ampersand, and what stands for the ampersand of one that is no reference (no text holds a lone surrogate).
_NAMED, _LITERAL = re.compile("&([A-Za-z][A-Za-z0-9]*)(;?)"), "\udc26"


def _references(html: str) -> str:
    """Names without their semicolon are text and no references, as to the parser of the reference (lxml's)."""
    return _NAMED.sub(lambda m: m[0] if m[2] and f"{m[1]};" in html5 else _LITERAL + m[0][1:], html)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.children))

    def find(self, test):
        return [n for n in self.walk() if isinstance(n, Node) and n is not self and test(n)]

    def text(self, sep: str = "", drop: frozenset | set = frozenset(), strip: bool = True) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                part = node.strip() if strip else node
                if part:
                    parts.append(part)
            elif node is self or node.tag not in drop:
                stack.extend(reversed(node.children))
        return sep.join(parts)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in self.classes()
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        tag, _, cls = selector.partition(".")
        return self.tag == tag and (not cls or cls in self.classes())

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, self._values(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, self._values(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data.replace(_LITERAL, "&"))

    @staticmethod
    def _values(attrs) -> dict:
        return {name: value and value.replace(_LITERAL, "&") for name, value in attrs}


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(_references(html or ""))
    builder.close()
    return builder.root


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match a selector of tags, classes and ids joined by descent."""
    *above, last = selector.split()
    out = []
    for node in root.find(lambda n: n.matches(last)):
        chain = node.ancestors()
        if all(any(a.matches(s) for a in chain) for s in reversed(above)):
            out.append(node)
    return out


def _navigates(node: Node, words: tuple[str, ...], ids: bool) -> bool:
    """Whether an element itself is navigation."""
    named = " ".join(node.classes()) + (" " + (node.attrs.get("id") or "") if ids else "")
    return node.tag in ("nav", "header", "footer") or any(w in named.lower() for w in words)


class Page:
    """A parsed page, with what links ask of the elements above them worked out once for each element."""

    def __init__(self, html: str | None):
        self.root = tree(html)
        self._inside: dict[tuple[str, ...], dict[Node, bool]] = {}
        self.spans: dict[Node, tuple[int, int]] = {}
        parts: list[str] = []
        at, stack = 0, [(self.root, False)]
        while stack:  # the page's text in one piece, and where each element's lies in it
            node, ended = stack.pop()
            if isinstance(node, str):
                parts.append(node)
                at += len(node)
            elif ended:
                self.spans[node] = (self.spans[node][0], at)
            else:
                self.spans[node] = (at, at)
                stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))
        self.text = "".join(parts)
        self.dates = [m.start() for m in re.finditer(f"(?={DATE.pattern})", self.text)]

    def inside(self, node: Node, words: tuple[str, ...], ids: bool) -> bool:
        """Whether an element lies in navigation."""
        known, path, above = self._inside.setdefault((*words, str(ids)), {}), [], node.parent
        while above is not None and above not in known:
            path.append(above)
            above = above.parent
        found = above is not None and known[above]
        for n in reversed(path):
            found = known[n] = found or _navigates(n, words, ids)
        return found

    def date_in(self, node: Node | None) -> str:
        """The first date in an element's text."""
        if node is None:
            return ""
        start, end = self.spans[node]
        for i in range(bisect.bisect_left(self.dates, start), len(self.dates)):
            if self.dates[i] >= end:
                break
            if m := DATE.match(self.text, self.dates[i], end):
                return m.group()
        return ""


def dashed(found: str) -> str:
    return re.sub("[年月./]", "-", found)


def link_date(page: Page, a: Node) -> str:
    """Date of a link: a panel with day and month, its own text, or its parent's."""
    for panel in a.find(lambda n: "panel_date" in n.classes())[:1]:
        numbers = [n.text() for n in panel.find(lambda n: n.tag in ("h2", "p"))]
        if len(numbers) > 1:
            return numbers[1].replace("/", "-") + "-" + numbers[0].zfill(2)
    return dashed(page.date_in(a) or page.date_in(a.parent))


def links(html: str | None, selectors: list[str] | None = None) -> list[dict]:
    """Links of a page in order: pos, title, heading, href, date, and whether they lie in navigation."""
    page = Page(html)
    nodes = [n for s in selectors for n in select(page.root, s)] if selectors else page.root.find(lambda n: n.tag == "a" and "href" in n.attrs)
    out = []
    for i, a in enumerate(nodes):
        heads = a.find(lambda n: n.tag in ("h2", "h3", "h4", "h5"))
        title = a.text()
        out.append(
            {
                "pos": i, "title": title, "heading": heads[-1].text() if heads else title, "href": a.attrs.get("href") or "", "date": link_date(page, a),
                "nav_wide": page.inside(a, NAV_WIDE, True), "nav_narrow": page.inside(a, NAV_NARROW, False),
            }
        )
    return out


def next_page(html: str | None, url: str) -> str | None:
    """The next page's URL: by a link's text, else rel, else class."""
    anchors = tree(html).find(lambda n: n.tag == "a" and "href" in n.attrs)
    usable = lambda a: (h := a.attrs.get("href") or "") and not h.startswith(("javascript:", "#"))
    for a in anchors:
        if a.text() in NEXT_TEXTS and usable(a):
            return urljoin(url, a.attrs["href"])
    for a in [a for a in anchors if "next" in (a.attrs.get("rel") or "").split()][:1]:
        if usable(a):
            return urljoin(url, a.attrs["href"])
    for a in anchors:
        if "next" in " ".join(a.classes()).lower() and usable(a):
            return urljoin(url, a.attrs["href"])
    return None


def readable(html: str | None, limit: int = 5000) -> str:
    """Text of the first content element that has enough, else of the body; white space collapsed."""
    root = tree(html)
    chosen = None
    for selector in CONTENT:
        for node in select(root, selector)[:1]:
            if not _dropped(node) and len(node.text("", UNWANTED)) >= LEAST_CONTENT:
                chosen = node
        if chosen is not None:
            break
    if chosen is None:
        bodies = root.find(lambda n: n.tag == "body")
        chosen = bodies[0] if bodies else root
    return re.sub(r"\s+", " ", chosen.text(" ", UNWANTED)).strip()[:limit]


def _dropped(node: Node) -> bool:
    return any(a.tag in UNWANTED for a in node.ancestors())


def search_results(html: str | None) -> list[dict]:
    """Results of a search page: title, href, summary, account, time text."""
    out = []
    for box in select(tree(html), "div.txt-box"):
        first = lambda *s: next((n for x in s for n in select(box, x)), None)  # noqa: E731, B023
        a = first("h3 a", "a")
        if a is None or not a.text() or not a.attrs.get("href"):
            continue
        summary, account, when = first("p.txt-info", "p"), first("span.all-time-y2", "a.account"), first("span.s2", "span.time")
        out.append(
            {
                "pos": len(out), "title": a.text(), "href": a.attrs["href"], "summary": summary.text() if summary else "",
                "account": account.text() if account else "", "time_text": when.text() if when else "",
            }
        )
    return out


_INT, _TEXT, _FLAG = T.IntegerType(), T.StringType(), T.BooleanType()
_ARROW = {_INT: pa.int32(), _TEXT: pa.string(), _FLAG: pa.bool_()}


def _rows(**fields: T.DataType) -> tuple[T.ArrayType, pa.DataType]:
    """An array of rows as Spark's type and as Arrow's."""
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()])), pa.list_(pa.struct([(n, _ARROW[t]) for n, t in fields.items()]))


LINKS, _LINKS = _rows(pos=_INT, title=_TEXT, heading=_TEXT, href=_TEXT, date=_TEXT, nav_wide=_FLAG, nav_narrow=_FLAG)
RESULTS, _RESULTS = _rows(pos=_INT, title=_TEXT, href=_TEXT, summary=_TEXT, account=_TEXT, time_text=_TEXT)

#: Bytes of pages that are Python objects at a time, and with them what is made of them.
SLICE = 500_000

#: Where lists of notices have their links unless a source says otherwise.
LIST_SELECTORS = ["ul li a", "table td a", "div.list a"]


def _by_slices(work: Callable, kind: pa.DataType, pages: pa.Array, *more: pa.Array) -> pa.Array:
    """`work` of each page (and of its values in `more`), a few pages at a time; in between all is Arrow's."""
    size = np.asarray(pc.fill_null(pc.binary_length(pages), 0), dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1).tolist(), len(pages)]
    parts = [pa.array([work(*row) for row in zip(*(c.slice(a, b - a).to_pylist() for c in (pages, *more)))], kind) for a, b in zip(edges, edges[1:])]
    return pa.concat_arrays(parts)


# Marked as nondeterministic so that Spark never copies a call: a filter on what a page gave would parse it twice.
def links_column(selectors: list[str] | None = None):
    @F.arrow_udf(LINKS)
    def parse(html: pa.Array) -> pa.Array:
        return _by_slices(lambda h: links(h, selectors), _LINKS, html)

    return parse.asNondeterministic()


@F.arrow_udf(RESULTS)
def results_column(html: pa.Array) -> pa.Array:
    return _by_slices(search_results, _RESULTS, html)


@F.arrow_udf(T.StringType())
def readable_column(html: pa.Array) -> pa.Array:
    return _by_slices(readable, pa.string(), html)


@F.arrow_udf(T.StringType())
def next_page_column(html: pa.Array, url: pa.Array) -> pa.Array:
    return _by_slices(lambda h, u: next_page(h, u or ""), pa.string(), html, url)


results_column, readable_column, next_page_column = (f.asNondeterministic() for f in (results_column, readable_column, next_page_column))
