"""Main text of web pages by tree scoring.

Paragraphs earn points for length and commas and pass them to their ancestors,
less with each step up. A container's points are discounted by the share of its
text that stands in links. The best container is kept, with those siblings that
score or read like a part of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.scratch import with_columns

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table ul".split())
# What is never a part of the article: elements, roles, and words of class and id.
JUNK = frozenset("nav header footer aside form script style noscript iframe template head button select textarea input svg object menu dialog title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_COMMENT = re.compile(r"--!?>")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("blockquote dl figure ol pre section table ul".split())

_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("block", "children", "junk", "linked", "name", "own", "parent", "points", "size")

    def __init__(self, name: str, parent: Node | None, junk: bool):
        self.name, self.parent, self.junk = name, parent, junk
        self.block = name in BLOCK
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = self.own = 0


def _is_junk(name: str, attrs: str) -> bool:
    if name in JUNK:
        return True
    if not attrs.strip() or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and any(w.lower() in WORDS for w in _SPLIT.split(html.unescape(value))):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag; comments and declarations have no name.

    Every character is scanned a bounded number of times. A quote that is never
    closed is a plain character. If quotes swallow all that is left, the tag and
    those after it end at the next >. What starts a tag without any > is text.
    A caller may send a position to go on from.
    """
    at, last, quoted = 0, page.rfind(">"), True
    ends = {q: page.rfind(q) for q in "\"'"}
    while (start := page.find("<", at)) >= 0 and (start < last or page.startswith("<!--", start)):
        at = start + 1
        if page.startswith("!--", at):
            m = _COMMENT.search(page, start + 4)
            at = m.end() if m else len(page)
            at = (yield start, at, "", "", "") or at
            continue
        if page[at : at + 1] in ("!", "?"):
            at = page.find(">", at) + 1
            at = (yield start, at, "", "", "") or at
            continue
        m = _NAME.match(page, at)
        if not m:
            continue
        to = _PLAIN.match(page, m.end()).end() if quoted else page.find(">", m.end())
        while quoted and to < len(page) and page[to] != ">":
            q = page[to]
            to = _PLAIN.match(page, page.find(q, to + 1) + 1 if to < ends[q] else to + 1).end()
        if to >= len(page):
            quoted = False
            to = page.find(">", m.end())
        at = to + 1
        at = (yield start, at, m[1], m[2].lower(), page[m.end() : to]) or at


def tree(page: str) -> Node:
    """The element tree; unclosed and stray tags are mended as browsers mostly do."""
    root = at = Node("#root", None, False)
    opened: Counter[str] = Counter()
    end, found = 0, tags(page)
    go_on = None

    def upto(node: Node) -> None:
        nonlocal at
        while at is not node:
            opened[at.name] -= 1
            at = at.parent

    while True:
        try:
            start, stop, slash, name, attrs = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > end:
            at.children.append(html.unescape(page[end:start]))
        end = stop
        if not name:
            continue
        if slash:
            up = at
            while opened[name] and up.name != name:
                if up.name in FENCE and name not in FENCE:
                    up = root
                    break
                up = up.parent
            if opened[name] and up is not root:
                upto(up.parent)
            elif name == "p":
                at.children.append(Node("p", at, False))
            continue
        if name in CLOSES_P and opened["p"]:
            up = at
            while up.parent is not None and up.name != "p" and up.name not in FENCE:
                up = up.parent
            if up.name == "p":
                upto(up.parent)
        if name in SAME and any(opened[x] for x in SAME[name]):
            up = at
            while up.parent is not None and up.name not in SAME[name] and up.name not in FENCE:
                up = up.parent
            if up.name in SAME[name]:
                upto(up.parent)
        node = Node(name, at, at.junk or _is_junk(name, attrs))
        at.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, end)
            end = go_on = close.end() if close else len(page)
        elif name not in VOID and not attrs.endswith("/"):
            at = node
            opened[name] += 1
    if end < len(page):
        at.children.append(html.unescape(page[end:]))
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that aren't junk, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.junk]
    return out


def _text(node: Node) -> str:
    """Text of a paragraph without nested blocks."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.name == "br":
            parts.append(" ")
        elif not c.junk and not c.block:
            stack += reversed(c.children)
    return _SPACE.sub(" ", "".join(parts)).strip()


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if not (node.block or node.parent is None):
            continue
        text = _text(node)
        node.own = len(text)
        if not text or node.name[0] == "h" and len(node.name) == 2:
            continue
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 10)
        up = node.parent if node.name in ("p", "li", "pre", "td", "dd", "dt") and node.parent is not None else node
        share = 1.0
        while up is not None and share > 0.05:
            if up.block or up.parent is None:
                up.points += points * share
                share /= 2
            up = up.parent
    for node in reversed(nodes):
        linked = node.name == "a"
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
            elif not c.junk:
                node.size += c.size
                node.linked += c.linked
        if linked:
            node.linked = node.size


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _blocks(nodes: list[Node]) -> list[str]:
    """Blocks below nodes in page order; inline runs between blocks are blocks too."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        c = stack.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            line.append(c)
        elif c.name == "br":
            line.append(" ")
        elif not c.junk:
            if c.block:
                flush()
                stack.append(None)
            stack += reversed(c.children)
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text: one line for each block, empty if there is none."""
    if not page or not page.strip():
        return ""
    root = tree(page)
    nodes = _walk(root)
    _score(nodes)
    best = max((n for n in nodes if n.points > 0), key=lambda n: n.points * (1 - _density(n)), default=None)
    if best is None:
        return "\n".join(_blocks([root]))
    kept = [best]
    if best.parent is not None and best.name not in ("body", "html"):
        least = max(6.0, 0.2 * best.points)
        kept = [c for c in best.parent.children if c is best or isinstance(c, Node) and not c.junk and _belongs(c, least)]
    return "\n".join(_blocks(kept))


def _belongs(node: Node, least: float) -> bool:
    """Whether a sibling of the best container is a part of the text: by its points, or as a heading, paragraph, section, list or table with few links."""
    links = _density(node)
    if node.points * (1 - links) >= least or node.name in HEADINGS:
        return True
    if node.name == "p":
        return node.own > 80 and links < 0.25 or node.own > 0 and links == 0 and _text(node)[-1:] in ".!?"
    return node.name in PARTS and node.size > 0 and links < 0.25


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with a text column (replaced if there), the main text of each page.

    Null, empty and text-free pages: an empty text. Broken markup is mended, very
    long pages are read whole, rows are independent, so repeated rows, null urls
    and other columns stay as they are. Nothing is cut from the kept container
    but menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments.
    """
    pages = pages.drop(text_col) if text_col != html_col else pages
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return pages.mapInArrow(run, with_columns(pages, **{text_col: "string"}))
