"""Layout-aware text of HTML pages: a tree builder with implied tags, and a renderer.

The builder closes what HTML lets authors leave open (paragraphs, list items, table
parts, options), ignores end tags that match nothing, and keeps what it can't parse
as text. The renderer leaves out what a browser doesn't show and lays out the rest:
white space collapses except in ``pre``, blocks start lines, paragraphs stand apart
by an empty line, list items carry markers and hang by their depth, and the cells of
a table line up in columns.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowsight.functions.scalars import col
from rowsight.llm.shared import bounded_batches
from rowsight.llm.words import slices

# fixed values: element kinds of HTML
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = {"title", "textarea"}
HIDDEN = set("head title script style template noscript noembed noframes iframe object audio video canvas svg math datalist meta link base param source track area col colgroup".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul".split()
)
APART = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
TABLE_PARTS = set("caption colgroup tbody td tfoot th thead tr".split())
CLOSES_P = BLOCKS - {"body", "dd", "dt", "html", "legend", "li", "optgroup", "option"} | {"dd", "dt", "li"}
#: start tag -> open elements that it ends, and the elements that shelter them
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: nesting beyond this makes siblings, as browsers have it
DEEPEST = 512

#: comments and declarations, or a tag up to its end or its first quote
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>\"']*+)", re.S)
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
NOT_SHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(\w+)", re.I)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None

    def number(self, name: str, default: int) -> int:
        m = re.match(r"\s*([+-]?\d{1,9})", self.get(name) or "")
        return int(m[1]) if m else default

    def displayed(self) -> bool:
        """Whether the element and what it holds has a place on the page."""
        if self.tag in HIDDEN:
            return False
        if self.tag == "dialog" and self.get("open") is None:
            return False
        if not self.attrs:
            return True
        if self.get("hidden") is not None or NOT_SHOWN.search(self.get("style") or ""):
            return False
        return not (self.tag == "input" and (self.get("type") or "").lower() == "hidden")

    def visible(self, inherited: bool) -> bool:
        """Whether its own text is seen: as its style says, else as its parent's."""
        found = VISIBILITY.findall(self.get("style") or "") if self.attrs else []
        return {"visible": True, "hidden": False, "collapse": False}.get(found[-1].lower(), inherited) if found else inherited


def seen(children: list, visible: bool = True) -> list:
    """``children`` without what is not displayed and without invisible text; what is visible inside
    invisible elements stays. Of closed details only the first summary is left."""
    out = []
    for child in children:
        if isinstance(child, str):
            if visible:
                out.append(child)
        elif child.displayed():
            own = child.visible(visible)
            if child.tag == "br" and not own:
                continue
            held = child.children
            if child.tag == "details" and child.get("open") is None:
                held = [c for c in held if isinstance(c, Element) and c.tag == "summary"][:1]
            child.children = seen(held, own)
            out.append(child)
    return out


def tag_end(html: str, at: int, bound: int, open_: set[int]) -> int:
    """Where the ``>`` of a tag is whose attributes go on at ``at``: the first outside of quotes, or the first
    at all if a quote is never closed; -1 if there is none before ``bound``.

    ``open_`` has the opening quotes from which the end was not reached; as the way from
    a quote on is always the same, each is passed once and a page takes linear time.
    """
    passed = []
    m = STOP.search(html, at, bound)
    while m and m[0] != ">":
        quote = m.start()
        passed.append(quote)
        close = -1 if quote in open_ else html.find(m[0], quote + 1, bound)
        m = STOP.search(html, close + 1, bound) if close >= 0 else None
    if m:
        return m.start()
    open_.update(passed)
    return html.find(">", at, bound)


def parse(html: str) -> Element:
    """The element tree of a page or fragment; strings are text with references resolved."""
    root = Element("#root")
    stack = [root]
    at, end = 0, len(html)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                stack.pop()
            stack[-1].children.append(unescape(s) if "&" in s else s)

    def close(tags: set, shelter: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in shelter:
                return
            if stack[i].tag in tags:
                del stack[i:]
                if not any(x.tag in tags for x in stack[1:]):
                    return
                return close(tags, shelter)

    bound = html.rfind(">") + 1  # no tag ends after the last one
    open_: set[int] = set()
    while m := TOKEN.search(html, at, bound):
        text(html[at : m.start()])
        tag = m["tag"]
        if not tag:
            at = m.end()
            continue
        stop_at = tag_end(html, m.end(), bound, open_)
        at = stop_at + 1
        tag, attrs = tag.lower(), html[m.start("attrs") : stop_at].strip()
        if m["end"]:
            if tag == "br":
                stack[-1].children.append(Element("br"))
            elif tag in VOID:
                pass
            else:
                shelter = {"table"} if tag in TABLE_PARTS else {"td", "th", "caption"} if tag not in ("table", "body", "html", "tr") else set()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in shelter:
                        break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "caption", "button"})
        if stack[-1].tag == "head" and tag in BLOCKS:
            stack.pop()
        element = Element(tag, attrs.rstrip("/"))
        stack[-1].children.append(element)
        if tag in RAW or tag in ESCAPABLE:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            inside = html[at : stop.start() if stop else end]
            element.children.append(unescape(inside) if tag in ESCAPABLE else inside)
            at = stop.end() if stop else end
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(element)
    text(html[at:])
    return root


class Lines:
    """Lines of a block under construction."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # empty lines due before what comes next
        self.space = False  # a collapsed space waits for a word

    def word(self, s: str) -> None:
        parts = SPACE.split(s)
        for i, part in enumerate(parts):
            if i and self.now:
                self.space = True
            if part:
                if self.space:
                    self.now.append(" ")
                    self.space = False
                self.now.append(part)

    def verbatim(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.line(True)
            if part:
                self.now.append(part)

    def line(self, forced: bool = False) -> None:
        if self.now or forced:
            if self.done:
                self.done.extend([""] * self.gap)
            self.gap = 0
            self.done.append("".join(self.now))
        self.now, self.space = [], False

    def block(self, lines: list[str], gap: int) -> None:
        self.line()
        if lines:
            if self.done:
                self.done.extend([""] * max(gap, self.gap))
            self.done.extend(lines)
            self.gap = gap

    def all(self) -> list[str]:
        self.line()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


def lay_out(children: list, pre: bool = False, depth: int = 0) -> list[str]:
    """Lines of the visible content of ``children``."""
    out = Lines()
    inline(children, out, pre, depth)
    return out.all()


def inline(children: list, out: Lines, pre: bool, depth: int) -> None:
    for child in children:
        if isinstance(child, str):
            out.verbatim(child) if pre else out.word(child)
        elif child.tag == "br":
            out.line(True)
        elif child.tag == "table":
            out.block(table(child, depth), 1)
        elif child.tag in ("ul", "ol", "menu", "dir"):
            out.block(listed(child, depth), 0 if depth else 1)
        elif child.tag in ("dd", "blockquote"):
            gap = int(child.tag == "blockquote")
            out.block(["  " + x if x else x for x in lay_out(child.children, pre, depth)], gap)
        elif child.tag in BLOCKS or child.tag in TABLE_PARTS:
            kept = pre or child.tag == "pre"
            body = child.children
            if child.tag == "pre" and body and isinstance(body[0], str) and body[0].startswith("\n"):
                body = [body[0][1:], *body[1:]]  # the line break after the tag is not content
            lines = lay_out(body, kept, depth)
            out.block(lines, int(child.tag in APART))
        else:
            inline(child.children, out, pre, depth)


def listed(element: Element, depth: int) -> list[str]:
    """Items with bullets or numbers; other content as it stands."""
    out = Lines()
    number = element.number("start", 1)
    rest: list = []
    for child in [*element.children, None]:
        if isinstance(child, Element) and child.tag == "li":
            out.block(lay_out(rest, False, depth + 1), 0)
            rest = []
            number = child.number("value", number) if element.tag == "ol" else number
            marker = f"{number}. " if element.tag == "ol" else "- "
            number += 1
            lines = lay_out(child.children, False, depth + 1)
            out.block([(marker if i == 0 else " " * len(marker)) + x if x or i == 0 else x for i, x in enumerate(lines)], 0)
        elif child is None:
            out.block(lay_out(rest, False, depth + 1), 0)
        else:
            rest.append(child)
    return out.all()


def table(element: Element, depth: int) -> list[str]:
    """Caption, then rows whose cells are padded to their columns, two spaces between."""
    rows: list[list[Element]] = []
    out = Lines()

    def gather(node: Element) -> None:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    out.word(child)
            elif child.tag == "tr":
                rows.append([c for c in child.children if isinstance(c, Element) and c.tag in ("td", "th")])
                stray = [c for c in child.children if not (isinstance(c, Element) and c.tag in ("td", "th"))]
                inline(stray, out, False, depth)
            elif child.tag in ("td", "th"):
                rows.append([child])
            elif child.tag in ("tbody", "thead", "tfoot"):
                gather(child)
            else:
                inline([child], out, False, depth)

    gather(element)
    grid: list[list[tuple[int, int, list[str]]]] = []  # of each row: column, columns, lines
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in rows:
        cells, column = [], 0
        fresh: dict[int, int] = {}
        for cell in row:
            while taken.get(column, 0) > 0:
                column += 1
            span = min(max(cell.number("colspan", 1), 1), 1000)
            down = cell.number("rowspan", 1)
            cells.append((column, span, lay_out(cell.children, False, depth)))
            if down > 1:
                fresh |= {c: down for c in range(column, column + span)}
            column += span
        taken = {c: n - 1 for c, n in (taken | fresh).items() if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, span, lines in cells:
            if span == 1 and lines:
                widths[column] = max(widths.get(column, 0), max(map(len, lines)))
    for cells in grid:  # what a cell over several columns lacks goes to its last one
        for column, span, lines in cells:
            if span > 1 and lines:
                there = [c for c in range(column, column + span - 1) if widths.get(c)]
                need = max(map(len, lines)) - sum(widths[c] + 2 for c in there)
                widths[column + span - 1] = max(widths.get(column + span - 1, 0), need)
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2 if widths[column] else 0
    body = []
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    place = next((starts[c] for c in range(column, column + 1001) if c in starts), len(line))
                    line = line.ljust(place) + lines[k]
            body.append(line.rstrip())
    out.block(body, 0)
    return out.all()


def render(html: str | None) -> str:
    """All visible text of a page; a null or empty page has none."""
    if not html:
        return ""
    limit = sys.getrecursionlimit()
    if limit < 20 * DEEPEST:
        sys.setrecursionlimit(20 * DEEPEST)
    return "\n".join(x.rstrip() for x in lay_out(seen(parse(html).children)))


def rendered(pages: DataFrame, html_col: str = "html", text: str = "text") -> DataFrame:
    """The columns of ``pages`` but ``html_col``, and the page's visible text as ``text``.

    A column named ``text`` other than the page's is replaced. Rows are independent, so
    repeated and null ids need no care. Null pages give empty text.
    """
    bounded_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, text)]
    rows = pages.select(*[col(c) for c in others], col(html_col).cast("string").alias(text))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(others)
        for batch in slices(batches, last):
            out = pa.array([render(x) for x in batch.column(last).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], out], names=batch.schema.names)

    return rows.mapInArrow(task, rows.schema)
