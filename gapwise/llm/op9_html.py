"""Layout-aware text of web pages.

A tree builder with implied tags and a walk that knows what is visible: block spacing, line breaks, nested lists with
their marks, preformatted text, and tables with aligned cells.  Every visible character of text comes out.

Time and output grow with the page, whatever it nests or leaves open.  Open elements are known by name, so that none
is looked for in a deep stack; the next quote and the next ``>`` are searched once.  Layout has bounds, text has not:
lines of up to ``COLUMN`` characters make a column wide, longer ones reach over its end; a table that alignment would make more than
``SPREAD`` times as large as its text has two spaces between cells instead; indents stop growing after ``INDENTS`` levels; tables
in more than ``NESTED`` others are laid out as blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

RESULT = "page_id bigint, text string, n_blocks bigint, n_tables bigint"

# Fixed sets of element names, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ESCAPABLE = frozenset(("textarea", "title"))
HIDDEN = frozenset(
    "head script style template noscript title meta link base iframe noembed noframes object audio video canvas svg datalist area param source track".split()
)
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary ul".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu".split())
ROW_GROUPS = frozenset("thead tbody tfoot".split())
CELLS = frozenset(("td", "th"))
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = (BLOCKS | {"table", "xmp"}) - {"html", "body", "option", "optgroup", "legend"}

# Start tags that end an open element of the second set, up to the third.
IMPLIED = (
    (frozenset(("li",)), frozenset(("li",)), LISTS),
    (frozenset(("dt", "dd")), frozenset(("dt", "dd")), frozenset(("dl",))),
    (frozenset(("option",)), frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    (frozenset(("optgroup",)), frozenset(("option", "optgroup")), frozenset(("select",))),
    (CELLS, CELLS, frozenset(("table",))),
    (frozenset(("tr",)), CELLS | {"tr"}, frozenset(("table",))),
    (ROW_GROUPS | {"caption", "colgroup"}, CELLS | {"tr", "caption", "colgroup"} | ROW_GROUPS, frozenset(("table",))),
)

# Bounds of layout: widest column, growth by alignment, levels of indents and of tables.
COLUMN, SPREAD, INDENTS, NESTED = 80, 8, 40, 20
#: Characters within which a tag must end for ``>`` in its quoted values not to end it.
QUOTED = 1 << 16

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_END_OR_QUOTE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


# -- building ------------------------------------------------------------------------------


class _Next:
    """Where a character occurs next, for places that only grow: each stretch of the page is searched once."""

    def __init__(self, page: str, character: str):
        self.page, self.character, self.at = page, character, -1

    def after(self, start: int) -> int:
        """The first place from ``start`` on, or the page's length."""
        if self.at < start:
            found = self.page.find(self.character, start)
            self.at = len(self.page) if found < 0 else found
        return self.at


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start" or "end", name, attributes) in order; comments and declarations are left out."""
    at, size = 0, len(page)
    closers, quotes = _Next(page, ">"), {'"': _Next(page, '"'), "'": _Next(page, "'")}

    def tag_end(start: int) -> int:
        """Place of the ``>`` that ends a tag; one in quotes does not, unless the tag would be too long."""
        place = start
        while place < min(size, start + QUOTED):
            found = _END_OR_QUOTE.search(page, place)
            if found is None:
                break
            if found[0] == ">":
                return found.start()
            place = quotes[found[0]].after(found.end()) + 1
        return closers.after(start)

    while at < size:
        next_at = page.find("<", at)
        if next_at < 0:
            yield "text", entities.unescape(page[at:]), ""
            return
        if next_at > at:
            yield "text", entities.unescape(page[at:next_at]), ""
        if page.startswith("<!--", next_at):
            end = page.find("-->", next_at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", next_at):
            end = page.find("]]>", next_at)
            yield "text", page[next_at + 9 : size if end < 0 else end], ""
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), next_at):
            end = page.find(">", next_at)
            at = size if end < 0 else end + 1
            continue
        tag = _NAME.match(page, next_at) if closers.after(next_at) < size else None
        if tag is None:
            yield "text", "<", ""
            at = next_at + 1
            continue
        name = tag[2].lower()
        end = tag_end(tag.end())
        at = end + 1
        if tag[1]:
            yield "end", name, ""
            continue
        yield "start", name, page[tag.end() : end]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            end = close.start() if close else size
            raw = page[at:end]
            yield "text", entities.unescape(raw) if name in ESCAPABLE else raw, ""
            at = end
        elif name == "plaintext":
            yield "text", page[at:], ""
            return


class _Open:
    """The open elements, outermost first, and where each name is open."""

    def __init__(self) -> None:
        self.nodes = [Node("#root")]
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of ``names``; 0 if none is open."""
        found, places = 0, self.places
        for name in names:
            open_at = places.get(name)
            if open_at and open_at[-1] > found:
                found = open_at[-1]
        return found

    def within(self, names: Iterable[str], until: Iterable[str]) -> int:
        """Place of the innermost open element of ``names`` if no element of ``until`` is open inside it, else 0."""
        place = self.last(names)
        return place if place and place >= self.last(until) else 0

    def push(self, node: Node) -> None:
        self.top.children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def close(self, names: Iterable[str], until: Iterable[str]) -> None:
        """Close all elements of ``names`` that are open within ``until``."""
        while place := self.within(names, until):
            self.cut(place)


def build(page: str) -> Node:
    """The tree of a page.  Unknown end tags are ignored, open elements are closed as HTML implies."""
    stack = _Open()
    cells = CELLS | {"caption", "table"}
    in_table = ROW_GROUPS | {"table", "tr"}
    for kind, name, rest in tokens(page):
        top = stack.top
        if kind == "text":
            if top.tag in in_table and not name.strip():
                continue
            if top.tag in in_table:  # misplaced text stands before the table
                siblings = stack.nodes[max(stack.last(("table",)), 1) - 1].children
                siblings.insert(len(siblings) - 1, name)
                continue
            top.children.append(name)
            continue
        if kind == "end":
            if name == "br":
                top.children.append(Node("br"))
            elif name not in VOID:
                stack.cut(stack.within((name,), cells if name not in cells | {"tr"} | ROW_GROUPS else ()) or len(stack.nodes))
            continue
        if name in ("html", "body", "head") and stack.last((name,)):
            continue
        if name in CLOSES_P:
            stack.close(("p",), cells | {"button"})
        if name in HEADINGS and top.tag in HEADINGS and stack.top is top:
            stack.cut(len(stack.nodes) - 1)
        if name == "body":
            stack.close(("head",), ())
        elif name not in HIDDEN and name not in ("html", "frameset") and stack.top.tag == "head":
            stack.cut(len(stack.nodes) - 1)  # the head ends where content begins
        for starts, ended, until in IMPLIED:
            if name in starts:
                stack.close(ended, until)
        if name == "tr" and stack.top.tag == "table":
            stack.push(Node("tbody"))
        if name in CELLS and stack.top.tag in ("table", *ROW_GROUPS):
            if stack.top.tag == "table":
                stack.push(Node("tbody"))
            stack.push(Node("tr"))
        if name == "a":
            stack.close(("a",), cells)
        node = Node(name, {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {})
        if name in VOID or (rest.endswith("/") and name in ("svg", "path")):
            stack.top.children.append(node)
        else:
            stack.push(node)
    return stack.nodes[0]


# -- rendering ------------------------------------------------------------------------------


def visible(node: Node) -> bool:
    """Whether an element is rendered, by its name, its ``hidden`` attribute and its own style."""
    if node.tag in HIDDEN or (node.tag == "input"):
        return False
    own = node.attributes
    if "hidden" in own and own["hidden"].lower() != "until-found":
        return False
    if node.tag == "dialog" and "open" not in own:
        return False
    return not _UNSEEN.search(own.get("style", ""))


class Flow:
    """Lines of one block context: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.blocks = False, 0, 0
        self.indents: list[str] = []
        self.mark = ""

    def text(self, text: str) -> None:
        if not text:
            return
        folded = _SPACE.sub(" ", text)
        if folded[0] == " ":
            self.space = True
        inner = folded.strip(" ")
        if not inner:
            return
        if self.line and self.space:
            self.line.append(" ")
        self._begin()
        self.line.append(inner)
        self.space = folded[-1] == " "

    def _begin(self) -> None:
        if not self.line:
            self.blocks += 1
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            indent = "".join(self.indents[:INDENTS])
            if self.mark:
                indent = (indent[: -len(self.mark)] if len(self.indents) <= INDENTS else indent) + self.mark
                self.mark = ""
            self.line = [indent] if indent else []

    def exact(self, text: str) -> None:
        """Preformatted text: its own line ends and spaces."""
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self._begin()
            self.line.append(first)
        for part in rest:
            self.end_line(keep=True)
            if part:
                self._begin()
                self.line.append(part)

    def whole(self, line: str) -> None:
        """A line of its own, as it is."""
        self._begin()
        if line:
            self.line.append(line)
        self.end_line()

    def end_line(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        elif keep and self.lines:
            self.lines.append("")
        self.line, self.space = [], False

    def end_block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(node: Node) -> int:
    text = node.attributes.get("colspan", "1").strip()
    return min(100, max(1, int(text))) if text.isdecimal() and len(text) < 4 else 1


def align(rows: list[list[tuple[int, list[str]]]]) -> list[str]:
    """Rows of (columns spanned, lines) cells as lines, columns as wide as their widest line, two spaces apart.

    Lines of more than ``COLUMN`` characters do not widen a column.  If padding would make most of the result, cells
    are only put two spaces apart.
    """
    widths: list[int] = []
    for row in rows:
        at = 0
        for span, lines in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max([widths[at], *(len(line) for line in lines if len(line) <= COLUMN)])
            at += span
    upto = [0, *accumulate(width + 2 for width in widths)]
    text = sum(len(line) + 2 for row in rows for _, lines in row for line in lines)
    padded = sum(upto[sum(span for span, _ in row)] * max((len(lines) for _, lines in row), default=0) for row in rows)
    found = []
    for row in rows:
        if padded > SPREAD * (text + COLUMN):
            beside: list[list[str]] = []
            for _, lines in row:
                beside += [[] for _ in range(len(lines) - len(beside))]
                for i, line in enumerate(lines):
                    beside[i].append(line)
            found += ["  ".join(parts).rstrip() for parts in beside]
            continue
        for i in range(max((len(lines) for _, lines in row), default=0)):
            parts, at = [], 0
            for span, lines in row:
                parts.append((lines[i] if i < len(lines) else "").ljust(upto[at + span] - upto[at] - 2) + "  ")
                at += span
            found.append("".join(parts).rstrip())
    return found


def render(page: str | None) -> tuple[str, int, int]:
    """Text, blocks of text and tables of a page; a missing page has no text."""
    if not page:
        return "", 0, 0
    flow, flows, tables, lists = Flow(), [], [], []
    done, blocks, pre, deep = 0, 0, 0, 0  # deep: open tables that are laid out as blocks
    # Steps instead of recursion: pages may be nested deeply.
    steps: list[tuple[str, Node | str]] = [("enter", build(page))]
    while steps:
        kind, node = steps.pop()
        if isinstance(node, str):
            (flow.exact if pre else flow.text)(node)
            continue
        tag = node.tag
        if kind == "enter":
            if not visible(node):
                continue
            if tag == "br":
                if flow.line:
                    flow.end_line()
                else:
                    flow.gap = min(flow.gap + 1, 2)
                continue
            if tag == "hr":
                flow.end_block(1)
                continue
            steps.append(("leave", node))
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            if tag == "pre" and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\n"), *children[1:]]
            steps += [("enter", child) for child in reversed(children)]
            if tag == "table" and len(tables) >= NESTED:
                deep += 1
                flow.end_block(1)
            elif deep and tag in CELLS | {"tr"}:
                flow.end_block(0)
            elif tag == "table":
                flow.end_block(1)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in CELLS and tables and tables[-1]:
                flows.append((flow, pre, lists))
                flow, pre, lists = Flow(), 0, []
            elif tag in BLOCKS or tag == "caption":
                flow.end_block(1 if tag in SPACED and not (tag in LISTS and lists) else 0)
                if tag in LISTS:
                    start = node.attributes.get("start", "1")
                    lists.append([tag, int(start) if start.lstrip("-").isdecimal() and len(start) < 9 else 1])
                elif tag == "li":
                    ordered = lists and lists[-1][0] == "ol"
                    mark = f"{lists[-1][1]}. " if ordered else "- "
                    if lists:
                        lists[-1][1] += 1
                    flow.indents.append(" " * len(mark))
                    flow.mark = mark
                elif tag in ("dd", "blockquote"):
                    flow.indents.append("  ")
            if tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag == "q":
                flow.text('"')
            continue
        if tag in ("pre", "textarea", "xmp"):
            pre -= 1
        if deep and tag in CELLS | {"tr", "table"}:
            flow.end_block(tag == "table")
            done += tag == "table"
            deep -= tag == "table"
        elif tag == "table":
            table = tables.pop()
            done += 1
            for line in align([row for row in table if any(lines for _, lines in row)]):
                flow.whole(line)
            flow.end_block(1)
        elif tag in CELLS and tables and tables[-1] and flows:
            lines = flow.result()
            blocks += flow.blocks
            flow, pre, lists = flows.pop()
            tables[-1][-1].append((_span(node), lines))
        elif tag in BLOCKS or tag == "caption":
            flow.end_block(1 if tag in SPACED and not (tag in LISTS and len(lists) > 1) else 0)
            if tag in LISTS and lists:
                lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                flow.indents.pop()
                flow.mark = ""
        elif tag == "q":
            flow.text('"')
    return "\n".join(flow.result()), blocks + flow.blocks, done


def extract(pages: DataFrame) -> DataFrame:
    """``page_id`` and the visible text of each row of ``pages`` (``page_id``, ``html``), with counts of blocks and tables.

    A null or empty page has an empty text.  Every row gives one row, repeated ids too.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RESULT.split(", ")]
        for batch in batches:
            found = [render(page.as_py()) for page in batch.column("html")]
            text, blocks, tables = zip(*found) if found else ((), (), ())
            columns = [batch.column("page_id"), pa.array(text, pa.string()), pa.array(blocks, pa.int64()), pa.array(tables, pa.int64())]
            yield pa.record_batch(columns, names=names)

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(html as string) html").mapInArrow(run, RESULT)
