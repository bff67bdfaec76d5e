"""Layout-aware text of HTML pages: a tree builder with implied tags and visibility rules.

A tokenizer feeds a builder that closes implied elements (p, li, dt, dd, option, tr, td,
th, thead, tbody, tfoot) and ignores stray end tags.  The renderer walks the tree: hidden
elements give nothing, inline text collapses its white space, blocks stand on lines of
their own with an empty line around paragraphs, headings, lists and tables, lists carry
their marks and depth, table cells are aligned in columns up to a bounded width, pre keeps its
lines.  visibility is inherited and may be set again further in.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
#: Elements that are never shown.
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object canvas audio video datalist meta link desc metadata defs annotation annotation-xml".split())
#: Blocks with an empty line before and after them, and blocks with a line break only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset".split())
BLOCK = SPACED | frozenset("html body div section article main nav aside header footer address hgroup li dt dd tr thead tbody tfoot caption figcaption details summary legend center dialog search menu select option optgroup".split())
#: What a start tag closes, and the elements within which it looks for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption html button object".split())


#: Most columns and rows that a cell spans (fixed by the HTML standard), and the column
#: width up to which cells are padded.
MOST_COLUMNS, MOST_ROWS, MOST_PAD = 1000, 65534, 60
#: Where the last aligned column begins, how far items are indented, and how many tables
#: within each other are aligned; text beyond stays, on lines of its own.
MOST_PLACE, MOST_INDENT, MOST_NESTED = 300, 60, 8


class Node:
    """hidden: the whole element is; visible: what its visibility property says, if it has one."""

    __slots__ = ("cells", "children", "columns", "hidden", "number", "rows", "tag", "visible")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.hidden, self.visible, self.children = tag, tag in HIDDEN, None, []
        self.cells = False  # holds rows or cells of the table around it
        self.columns = self.rows = 1
        self.number: int | None = None  # start of an ol, value of an li
        if not self.hidden and attributes and attributes.strip(" /"):
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).strip().lower()
            if name == "hidden" and value != "until-found" or name == "type" and self.tag == "input" and value == "hidden":
                self.hidden = True
            elif name == "style":
                for said in value.split(";"):
                    what, _, how = said.partition(":")
                    what, how = what.strip(), how.replace("!important", "").strip()
                    if what == "display" and how == "none":
                        self.hidden = True
                    elif what == "visibility":
                        self.visible = {"hidden": False, "collapse": False, "visible": True}.get(how, self.visible)
            elif (self.tag, name) in (("ol", "start"), ("li", "value")) and re.fullmatch(r"-?[0-9]{1,9}", value, re.ASCII):
                self.number = int(value)
            elif name in ("colspan", "rowspan") and self.tag in ("td", "th") and value[:6].isdecimal() and value.isascii():
                if name == "colspan":
                    self.columns = min(max(int(value[:6]), 1), MOST_COLUMNS)
                else:
                    self.rows = min(int(value[:6]) or MOST_ROWS, MOST_ROWS)


class _Scanner:
    """Finds the tags of a page from left to right, each character looked at a few times."""

    def __init__(self, source: str):
        self.source = source
        self.gone: set[str] = set()  # characters that don't occur from here on

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        i = self.source.find(what, at)
        if i < 0:
            self.gone.add(what)
        return i

    def _end(self, at: int) -> int:
        """After the > of a tag, which quoted values may hold too; the end of the page without one."""
        source, first = self.source, self.find(">", at)
        if first < 0:
            return len(source)
        i = at
        while True:
            close = self.find(">", i)
            if close < 0:  # all in quotes that close too late
                return first + 1
            quote = min((q for q in (source.find('"', i, close), source.find("'", i, close)) if q >= 0), default=-1)
            if quote < 0:
                return close + 1
            i = self.find(source[quote], quote + 1) + 1
            if not i:  # a quote that never closes
                return first + 1

    def tag(self, at: int) -> tuple[int, int, re.Match | None]:
        """Start and end of the next tag or comment from `at`, and the match of a tag's name."""
        source = self.source
        while (start := self.find("<", at)) >= 0:
            if m := _NAME.match(source, start):
                return start, self._end(m.end()), m
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">")):
                if source.startswith(opening, start):
                    if opening == "</" and source[start + 2 : start + 3] in (" ", ""):
                        break
                    end = self.find(closing, start + len(opening))
                    return start, end + len(closing) if end >= 0 else len(source), None
            at = start + 1
        return len(source), len(source), None


def parse(source: str) -> Node:
    root = Node("html")
    stack = [root]
    opened = Counter()  # the tags on the stack, so that deep stacks are searched only for what they hold
    scan, at = _Scanner(source), 0

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while at < len(source):
        start, end, m = scan.tag(at)
        text = source[at:start]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        at = end
        if m is None or not source.endswith(">", start, end):  # a tag that never ends is none
            continue
        name, attributes = m.group(2), source[m.end() : end - 1]
        tag = name.lower()
        if m.group(1):
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
                continue
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag == "html":
            continue
        if tag in CLOSES:
            these, within = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in these) else ():
                if stack[i].tag in within:
                    break
                if stack[i].tag in these:
                    close(i)
                    if tag in ("li", "dt", "dd", "td", "th", "option"):
                        break
        elif tag in BLOCK:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
            if stack[-1].tag == "head":
                close(len(stack) - 1)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in ("tr", "td", "th"):
            for n in reversed(stack):
                if n.cells or n.tag == "table":
                    break
                n.cells = True
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            last = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            body = source[at : last.start() if last else len(source)]
            if body:
                node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            after = scan.find(">", last.end()) + 1 if last else 0
            at = after or len(source)
        else:
            stack.append(node)
            opened[tag] += 1
    return root


class _Lines:
    """Collects lines with their indent; knows how many empty ones are due before the next text.

    All blocks and lists of a cell or page write to one collector, so that a line is made once
    however deep it stands.
    """

    def __init__(self):
        self.out: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.first = 0  # lines that were there when the innermost item began
        self.indent = 0
        self.lead: str | None = None  # indent and marks of items that have no line yet

    def text(self, s: str) -> None:
        s = re.sub(r"[ \t\n\r\f]+", " ", s)
        if s.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.now.append(s)

    def line(self) -> None:
        s = "".join(self.now).rstrip(" ")
        self.now = []
        if s:
            self.put(s)

    def put(self, s: str) -> None:
        if len(self.out) > self.first and self.gap:
            self.out += [""] * self.gap
        self.gap = 0
        if s:
            self.out.append((" " * self.indent if self.lead is None else self.lead) + s)
            self.lead = None
        elif self.lead is None:  # an item doesn't begin with an empty line
            self.out.append("")

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced and len(self.out) > self.first:
            self.gap = 1

    def enter(self, mark: str) -> tuple:
        """Begin an item with its mark; what leave() takes.  Marks end at MOST_INDENT columns."""
        self.line()
        before = (self.first, self.indent, self.lead, self.gap, len(self.out))
        lead = " " * self.indent if self.lead is None else self.lead
        if len(lead) < MOST_INDENT:
            self.lead = lead + mark
            self.indent += len(mark)
        elif mark.strip() and self.lead is None:
            self.lead = lead + mark
        # an empty line that is due stands before the item, not within
        if self.gap and len(self.out) > self.first:
            self.out += [""] * self.gap
        self.gap, self.first = 0, len(self.out)
        return before

    def leave(self, before: tuple) -> None:
        self.line()
        first, self.indent, lead, gap, size = before
        if len(self.out) == self.first:  # nothing came: as if the item weren't there
            del self.out[size:]
            self.lead, self.gap = lead, gap
        else:
            while not self.out[-1]:
                self.out.pop()
            self.lead, self.gap = None, 0
        self.first = first


def _parts(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and misplaced content, in their order, and the cells of each row.

    Cells outside a row share one that is implied; rows and cells inside other elements, such
    as a form, are taken out of them, and what is left of these is misplaced.
    """
    loose: list[Node] = []
    rows: list[list[Node]] = []
    implied = False  # the last row was implied by a cell and takes the next cell too

    def misplaced(c) -> None:
        nonlocal run
        if run is None:
            run = Node("div")
            loose.append(run)
        run.children.append(c)

    run: Node | None = None  # neighbours in one holder, so that inline text stays together
    stack = [(iter(table.children), False)]
    while stack:
        children, in_row = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            run = None
            if in_row and not (stack and stack[-1][1]):
                implied = False
        elif isinstance(c, str):
            if c.strip() or run is not None:
                misplaced(c)
        elif c.hidden or c.tag in ("colgroup", "col") and not c.children:
            continue
        elif c.tag in ("td", "th"):
            run = None
            if not in_row and not implied:
                rows.append([])
                implied = True
            rows[-1].append(c)
        elif c.tag == "tr":
            run = None
            rows.append([])
            implied = False
            stack.append((iter(c.children), True))
        elif c.tag in ("thead", "tbody", "tfoot", "colgroup"):
            run = None
            implied = False
            stack.append((iter(c.children), False))
        elif c.tag == "caption":
            run = None
            loose.append(c)
        elif c.tag != "table" and c.cells:
            run = None
            stack.append((iter(c.children), in_row))
        else:
            misplaced(c)
    return loose, rows


def _table(node: Node, depth: int, shown: bool):
    loose, rows = _parts(node)
    out: list[str] = []
    for c in loose:  # before the rows
        out += yield _render(c, depth, _shown(c, shown))
    # (column, columns spanned, lines) of the cells of each row
    grid: list[list[tuple[int, int, list[str]]]] = []
    until, last = None, 0  # the row to which cells above take each column, and the last such row
    for i, r in enumerate(rows):
        grid.append([])
        free = np.flatnonzero(until <= i).tolist() if i < last else None
        at = 0
        for c in r:
            if free is not None and at < MOST_COLUMNS:
                k = bisect.bisect_left(free, at)
                at = free[k] if k < len(free) else MOST_COLUMNS
            grid[-1].append((at, c.columns, (yield _render(c, depth, _shown(c, shown))) or [""]))
            if c.rows > 1 and at < MOST_COLUMNS:
                until = np.zeros(MOST_COLUMNS, np.int64) if until is None else until
                taken = until[at : at + c.columns]
                np.maximum(taken, i + c.rows, out=taken)
                last = max(last, i + c.rows)
            at += c.columns
    width: dict[int, int] = {}
    for row in grid:
        for at, span, cell in row:
            w = max(map(len, cell)) if span == 1 else 0
            width[at] = max(width.get(at, 0), min(w, MOST_PAD))
    columns = sorted(width)
    ends = {}  # where a column's text begins in a line
    place = 0
    for c in columns:
        ends[c] = min(place, MOST_PLACE)
        place += width[c] + 2
    for row in grid:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            line = ""
            for at, _, cell in row:
                if k < len(cell) and cell[k]:
                    line = line.ljust(ends[at]) + cell[k] if len(line) + 2 <= ends[at] or not line else line + "  " + cell[k]
            if line := line.rstrip(" "):
                out.append(line)
    return out


def _shown(c: Node | str, shown: bool) -> bool:
    """Whether text right in c shows, where it does so around c or not."""
    return shown if isinstance(c, str) or c.visible is None else c.visible


def render(node: Node, depth: int = 0) -> list[str]:
    """The lines of one element's content; generators on a list of their own stand for
    recursion, so that pages may be of any depth."""
    stack, value = [_render(node, depth, True)], None
    while stack:
        try:
            below = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(below)
            value = None
    return value


def _render(node: Node, depth: int, shown: bool):
    lines = _Lines()

    def walk(n: Node, pre: bool, shown: bool):
        for c in n.children:
            if isinstance(c, str):
                if not shown:
                    continue
                if pre:
                    first, *rest = c.split("\n")
                    if first:
                        lines.now.append(first)
                    for x in rest:
                        s = "".join(lines.now)
                        lines.now = []
                        lines.put(s.rstrip())
                        if x:
                            lines.now.append(x)
                else:
                    lines.text(c)
            elif c.hidden:
                continue
            elif c.tag == "br":
                s = "".join(lines.now).rstrip(" ")
                lines.now = []
                lines.put(s)
            elif c.tag == "hr":
                lines.block(True)
                lines.gap = 1
            elif c.tag == "table" and depth < MOST_NESTED:
                lines.block(True)
                for x in (yield _table(c, depth + 1, _shown(c, shown))):
                    lines.put(x)
                lines.block(True)
            elif c.tag in ("ul", "ol", "menu", "dl"):
                lines.block(n.tag != "li" and n.tag not in ("ul", "ol", "menu"))
                yield items(c, _shown(c, shown))
                lines.block(n.tag != "li" and n.tag not in ("ul", "ol", "menu"))
            elif c.tag in BLOCK or c.tag in ("td", "th"):
                lines.block(c.tag in SPACED)
                yield walk(c, pre or c.tag == "pre", _shown(c, shown))
                lines.block(c.tag in SPACED)
            else:
                yield walk(c, pre or c.tag == "textarea", _shown(c, shown))

    def items(n: Node, shown: bool):
        number = 0 if n.number is None else n.number - 1
        for c in n.children:
            if isinstance(c, Node) and c.hidden or isinstance(c, str) and not c.strip():
                continue
            if isinstance(c, Node) and c.tag == "li":
                number = number + 1 if c.number is None else c.number
                before = lines.enter(f"{number}. " if n.tag == "ol" else "- ")
                yield walk(c, False, _shown(c, shown))
            else:
                holder = Node("div")
                holder.children = [c]
                before = lines.enter("  " if isinstance(c, Node) and c.tag in ("dd", "ul", "ol", "menu") else "")
                yield walk(holder, False, shown)
            lines.leave(before)

    yield walk(node, node.tag == "pre", shown)
    lines.line()
    while lines.out and not lines.out[-1]:
        lines.out.pop()
    return lines.out


def page_text(source: str | None) -> str:
    """All visible text; empty for null, empty and wholly hidden pages."""
    return "\n".join(render(parse(source or "")))


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """Adds the visible text of each page, in place of the column `source`.

    Null, empty and wholly hidden pages give an empty text; every row stays; a column of pages
    that is called like the result is replaced.  Time and memory grow in proportion to a page's
    length, however it is built.  An empty table gives no rows.  No shuffle: one pass over the scan.
    """
    common.ship(pages.sparkSession)
    carried = [c for c in pages.columns if c not in (source, name)]
    # the page goes first and the other columns under numbered names, so that none clashes
    base = pages.select(F.col(f"`{source}`").alias("page"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])

    def run(batches):
        for b in batches:
            texts = [page_text(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], [*[f"c{i}" for i in range(len(carried))], "page"])

    out = base.mapInArrow(run, base.select(*[f"c{i}" for i in range(len(carried))], F.lit("").alias("page")).schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], F.col("page").alias(name))
