"""Layout-aware rendering of HTML pages to text.

A tokenizer feeds a tree builder that closes what HTML lets authors leave open (paragraphs,
list items, table parts, options) and drops end tags that match nothing.  Visibility rules
remove what no browser shows: head content, scripts, styles, templates, hidden elements.
The renderer emits all other text: inline white space collapses, blocks stand apart (a blank
line around paragraphs, headings, lists and tables; a line break around other blocks),
list items carry bullets or numbers and are indented by depth, table cells are padded so
that columns align (over columns and rows that cells span), and preformatted text keeps its
spaces.  Margins stop growing at ``DEEPEST`` signs.  A table row whose cells hold line breaks, or more than ``WIDE`` signs, is written
one cell below the other instead; a table that would be mostly padding isn't aligned.

Visible are also the text of formulas and drawings, open dialogs, the labels of button
inputs, and what stands in an object without data.

Edge cases: a null page gives null; an empty one, or one with nothing visible, an empty
text; an unclosed comment, tag or script runs to the page's end; a quote opens a value only
after ``=``; nesting may be of any depth; very long pages are read whole.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import bound_batches

WIDE = 200
#: Margins grow no further than this; spans count up to this many columns; padding that a table
#: may have in any case.
DEEPEST, COLUMNS, PADDING = 64, 1024, 10_000

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe embed audio video canvas datalist noembed noframes area base link meta param source track col colgroup rp".split())
#: Parts of drawings and formulas that aren't drawn.
UNDRAWN = {"svg": frozenset("defs symbol desc metadata clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml".split())}
DRAWN_TEXT = frozenset({"text", "foreignobject"})
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr".split())
TIGHT = frozenset("html body div section article aside nav header footer main address form figcaption details summary legend li dt dd caption thead tbody tfoot tr td th option optgroup select center hgroup search menu dir".split())
BLOCKS = LOOSE | TIGHT
#: A start tag on the left ends open elements on the right, up to a border.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "template"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table", "template"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table", "template"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "template"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "template"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "template"})),
}
BORDERS = frozenset({"table", "td", "th", "caption", "html", "template", "body"})
HEAD_ONLY = frozenset({"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "hidden", "start", "span", "down", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.hidden = tag in UNSEEN or tag == "dialog"
        self.start, self.span, self.down = 1, 1, 1
        if attributes and attributes.strip(" /\n\t\r"):
            a = {}
            for m in _ATTRIBUTE.finditer(attributes):
                a.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
            if tag == "dialog":
                self.hidden = "open" not in a
            self.hidden |= "hidden" in a or bool(_HIDING.search(a.get("style", ""))) or (tag == "object" and "data" in a)
            if tag == "input":
                kind = a.get("type", "").lower()
                self.hidden |= kind == "hidden"
                if kind in ("submit", "reset", "button") and a.get("value"):
                    self.children.append(a["value"])
            if tag == "ol" and re.fullmatch(r"-?\d{1,9}", a.get("start", "")):
                self.start = int(a["start"])
            if tag in ("td", "th"):
                self.span, self.down = (max(1, int(a[k])) if re.fullmatch(r"\d{1,3}", a.get(k, "")) else 1 for k in ("colspan", "rowspan"))


def parse(page: str) -> tuple[Element, int]:
    """The tree of a page and its depth; character references in text are resolved."""
    root = Element("html")
    stack: list[Element] = [root]
    open_: defaultdict[str, list[int]] = defaultdict(list)  # by tag, the stack's places
    deepest = 1

    def push(element: Element) -> None:
        nonlocal deepest
        open_[element.tag].append(len(stack))
        stack.append(element)
        deepest = max(deepest, len(stack))

    def pop_to(k: int) -> None:
        for element in stack[k:]:
            open_[element.tag].pop()
        del stack[k:]

    def last(tags) -> int:
        """The place of the innermost open element of some tags, 0 without one."""
        return max((open_[t][-1] for t in tags if open_[t]), default=0)

    def text(piece: str) -> None:
        if piece:
            if stack[-1].tag == "head" and piece.strip():
                pop_to(len(stack) - 1)  # text ends the head
            if not open_["svg"] or open_["text"] or open_["foreignobject"]:
                stack[-1].children.append(html.unescape(piece))

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return root, deepest
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            k = last((tag,))
            if k and (tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or last(BORDERS) <= k):
                pop_to(k)
            if tag == "br":
                stack[-1].children.append(Element("br"))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in ("html", "body") and len(stack) == 1 or tag == "html":
            if tag == "body":
                push(Element("body", m[3]))
                root.children.append(stack[-1])
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            pop_to(len(stack) - 1)
        if tag in CLOSES_P and last(BORDERS) < last(("p",)):
            pop_to(last(("p",)))
        if tag in IMPLIED:
            ends, border = IMPLIED[tag]
            one = tag in ("li", "dt", "dd", "option", "td", "th")
            while (k := last(ends)) > last(border):
                pop_to(k)
                if one:
                    break
        element = Element(tag, m[3])
        for outer, parts in UNDRAWN.items():
            element.hidden |= tag in parts and bool(open_[outer])
        stack[-1].children.append(element)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            element.children.append(html.unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop])
            close = page.find(">", stop) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            push(element)


class Lines:
    """Collects lines; spaces collapse and breaks merge as blocks require.

    Items and quotations are containers: their lines are indented by a margin, their marks stand
    before their first line.  What a container's first block would keep away from what is
    before it, and its last block from what follows, counts for nothing."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed space is due before the next sign
        self.blank = False  # a blank line is due before the next line
        self.margin = 0
        self.marks, self.hang = "", 0  # marks due before the next line, and their margin
        self.tight = False  # no blank lines inside items
        self.first = False  # the innermost container holds no line yet

    def enter(self, width: int, mark: str = "", tight: bool = False) -> tuple:
        self.end()
        before = (self.margin, self.marks, self.hang, self.tight, self.first, len(self.lines))
        if mark:
            self.hang = self.hang if self.marks else self.margin
            # Marks that would stand beyond the deepest margin are left out.
            self.marks += mark if self.hang + len(self.marks) < DEEPEST else ""
        elif self.marks:
            self.marks += " " * width if self.hang + len(self.marks) < DEEPEST else ""
        self.margin = min(DEEPEST, self.margin + width)
        self.tight |= tight
        self.first = True
        return before

    def leave(self, before: tuple) -> None:
        self.end()
        self.margin, marks, hang, self.tight, first, lines = before
        if len(self.lines) == lines:
            self.marks, self.hang, self.first = marks, hang, first
        else:
            self.blank = self.first = False

    def write(self, text: str) -> None:
        parts = _SPACES.split(text)
        if len(parts) == 1:
            words = parts
        else:
            self.space |= not parts[0] and bool(self.now)
            words = [p for p in parts if p]
        if words and words[0]:
            if self.now and self.space:
                self.now.append(" ")
            self.now.append(" ".join(words))
            self.space = not parts[-1]
        elif self.now:
            self.space = True

    def verbatim(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.now.append(first)
        for line in rest:
            self.end(keep=True)
            self.now.append(line)
        self.space = False

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one counts only if kept."""
        line = "".join(self.now)
        self.now, self.space = [], False
        seen = bool(line.strip())
        if seen or (keep and not self.tight):
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = self.first = False
            if seen and self.marks:
                line, self.marks = " " * self.hang + self.marks + line, ""
            elif seen:
                line = " " * self.margin + line
            self.lines.append(line.rstrip())

    def gap(self) -> None:
        self.end()
        self.blank |= not self.first and not self.tight


def _render(node: Element, out: Lines, pre: bool = False) -> None:
    number = node.start
    for child in node.children:
        if isinstance(child, str):
            out.verbatim(child) if pre else out.write(child)
            continue
        tag = child.tag
        if child.hidden:
            continue
        if tag == "br":
            out.end(keep=True)
        elif tag == "hr":
            out.gap()
        elif tag == "table":
            out.gap()
            for line in _table(child):
                out.now.append(line)
                out.end(keep=bool(line))
            out.gap()
        elif tag == "li":
            out.end()
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            before = out.enter(len(mark), mark, tight=True)
            _render(child, out, pre)
            out.leave(before)
        elif tag in BLOCKS or tag in DRAWN_TEXT:
            nested = tag in ("ul", "ol", "menu", "dir") and node.tag in ("li", "ul", "ol")
            (out.gap if tag in LOOSE and not nested else out.end)()
            if tag in ("blockquote", "dd"):
                before = out.enter(2)
                _render(child, out, pre)
                out.leave(before)
            else:
                _render(child, out, pre or tag == "pre")
            (out.gap if tag in LOOSE and not nested else out.end)()
        else:
            _render(child, out, pre)


def _rows(node: Element):
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield "text", Element("caption"), child
        elif not child.hidden:
            if child.tag == "tr":
                yield "row", child, ""
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)
            else:
                yield "text", child, ""


def _cells(row: Element) -> list[tuple[str, int, int]]:
    """(text, columns, rows) of a row's visible cells."""
    out = []
    for cell in row.children:
        if isinstance(cell, str) and not cell.strip() or isinstance(cell, Element) and cell.hidden:
            continue
        inner = Lines()
        if isinstance(cell, str):
            inner.write(cell)
        else:
            holder = Element("div")
            holder.children = [cell] if cell.tag not in ("td", "th") else cell.children
            _render(holder, inner)
        inner.end()
        out.append(("\n".join(x for x in inner.lines if x), *((cell.span, cell.down) if isinstance(cell, Element) else (1, 1))))
    return out


def _table(node: Element) -> list[str]:
    """Lines of a table: rows of short cells in padded columns, others' cells stacked."""
    grid: list[list[tuple[int, str, int]] | str] = []
    until = np.zeros(COLUMNS, np.int64)  # by column, the row from which it is free again
    for number, (kind, element, text) in enumerate(_rows(node)):
        if kind == "text":
            inner = Lines()
            inner.write(text)
            _render(element, inner)
            inner.end()
            grid += inner.lines
            # A line between rows is no row: what cells above cover goes on below it.
            until[until > number] += 1
            continue
        row, at = [], 0
        covered = until > number
        for text, span, down in _cells(element):
            if at < COLUMNS and covered[at]:
                free = np.flatnonzero(~covered[at:])
                at = at + int(free[0]) if len(free) else COLUMNS
            row.append((at, text, span))
            if down > 1:
                until[at : at + span] = number + down
            at += span
        grid.append(row)
    stacked = [isinstance(row, str) or any("\n" in c or len(c) > WIDE for _, c, _ in row) for row in grid]
    # Only columns in which a cell of a padded row begins have a place on the line.
    padded = [row for row, apart in zip(grid, stacked) if not apart]
    columns = sorted({at for row in padded for at, _, _ in row})
    place = {at: k for k, at in enumerate(columns)}
    reach = lambda at, span: bisect.bisect_left(columns, at + span)
    widths = [0] * len(columns)
    for row in padded:
        for at, c, span in row:
            if span == 1:
                widths[place[at]] = max(widths[place[at]], len(c))
    begins = [0, *itertools.accumulate(w + 2 for w in widths)]
    # Padding stays within a multiple of what the cells hold; beyond it nothing is aligned.
    held = sum(len(c) + 10 for row in padded for _, c, _ in row)
    aligned = sum(begins[place[row[-1][0]]] for row in padded if row) <= PADDING + 2 * held
    lines: list[str] = []
    for row, apart in zip(grid, stacked):
        if isinstance(row, str):
            lines.append(row)
        elif apart:
            lines += [line for _, c, _ in row for line in c.split("\n")]
        elif not aligned:
            lines.append("  ".join(c for _, c, _ in row if c))
        else:
            line = ""
            for at, c, span in row:
                line = line.ljust(begins[place[at]]) + c
                end = begins[reach(at, span)]
                line += "  " if len(line) > end - 2 else ""  # a spanning cell wider than its columns
            lines.append(line.rstrip())
    return [x for x in lines if x]


def render(page: str | None) -> str | None:
    if page is None:
        return None
    out = Lines()
    root, deepest = parse(page)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * deepest))
    _render(root, out)
    out.end()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """All columns but the page's source (and any earlier ``out``), with the visible text.
    Narrow: a batch at a time, no shuffle."""
    bound_batches(pages.sparkSession)
    rest = pages.drop(out).withColumn(source, F.col(source).cast("string"))
    kept = [f for f in rest.schema.fields if f.name != source]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string"])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = pa.array([render(x.as_py()) for x in part.column(source)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), texts], names=[*(f.name for f in kept), out])

    return rest.mapInArrow(run, schema)
