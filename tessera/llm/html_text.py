"""HTML extraction: a tree with implied tags, visibility rules, and a layout that keeps blocks, lists and tables.

Elements may be nested to any depth: the layout runs on a stack of its own (generators that yield the parts to be laid
out before they go on), and the tree builder looks back only for elements that are open.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas svg math datalist select title xmp meta link".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure".split())
#: An opening tag ends the open elements named on the right, up to the nearest of the scopes after them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}),
}
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"} | {"hr"}
BARRIERS = frozenset({"table", "td", "th", "caption", "html", "body", "template", "object"})
SLICE = 8 << 20
MOST_INDENT = 80
MOST_COLUMNS = 1000
MOST_ROWS = 65534

_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; ``seen`` is what its style says of its visibility (None: as its parent), which its children may undo."""

    __slots__ = ("children", "columns", "hidden", "name", "number", "rows", "seen")

    def __init__(self, name: str, hidden: bool = False, number: int = 1):
        self.name, self.hidden, self.number = name, hidden, number
        self.seen: bool | None = None
        self.columns = self.rows = 1
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(text)}


def _count(text: str | None, most: int) -> int:
    """A number of columns or rows as HTML reads it: 1 where it is missing or odd, ``most`` at most."""
    digits = re.match(r"\s*(\d{1,9})", text or "")
    return min(most, max(1, int(digits[1]))) if digits else 1


class Path:
    """The open elements, and how many there are of each name."""

    def __init__(self) -> None:
        self.nodes = [Node("html")]
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.open[node.name] += 1

    def cut(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.open[node.name] -= 1
        del self.nodes[depth:]

    def any(self, names: set[str] | frozenset[str]) -> bool:
        return any(self.open[n] > 0 for n in names)

    def end(self, names: set[str] | frozenset[str], scopes: set[str] | frozenset[str]) -> None:
        """Ends the elements of these names, up to the nearest of the scopes."""
        while self.any(names):
            for depth in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[depth].name in names:
                    self.cut(depth)
                    break
                if self.nodes[depth].name in scopes:
                    return
            else:
                return


def tree(source: str) -> Node:
    """The element tree: unclosed elements are ended where HTML implies it, stray end tags are passed over."""
    path, at, n = Path(), 0, len(source)
    root = path.nodes[0]
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            path.nodes[-1].children.append(html.unescape(source[at:lt]) if "&" in source[at:lt] else source[at:lt])
            at = lt
            continue
        m = _TOKEN.match(source, at) or _LOOSE.match(source, at)
        if not m:  # a "<" that opens nothing is text
            path.nodes[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        if not m.lastindex or not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for depth in range(len(path.nodes) - 1, 0, -1) if path.open[name] else ():
                if path.nodes[depth].name == name:
                    path.cut(depth)
                    break
                if path.nodes[depth].name in BARRIERS and name not in BLOCKS:
                    break
            continue
        if name == "html":
            continue
        if name in ENDS_P and path.open["p"]:
            for depth in range(len(path.nodes) - 1, 0, -1):
                if path.nodes[depth].name == "p":
                    path.cut(depth)
                    break
                if path.nodes[depth].name in BARRIERS:
                    break
        if name in IMPLIED:
            path.end(*IMPLIED[name])
        if (name == "body" or name in BLOCKS) and path.open["head"]:  # the head ends where content begins
            path.cut(next(depth for depth, node in enumerate(path.nodes) if node.name == "head"))
        found = _attributes(m[3]) if m[3].strip(" \t\n\r/") else {}
        style = found.get("style", "")
        start = found.get("start", "1") if name == "ol" else "1"
        node = Node(name, name in UNSEEN or "hidden" in found or bool(_HIDING.search(style)), int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1)
        if told := _VISIBILITY.findall(style):
            node.seen = {"visible": True, "hidden": False, "collapse": False}.get(told[-1].lower())
        if name in ("td", "th"):
            node.columns, node.rows = _count(found.get("colspan"), MOST_COLUMNS), _count(found.get("rowspan"), MOST_ROWS)
        path.nodes[-1].children.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS | RAW:
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(source, at)
            stop = close.start() if close else n
            node.children.append(html.unescape(source[at:stop]) if name in ("textarea", "title") else source[at:stop])
            at = source.find(">", stop) + 1 if close and source.find(">", stop) >= 0 else n
        else:
            path.push(node)
    return root


class Layout:
    """Lines of text, each a list of parts that are not empty; ``gap`` is the number of line ends owed before the next text.

    ``begun`` is whether any line has a part, ``inked`` whether the last one has more than blanks: both are kept up to
    date, so that a piece of text costs its own length whatever stands before it.
    """

    def __init__(self) -> None:
        self.lines: list[list[str]] = [[]]
        self.begun = self.inked = False
        self.gap, self.space, self.mark = 0, False, ""

    def block(self, blank: bool = False) -> None:
        if self.begun:
            self.gap = max(self.gap, 2 if blank else 1)
        self.space = False

    def line(self) -> None:
        self.lines.append([])
        self.inked = False

    def _put(self, part: str) -> None:
        if part:
            self.lines[-1].append(part)
            self.begun, self.inked = True, self.inked or not part.isspace()

    def _start(self, indent: str) -> None:
        if self.gap:
            while len(self.lines) > 1 and not self.lines[-1]:
                self.lines.pop()
            for _ in range(self.gap):
                self.line()
            self.gap = 0
        if not self.lines[-1]:
            self._put(indent + self.mark)
            self.mark = ""

    def text(self, text: str, indent: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        fresh = self.gap > 0 or not self.inked
        self._start(indent)
        lead = (self.space or words[0] == " ") and not fresh
        self._put((" " if lead and not (self.lines[-1] and self.lines[-1][-1].endswith(" ")) else "") + words.strip(" "))
        self.space = words[-1] == " "

    def literal(self, text: str, indent: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.line()
                self.gap = 0
            if line:
                self._start(indent)
                self._put(line)

    def value(self) -> str:
        return "\n".join("".join(x).rstrip() for x in self.lines).strip("\n")


Parts = Generator["Parts", None, None]


def _run(parts: Parts) -> None:
    """Runs a part and, in its places, those that it yields; none of them calls another."""
    stack = [parts]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


Cell = tuple[str, int, int]  # text, columns and rows that it spans


def _cells(node: Node, rows: list[list[Cell]], captions: list[str], counts: dict[str, int], seen: bool) -> Parts:
    for child in node.children:
        if isinstance(child, str):
            if child.strip() and seen:
                captions.append(_SPACE.sub(" ", child).strip())
            continue
        shown = seen if child.seen is None else child.seen
        if child.hidden:
            continue
        if child.name == "tr":
            rows.append([])
            for cell in child.children:
                if isinstance(cell, Node) and not cell.hidden or isinstance(cell, str) and cell.strip():
                    counts["cells"] += 1
                    inner = Layout()
                    real = cell if isinstance(cell, Node) and cell.name in ("td", "th") else _wrapped(cell)
                    yield _render(real, inner, "", False, counts, shown if real.seen is None else real.seen)
                    rows[-1].append((inner.value(), real.columns, real.rows))
        elif child.name in ("thead", "tbody", "tfoot"):
            yield _cells(child, rows, captions, counts, shown)
        else:
            inner = Layout()
            yield _render(child, inner, "", False, counts, shown)
            if inner.value():
                captions.append(inner.value())


def _wrapped(child: Node | str) -> Node:
    node = Node("td")
    node.children.append(child)
    return node


def _grid(rows: list[list[Cell]]) -> list[list[tuple[int, str, int]]]:
    """Rows of (first column, text, columns): cells take the columns that no cell from above still spans."""
    out: list[list[tuple[int, str, int]]] = []
    until: dict[int, int] = {}  # column to the row before which it is taken
    for y, row in enumerate(rows):
        x, placed = 0, []
        for text, columns, n_rows in row:
            while until.get(x, 0) > y:
                x += 1
            placed.append((x, text, columns))
            if n_rows > 1:
                until |= dict.fromkeys(range(x, x + columns), y + n_rows)
            x += columns
        out.append(placed)
    return out


def _table(node: Node, out: Layout, indent: str, counts: dict[str, int], seen: bool) -> Parts:
    rows: list[list[Cell]] = []
    captions: list[str] = []
    yield _cells(node, rows, captions, counts, seen)
    for caption in captions:
        out.block()
        out.literal(caption, indent)
    split = [[(x, text.split("\n"), n) for x, text, n in row] for row in _grid(rows)]
    widths: dict[int, int] = {}
    cells = sorted(((n, x, max(map(len, lines))) for row in split for x, lines, n in row), key=lambda c: c[0])
    for n, x, width in cells:  # cells of one column first; then wider ones add to their last column what is missing
        room = sum(widths.get(i, 0) + 2 for i in range(x, x + n - 1) if widths.get(i)) if n > 1 else 0
        if width > room + widths.get(x + n - 1, 0):
            widths[x + n - 1] = max(widths.get(x + n - 1, 0), width - room)
    columns = sorted(x for x, width in widths.items() if width)
    starts = dict(zip(columns, itertools.accumulate([0] + [widths[x] + 2 for x in columns]), strict=False))
    for row in split:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line = ""
            for x, lines, n in row:
                text = lines[k] if k < len(lines) else ""
                if text:
                    first = next((starts[i] for i in range(x, x + n) if i in starts), 0)
                    line = line.ljust(first) + text
            out.block()
            out.literal(line.rstrip(), indent)


def _render(node: Node, out: Layout, indent: str, exact: bool, counts: dict[str, int], seen: bool = True) -> Parts:
    item = 0
    for child in node.children:
        if isinstance(child, str):
            if seen:
                (out.literal if exact else out.text)(child, indent)
            continue
        name = child.name
        if child.hidden:
            continue
        shown = seen if child.seen is None else child.seen
        if name == "br":
            out.line() if shown and not out.gap else None
            out.space = False
        elif name == "hr":
            out.block(True)
        elif name == "table":
            out.block(True)
            yield _table(child, out, indent, counts, shown)
            out.block(True)
        elif name in BLOCKS:
            inside = node.name in ("ul", "ol", "menu", "li")
            out.block(name in SPACED and not (inside and name in ("ul", "ol", "menu")))
            deeper = indent
            if name == "li":
                counts["items"] += 1
                item += 1
                out.mark = f"{node.number + item - 1}. " if node.name == "ol" else "- "
            elif name in ("blockquote", "dd"):
                deeper = (indent + "    ")[:MOST_INDENT]
            elif name in ("ul", "ol", "menu") and node.name == "li":
                deeper = (indent + "  ")[:MOST_INDENT]
            yield _render(child, out, deeper, exact or name == "pre", counts, shown)
            if name == "li":
                out.mark = ""
            out.block(name in SPACED and not (inside and name in ("ul", "ol", "menu")))
        else:
            if name in ("p",) and exact:
                out.block()
            yield _render(child, out, indent, exact, counts, shown)


def _title(node: Node) -> str:
    todo = [node]
    while todo:
        found = todo.pop()
        if found.name == "title":
            return _SPACE.sub(" ", "".join(x for x in found.children if isinstance(x, str))).strip()
        todo += [x for x in reversed(found.children) if isinstance(x, Node)]
    return ""


def extract(source: str | None) -> tuple[str, str, int, int]:
    """(title, visible text, list items, table cells) of a page; all empty for null and empty pages."""
    root, out, counts = tree(source or ""), Layout(), {"items": 0, "cells": 0}
    _run(_render(root, out, "", False, counts))
    return _title(root), out.value(), counts["items"], counts["cells"]


def rendered(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, n_chars, n_items and n_cells of every row of ``pages`` (page_id, url, html).

    Null and empty pages give an empty text; repeated rows are rendered alike; elements are kept at any depth, and
    indents stop growing at MOST_INDENT; an unclosed tag or comment reaches to the end. Cells stand at the column where
    they begin, also below and beside cells that span several. What is ``visibility: hidden`` is left out, but not its
    children that are visible again. An empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE, "html"):
            found = [extract(x) for x in b.column("html").to_pylist()]
            title, text, items, cells = (list(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), pa.array(items, pa.int64()), pa.array(cells, pa.int64())], names=["page_id", "url", "title", "text", "n_chars", "n_items", "n_cells"])

    schema = "page_id long, url string, title string, text string, n_chars long, n_items long, n_cells long"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)
