"""HTML extraction: layout-aware rendering of all visible text.

A tree builder (html_tree) supplies implied tags; rules of visibility say which elements are drawn; and a renderer walks
the tree: blocks stand on lines of their own with a blank line where browsers leave a margin, list items have markers and
indents, preformatted text keeps its spaces, and the cells of a table stand in aligned columns, with those of spanning
cells left empty in the rows below. Formulas, text of pictures and of fields stand in the line, the options of a menu on
lines of their own. What a click opens (`details`) is shown; text that a picture draws again elsewhere (`use`) isn't followed,
and of styles only those in the element itself count.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadflow.llm.html_tree import FORMATTING, HEADINGS, Node, Tree

# Element names of the HTML standard.
UNSEEN = set("title datalist template object audio video canvas rp head".split()) | set(
    "svg:desc svg:title svg:metadata svg:defs svg:symbol svg:clippath svg:mask svg:pattern svg:marker svg:style svg:script".split()
)
#: Of these only the first child is shown.
FIRST_CHILD = {"math:semantics", "math:maction"}
SPACED = HEADINGS | set("p ul ol dl blockquote pre listing xmp table figure fieldset".split())
BLOCKS = SPACED | set("""html body div section article header footer nav main aside address form li dt dd details dialog summary figcaption caption
    legend hgroup menu dir search center tr select optgroup option""".split())
KEPT = {"pre", "listing", "xmp", "textarea"}
LISTS = {"ul", "ol", "menu", "dir"}
#: Controls in a line, which stand apart from what is beside them.
CONTROLS = {"button", "textarea"}
#: Fields that draw their value otherwise than as text.
NO_TEXT = set("hidden password checkbox radio file image range color".split())
#: Lines are indented by so many columns at most, and tables deeper than so many have their cells in the line, so that a page's text is bounded by its size.
MOST_INDENT, MOST_TABLES = 100, 32

_SPACES = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)


def columns(line: str) -> int:
    """The columns that a line takes: two for wide characters, none for those that combine."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def declared(style: str) -> dict[str, str]:
    """The declarations of a style attribute; of equal names the last counts."""
    out = {}
    for one in _COMMENT.sub(" ", style).split(";"):
        name, _, value = one.partition(":")
        out[name.strip().lower()] = value.strip().lower().removesuffix("!important").rstrip()
    return out


def number(own: dict[str, str], name: str, default: int) -> int:
    value = own.get(name, "").strip()
    return int(value) if value.isdecimal() and len(value) < 10 else default


class Lines:
    """Text as lines, with the margins between blocks and the markers and indents of what they stand in."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.levels: list[str] = []  # markers; the first `used` have been drawn and indent what follows by `width`
        self.used = self.width = 0
        self.outside: list[tuple[int, bool]] = []  # per level the lines and the gap when it began

    def text(self, s: str, kept: bool) -> None:
        if kept:
            first, *rest = s.split("\n")
            self.now += [first] * (first != "")
            for line in rest:
                self.end(True)
                self.now += [line] * (line != "")
            return
        s = _SPACES.sub(" ", s)
        if not self.now or self.now[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.now.append(s)

    def end(self, even_empty: bool = False) -> None:
        line = "".join(self.now).rstrip()
        self.now = []
        if not line and not even_empty:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        fresh = self.levels[self.used :]
        self.lines.append((" " * min(self.width, MOST_INDENT) + "".join(fresh) + line).rstrip())
        self.used, self.width = len(self.levels), self.width + sum(map(len, fresh))

    def block(self, spaced: bool) -> None:
        """A block begins or ends. What stands in a level has no margin towards its edges."""
        self.end()
        self.gap = self.gap or (spaced and len(self.lines) > (self.outside[-1][0] if self.outside else 0))

    def open(self, marker: str) -> None:
        self.end()
        self.outside.append((len(self.lines), self.gap))
        self.levels.append(marker)

    def close(self) -> None:
        self.end()
        if len(self.lines) == self.outside[-1][0] and self.levels[-1].strip():
            self.end(True)  # an item without text has its marker
        began, gap = self.outside.pop()
        self.gap = gap and len(self.lines) == began
        marker = self.levels.pop()
        if self.used > len(self.levels):
            self.used, self.width = len(self.levels), self.width - len(marker)


class Table:
    """Rows of cells; each cell is a list of lines and the numbers of columns and of rows that it spans."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.groups: set[int] = set()  # rows with which a group of rows begins

    def placed(self) -> list[list[tuple[list[str], int, int]]]:
        """Per row its cells, each with its first column and the column behind it. Columns that a cell of a row above still spans are passed over."""
        out = []
        busy: list[tuple[int, int, float]] = []  # first column, column behind, row in which they are free again
        for y, row in enumerate(self.rows):
            busy = [] if y in self.groups else [b for b in busy if b[2] > y]
            at, k, here, more = 0, 0, [], []
            for cell, span, down in row:
                while k < len(busy) and busy[k][0] <= at:
                    at = max(at, busy[k][1])
                    k += 1
                here.append((cell, at, at + span))
                if down != 1:
                    more.append((at, at + span, y + down if down else float("inf")))
                at += span
            busy = sorted(busy + more)
            out.append(here)
        return out

    def lines(self) -> list[str]:
        """Columns in which no cell begins take no room. A table that would take far more room than its text has its cells one after another."""
        spanned = sum(min(down or len(self.rows), len(self.rows) - y) for y, row in enumerate(self.rows) for _, _, down in row if down != 1)
        size = sum(sum(map(len, cell)) + 1 for row in self.rows for cell, _, _ in row) + len(self.rows)
        if spanned > 1000 + 64 * size:
            return self.plain()
        rows = self.placed()
        starts = sorted({at for row in rows for _, at, _ in row})
        rows = [[(cell, bisect_left(starts, at), bisect_left(starts, end)) for cell, at, end in row] for row in rows]
        need: dict[tuple[int, int], int] = {}  # of the widest cell from a column to another
        for row in rows:
            for cell, at, end in row:
                need[at, end] = max(need.get((at, end), 0), *map(columns, cell or [""]))
        width = [0] * len(starts)
        for (at, end), n in sorted(need.items(), key=lambda x: (x[0][1] - x[0][0], x[0])):
            # Narrow cells first; what a wider one needs beyond its columns is dealt over them, the first ones getting the rest.
            span = end - at
            more = n - sum(width[at:end]) - 2 * (span - 1)
            for i in range(at, end if more > 0 else at):
                width[i] += more // span + (i - at < more % span)
        edges = list(accumulate((w + 2 for w in width), initial=0))
        if edges[-1] * sum(max([1, *(len(cell) for cell, _, _ in row)]) for row in rows) > 100_000 + 64 * size:
            return self.plain()
        out = []
        for row in rows:
            for i in range(max([1, *(len(cell) for cell, _, _ in row)])):
                parts, free = [], 0
                for cell, at, end in row:
                    if at > free:
                        parts.append(" " * (edges[at] - edges[free] - 2))
                    line = cell[i] if i < len(cell) else ""
                    parts.append(line + " " * (edges[end] - edges[at] - 2 - columns(line)))
                    free = end
                out.append("  ".join(parts).rstrip())
        return [line for k, line in enumerate(out) if line or k]

    def plain(self) -> list[str]:
        out = []
        for row in self.rows:
            out.append("  ".join(cell[0] for cell, _, _ in row if len(cell) == 1))
            out += [line for cell, _, _ in row if len(cell) > 1 for line in cell]
        return [line for line in out if line]


class Layout:
    """Walks a tree and draws what is visible."""

    def __init__(self) -> None:
        self.out: list[Lines] = [Lines()]
        self.tables: list[Table] = []
        self.lists: list[list] = []  # whether numbered, the last number
        self.kept = self.items = 0
        self.shown = True

    def walk(self, top: Node) -> list[str]:
        """Elements are entered and left without recursion, whatever their depth."""
        work = []
        kids: Iterator[Node | str] = iter([top])
        while True:
            for x in kids:
                if isinstance(x, str):
                    self.text(x)
                    continue
                drawn = self.element(x)
                work.append((kids, drawn))
                kids = iter(next(drawn, ()))
                break
            else:
                if not work:
                    break
                kids, drawn = work.pop()
                next(drawn, None)
        self.out[0].end()
        return self.out[0].lines

    def text(self, s: str) -> None:
        if self.shown:
            self.out[-1].text(s, self.kept > 0)

    def element(self, node: Node) -> Iterator[list]:
        """Begins an element, gives the children to draw, and ends it; nothing for an element that isn't displayed."""
        tag, own = node.tag, node.own
        style = declared(own["style"]) if "style" in own else {}
        seen = style.get("visibility")
        if tag.startswith("svg"):
            seen = seen or own.get("visibility")
            if own.get("display") == "none":
                return
        if tag in UNSEEN or "hidden" in own or style.get("display") == "none" or (tag == "dialog" and "open" not in own):
            return
        before = self.shown
        if seen in ("hidden", "collapse", "visible"):
            self.shown = seen == "visible"
        if tag == "math:mphantom":
            self.shown = False
        keeps = tag in KEPT or style.get("white-space", "").startswith(("pre", "break-spaces"))
        self.kept += keeps
        if tag in FORMATTING or tag == "span":
            yield node.kids
        elif tag == "table" and len(self.tables) < MOST_TABLES:
            yield from self.table(node)
        elif tag in ("td", "th") and len(self.tables) < MOST_TABLES:
            yield from self.cell(node)
        else:
            yield from self.other(node)
        self.kept -= keeps
        self.shown = before

    def other(self, node: Node) -> Iterator[list]:
        tag, own, here = node.tag, node.own, self.out[-1]
        block = tag in BLOCKS or (tag == "math" and own.get("display") == "block")
        spaced = tag in SPACED and not (tag in LISTS and self.items)
        if block and not node.rest:
            here.block(spaced)
        if tag == "br":
            here.end(True)
        elif tag == "hr":
            here.block(True)
        elif tag == "input" and own.get("type", "").lower() not in NO_TEXT:
            here.text(" ", False)
            self.text(own.get("value") or own.get("placeholder", ""))
            here.text(" ", False)
        if tag in ("optgroup", "option") and own.get("label"):
            self.text(own["label"])
            here.block(False)
        if tag in LISTS:
            self.lists.append([tag == "ol", number(own, "start", 1) - 1])
            here.open("  " * (self.items > 0))
            yield node.kids
            here.close()
            self.lists.pop()
        elif tag == "li" and not node.rest:
            yield from self.item(node)
        elif tag in ("blockquote", "dd"):
            here.open("  ")
            yield node.kids
            here.close()
        elif tag in FIRST_CHILD:
            yield [x for x in node.kids if isinstance(x, Node)][:1]
        elif tag == "option" and own.get("label"):
            yield []  # its label stands for its text
        elif tag in CONTROLS or tag == "svg:text" or (tag == "svg:tspan" and not own.keys().isdisjoint(("x", "y", "dy"))):
            here.text(" ", False)
            yield node.kids
            here.text(" ", False)
        else:
            if tag == "tr" and 0 < len(self.tables) < MOST_TABLES:
                self.tables[-1].rows.append([])
            elif tag in ("thead", "tbody", "tfoot") and self.tables:
                self.tables[-1].groups.add(len(self.tables[-1].rows))
            elif tag in ("td", "th"):
                here.text("  ", False)
            yield node.kids
        if block and not node.goes_on:
            here.block(spaced)

    def item(self, node: Node) -> Iterator[list]:
        of = self.lists[-1] if self.lists else [False, 0]
        of[1] = number(node.own, "value", of[1] + 1)
        self.items += 1
        self.out[-1].open(f"{of[1]}. " if of[0] else "- ")
        yield node.kids
        self.out[-1].close()
        self.items -= 1

    def table(self, node: Node) -> Iterator[list]:
        self.out[-1].block(True)
        self.tables.append(Table())
        yield node.kids
        for line in self.tables.pop().lines():
            self.out[-1].now = [line]
            self.out[-1].end(True)
        self.out[-1].block(True)

    def cell(self, node: Node) -> Iterator[list]:
        outside, self.lists, self.items, kept, self.kept = (self.lists, self.items), [], 0, self.kept, self.kept
        self.out.append(Lines())
        yield node.kids
        inner = self.out.pop()
        inner.end()
        (self.lists, self.items), self.kept = outside, kept
        row = self.tables[-1].rows[-1]
        row.append((inner.lines, min(max(1, number(node.own, "colspan", 1)), 1000), min(number(node.own, "rowspan", 1), 65534)))


def render(html: str | None) -> str:
    """The visible text of a page, or of a piece of one; none for null."""
    if not html:
        return ""
    lines = Layout().walk(Tree(html).body)
    first = next((i for i, x in enumerate(lines) if x), len(lines))
    last = next((i for i in range(len(lines) - 1, -1, -1) if lines[i]), -1)
    return "\n".join(lines[first : last + 1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars of each row of pages(page_id, html). Null and empty pages have an empty text; any other
    columns, and repeated rows, have no influence. Broken markup is read as browsers do, and time and text are bounded by the page's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string, n_chars long")
