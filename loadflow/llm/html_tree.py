"""A page as a tree of elements, by the HTML standard's rules for implied tags.

Start and end tags that a page leaves out are supplied: html, head and body, paragraphs and items that a later tag ends,
rows and groups of rows of a table; what stands in a table outside of its cells comes before it. Positions
of open elements are kept by tag, so that no tag walks over the elements that are open: the time is linear in the page.
Inline elements that are left open at the end of a block aren't opened again in the next.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

# Element names of the HTML standard.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
IN_HEAD = set("base basefont bgsound link meta title style script noscript noframes".split())
#: Their text holds no tags; of the first set it is never shown.
RAW = set("script style noscript noframes noembed iframe".split())
RAW_SHOWN = set("title textarea xmp".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
SECTIONS = set("tbody thead tfoot".split())
CELLS = set("td th caption".split())
IN_TABLE = SECTIONS | CELLS | set("tr col colgroup".split())
#: What stands directly in these is moved before the table.
GRID = SECTIONS | set("table tr".split())
CLOSES_P = HEADINGS | set(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt
    listing main menu nav ol p plaintext pre search section summary table ul xmp""".split()
)
BARRIERS = set("applet caption html marquee object table td template th".split())
INTEGRATION = set("math:mi math:mo math:mn math:ms math:mtext math:annotation-xml svg:foreignobject svg:desc svg:title".split())
SPECIAL = (CLOSES_P | BARRIERS | GRID | RAW | INTEGRATION | set("body button head select textarea title".split())) - {"dialog"}
#: HTML that ends a formula or picture.
BREAKOUT = HEADINGS | set(
    """b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre ruby s small span strong
    strike sub sup table tt u ul var""".split()
)

_SPACE = " \t\n\f\r"
_OPENING = re.compile(r"<(?=[A-Za-z/!?])")
_NAME = re.compile(rf"[A-Za-z][^{_SPACE}/>]*")
_ATTRIBUTE = re.compile(rf"""[{_SPACE}/]*(?:(>)|([^{_SPACE}/>][^{_SPACE}/>=]*)(?:[{_SPACE}]*=[{_SPACE}]*(?:"([^"]*)"|'([^']*)'|([^{_SPACE}>]*)))?)""")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[{_SPACE}/>])", re.I) for tag in RAW | RAW_SHOWN}


class Node:
    """An element: its tag (`svg:` or `math:` before those of pictures and formulas), attributes and children. Of a block that was
    split in two, the first part goes on and the second is a rest."""

    __slots__ = ("tag", "own", "kids", "goes_on", "rest")

    def __init__(self, tag: str, own: dict[str, str]):
        self.tag, self.own = tag, own
        self.kids: list[Node | str] = []
        self.goes_on = self.rest = False


@lru_cache(1000)
def kinds(tag: str) -> list[str]:
    """The lists that hold the positions of a tag's open elements: its own, and those of sets that tags are held against."""
    out = [tag]
    out += ["#html"] * (":" not in tag and tag not in ("svg", "math"))
    out += ["#barrier", "#button", "#list"] * (tag in BARRIERS | INTEGRATION) + ["#button"] * (tag == "button") + ["#list"] * (tag in ("ol", "ul"))
    out += ["#special"] * (tag in SPECIAL) + ["#stop"] * (tag in SPECIAL - {"address", "div", "p"})
    return out + ["#grid"] * (tag in GRID | CELLS | {"template"}) + ["#heading"] * (tag in HEADINGS) + ["#section"] * (tag in SECTIONS) + ["#term"] * (tag in ("dd", "dt"))


class Tree:
    """The body of a page as a tree."""

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.root, self.body = Node("html", {}), Node("body", {})
        self.begun = False  # whether the body has
        self.open: list[Node] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self._enter(self.root)
        self._read()

    # The stack of open elements

    def _enter(self, node: Node) -> None:
        for k in kinds(node.tag):
            self.where[k].append(len(self.open))
        self.open.append(node)

    def _cut(self, depth: int) -> None:
        while len(self.open) > max(depth, 1 + self.begun):
            for k in kinds(self.open.pop().tag):
                self.where[k].pop()

    def _last(self, kind: str) -> int:
        found = self.where.get(kind)
        return found[-1] if found else -1

    def _add(self, item: Node | str, moved: bool = True) -> None:
        into = self.open[-1]
        if moved and into.tag in GRID:
            kids = self.open[self._last("table") - 1].kids
            kids.insert(len(kids) - 1, item)  # an open table is the last child
        else:
            into.kids.append(item)

    def _push(self, tag: str, own: dict[str, str], moved: bool = True) -> None:
        node = Node(tag, own)
        self._add(node, moved)
        self._enter(node)

    def _begin_body(self, own: dict[str, str]) -> None:
        self.begun, self.body.own = True, own
        self.root.kids.append(self.body)
        self._enter(self.body)

    # Tokens

    def _read(self) -> None:
        html = self.html
        while self.at < len(html):
            m = _OPENING.search(html, self.at)
            here = m.start() if m else len(html)
            if here > self.at:
                self._text(unescape(html[self.at : here]))
            self.at = here
            if m:
                self._markup(html, here)

    def _markup(self, html: str, here: int) -> None:
        after = html[here + 1]
        name = _NAME.match(html, here + 1 + (after == "/"))
        if name:
            own, closed = self._attributes(name.end())
            if self.at <= len(html):
                self._end(name[0].lower()) if after == "/" else self._start(name[0].lower(), own, closed)
        elif html.startswith("<!--", here):
            m = _COMMENT_END.search(html, here + 2)
            self.at = m.end() if m else len(html)
        elif html.startswith("<![CDATA[", here) and ":" in self.open[-1].tag + ":" * (self.open[-1].tag in ("svg", "math")):
            to = html.find("]]>", here)
            self._text(html[here + 9 : to if to >= 0 else len(html)])
            self.at = to + 3 if to >= 0 else len(html)
        elif after == "/" and here + 2 == len(html):
            self._text("</")
            self.at = len(html)
        else:
            self.at = html.find(">", here) + 1 or len(html)

    def _attributes(self, at: int) -> tuple[dict[str, str], bool]:
        """Of a tag; a tag that the page's end cuts off sets the place beyond the page."""
        own: dict[str, str] = {}
        while m := _ATTRIBUTE.match(self.html, at):
            at = m.end()
            if m[1]:
                self.at = at
                return own, m[0].endswith("/>")
            value = m[3] or m[4] or m[5] or ""
            own.setdefault(m[2].lower(), unescape(value) if "&" in value else value)
        self.at = len(self.html) + 1
        return own, False

    def _raw(self, tag: str) -> str:
        m = _RAW_END[tag].search(self.html, self.at)
        text, self.at = self.html[self.at : m.start() if m else len(self.html)], m.start() if m else len(self.html)
        return text

    # Construction

    def _text(self, s: str) -> None:
        s = s.replace("\0", "")
        blank = not s.strip(_SPACE)
        if not self.begun and not self.where["template"]:
            if blank:
                return
            self._begin_body({})
            s = s.lstrip(_SPACE)
        if s and not (blank and self.open[-1].tag in GRID):
            self._add(s)

    def _close_p(self) -> None:
        if self._last("p") > self._last("#button"):
            self._cut(self._last("p"))

    def _start(self, tag: str, own: dict[str, str], closed: bool) -> None:
        here = self.open[-1].tag
        if (":" in here and here not in INTEGRATION) or here in ("svg", "math"):
            if tag not in BREAKOUT and not (tag == "font" and not own.keys().isdisjoint(("color", "face", "size"))):
                self._push(tag if tag in ("svg", "math") else f"{here.partition(':')[0]}:{tag}", own)
                if closed:
                    self._cut(len(self.open) - 1)
                return
            self._cut(1 + max(self._last("#html"), *(self._last(t) for t in INTEGRATION)))
            here = self.open[-1].tag
        if tag in ("html", "head", "body"):
            if tag == "body" and not self.begun:
                self._begin_body(own)
            elif tag != "head":
                node = self.root if tag == "html" else self.body
                node.own = own | node.own
            return
        tag = "img" if tag == "image" else tag
        if tag == "template":
            return self._push(tag, own, False)
        if not self.begun and not self.where["template"]:
            if tag in IN_HEAD:
                if tag in RAW | RAW_SHOWN:
                    self._raw(tag)
                return
            self._begin_body({})
            here = "body"
        if tag in IN_TABLE:
            return self._start_in_table(tag, own)
        if tag == "table" and self._last("#grid") >= 0 and self.open[self._last("#grid")].tag in GRID:
            self._cut(self._last("table"))
        if tag == "form" and here in GRID:
            return
        if tag in ("li", "dd", "dt"):
            item = self._last("li" if tag == "li" else "#term")
            if 0 <= item == self._last("#stop"):
                self._cut(item)
        if tag in CLOSES_P:
            self._close_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        elif tag == "button" and self._last(tag) > self._last("#barrier"):
            self._cut(self._last(tag))
        elif tag in ("a", "nobr") and self._last(tag) > self._last("#barrier"):
            self._end(tag)
        select = self._last("select")
        if select > self._last("#barrier") and tag in ("select", "input", "textarea"):
            self._cut(select)
            if tag == "select":
                return
        elif tag in ("option", "optgroup", "hr"):
            for t in ("option", "optgroup")[: 1 if tag == "option" else 2]:
                if self._last(t) > select >= 0 or self.open[-1].tag == t:
                    self._cut(self._last(t))
        if tag in ("rb", "rt", "rtc", "rp") and self.open[-1].tag in ("rb", "rt", "rtc", "rp"):
            self._cut(len(self.open) - 1)
        if tag in VOID:
            self._add(Node(tag, own))
        elif tag in RAW:
            self._raw(tag)
        elif tag in RAW_SHOWN:
            node = Node(tag, own)
            text = self._raw(tag)
            node.kids.append(text if tag == "xmp" else unescape(text).removeprefix("\n"))
            self._add(node)
        elif tag == "plaintext":
            self._add(Node("pre", own))
            self.open[-1].kids[-1].kids.append(self.html[self.at :])
            self.at = len(self.html)
        else:
            self._push(tag, own)
            if tag in ("svg", "math") and closed:
                self._cut(len(self.open) - 1)
            elif tag in ("pre", "listing") and self.html.startswith("\n", self.at):
                self.at += 1

    def _start_in_table(self, tag: str, own: dict[str, str]) -> None:
        table = self._last("table")
        if table <= self._last("template"):
            return
        if tag in ("caption", "col", "colgroup") or tag in SECTIONS:
            self._cut(table + 1)
            if tag not in ("col", "colgroup"):
                self._push(tag, own, False)
            return
        if tag != "tr" and self._last("tr") > table:
            self._cut(self._last("tr") + 1)
        elif self._last("#section") > table:
            self._cut(self._last("#section") + 1)
        else:
            self._cut(table + 1)
            self._push("tbody", {}, False)
        if tag != "tr" and self.open[-1].tag != "tr":
            self._push("tr", {}, False)
        self._push(tag, own, False)

    def _end(self, tag: str) -> None:
        here = self.open[-1].tag
        if ":" in here or here in ("svg", "math"):
            found = max(self._last(tag if tag in ("svg", "math") else f"{k}:{tag}") for k in ("svg", "math"))
            if found > self._last("#html"):
                return self._cut(found)
            if tag in ("p", "br"):
                self._cut(1 + self._last("#html"))
        if tag in ("html", "head", "body", "br") or not (self.begun or self.where["template"]):
            if tag == "br":
                self._start("br", {}, False)
            return
        found, barrier = self._last(tag), self._last("#barrier")
        if tag == "p" and found <= self._last("#button"):
            self._start("p", {}, False)
            found = len(self.open) - 1
        elif tag in HEADINGS:
            found = max(found, self._last("#heading"))
        elif tag == "li":
            barrier = self._last("#list")
        elif tag in IN_TABLE or tag == "table":
            barrier = max(self._last("table"), self._last("template"))
        elif tag == "template":
            barrier = -1
        elif tag in FORMATTING:
            return self._end_formatting(tag)
        elif tag not in SPECIAL:
            barrier = self._last("#special")
        if found >= max(barrier, 0):
            self._cut(found)

    def _end_formatting(self, tag: str) -> None:
        """An inline element that a block inside it outlives: only if it was hidden does that matter, and the block is split."""
        found = self._last(tag)
        if found <= self._last("#barrier"):
            return
        if found > self._last("#special"):
            return self._cut(found)
        if "hidden" in self.open[found].own or "style" in self.open[found].own:
            inside = self.open[found + 1 :]
            self._cut(found)
            for node in inside:
                node.goes_on = True
                self._push(node.tag, node.own)
                self.open[-1].rest = True
