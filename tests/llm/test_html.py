"""Rendering of pages."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from loadflow.llm import html_layout
from loadflow.llm.html_layout import render
from loadflow.llm.html_tree import Tree


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain & &lt;text&gt;", "plain & <text>"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>x</b> <i>y</i>z", "x yz"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "- one\n- two\n    - in\n- three"), ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"), ("<pre> a\n   b</pre>", " a\n   b"),
        ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"), ("<table><tr><td>a<br>b<td>c<tr><td colspan=2>both</table>", "a  c\nb\nboth"), ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        y\n\nin  ner"),
        ("<p>a<div hidden>no</div><span style='display: none'>no</span>b", "a\n\nb"), ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>", "yes"), ("<head><title>t</title></head><body>x<script>if (a<b) '</p>'</script><!-- c -->y", "xy"),
        ("</p></table></li>x</div>", "x"), ("<td>lone<li>item", "lone\n- item"), ("<blockquote>q</blockquote>r", "  q\n\nr"), ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"), ("<h1>H</h1>text<hr>more", "H\n\ntext\n\nmore"),
    ],
)
def test_rendering(html, text):
    assert render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be", "let x=2 be"), ("a<math display=block><mi>y</mi></math>b", "a\ny\nb"),
        ("<math><semantics><mrow><mi>x</mi></mrow><annotation encoding='application/x-tex'>\\bf x</annotation></semantics></math>!", "x!"), ("<math><mphantom><mi>no</mi></mphantom><mi>z</mi></math>", "z"),
        ("p <svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>one</text><text x=1>two <tspan>2</tspan><tspan dy=1>three</tspan></text></svg> q", "p one two 2 three q"),
        ("<svg><text display=none>no</text><text visibility=hidden>no</text><g><text>yes</text></g></svg>", "yes"),
        ("Say: <textarea>\n a &amp; <b>b</b>\n  c</textarea> end", "Say:  a & <b>b</b>\n  c end"), ("x <textarea>open <i>", "x open <i>"), ("<div hidden><textarea><p>no</textarea></div>y", "y"), ("<textarea></textarea>y", "y"),
        ("<p>Pick <select><option>one<option value=2 selected>two</option></select> now</p>", "Pick\none\ntwo\nnow"), ("<select><optgroup label=G><option>a<option label=B>no<optgroup label=H><option>c</select>", "G\na\nB\nH\nc"), ("<datalist><option>no</datalist>y", "y"),
        ("<table><tr><td rowspan=2>A<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "A  b  c\n   d  e\nf  g  h"), ("<table><tr><td>a<td rowspan=2 colspan=2>BB<td>c<tr><td>d<td>e<tr><td>f<td>gg<td>hh<td>i</table>", "a  BB      c\nd          e\nf  gg  hh  i"),
        ("<table><tbody><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</tbody><tr><td>e<td>f</table>", "A  b\n   c\n   d\ne  f"), ("<table><thead><tr><th rowspan=9>H<th>I</thead><tbody><tr><td>1<td>2</table>", "H  I\n1  2"),
        ("<table><tr><td>x<td rowspan=2>y<br>z<tr><td>w</table>", "x  y\n   z\nw"), ("<table><tr><td rowspan=x>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ],
)
def test_text_in_all_that_is_shown(html, text):
    assert render(html) == text


def test_deep_and_broken_pages():
    assert render("<div>" * 5000 + "x") == "x"
    assert "x" in render("<table><tr><td>" * 500 + "x")
    assert render("<ul><li>" * 300 + "x").strip(" -") == "x"
    assert render("<") == "<"


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_layout.extract(pages).collect()
    want = {r["page_id"]: render(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    for r in pages.limit(20).collect():
        assert "track(" not in want[r["page_id"]] and "margin:0" not in want[r["page_id"]] and "&copy;" not in want[r["page_id"]]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><p>Hello</p>world", "Hello\n\nworld"), ("<head><title>t</title><meta charset=x>plain", "plain"), ("<title>t</title><style>p{}</style><h1>H</h1>", "H"), ("<head></head>\n a <title>no</title>b", "a b"),
        ("<select><option>a<p>b</select>c", "a\n\nb\n\nc"), ("<select><option>one<p>rest of the page", "one\n\nrest of the page"), ("<table>x<tr>y<td>a<td>b<tr><div>q</div><td>c</table>z", "xy\nq\n\na  b\nc\n\nz"),
        ("<p style='display:\nnone'>no<p style='DISPLAY : none !important'>no<p style='display:none;display:block'>yes", "yes"), ("<p style='color:red;/* display:none */'>yes", "yes"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<ruby>a<rp>(</rp><rt>b<rp>)</rp></ruby>", "ab"),
        ("Name: <input value=Bob> <input type=hidden value=no><input type=checkbox value=no><input placeholder='your town'>", "Name: Bob your town"), ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<table><tr><td>漢字<td>x<tr><td>ab<td>y</table>", "漢字  x\nab    y"), ("<b hidden><p>no</b>yes</p>z", "yes\n\nz"), ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"), ("<a href=x>a<div>b<a href=y>c</a></div>", "a\nbc"),
        ("<template><p>no</p></template>y", "y"), ("<!-- a > b -->x<!-->y<!- z>w", "xyw"), ("a<![CDATA[no]]>b<svg><text><![CDATA[<c>]]></text></svg>", "ab <c>"), ("<p>a</p", "a"), ("x<div title='a>b' hidden>no</div>", "x"),
        ("<ul><li><p>a</p><p>b</p></li><li>c</ul>", "- a\n\n  b\n- c"), ("<plaintext>a<b>", "a<b>"), ("<svg><g><p>out</svg>", "out"), ("<noscript>no</noscript><iframe>no</iframe>x", "x"), ("<button>a<button>b", "a b"), ("<button>click</button><input value=v><textarea>abc", "click v abc"), ("<table><caption>Cap<tr><td>1</table>", "Cap\n1"),
    ],
)
def test_trees_and_visibility(html, text):
    assert render(html) == text


def shape(node):
    return node if isinstance(node, str) else f"<{node.tag}>{''.join(map(shape, node.kids))}</{node.tag}>"


def test_implied_tags():
    assert shape(Tree("<p>a<p>b<table><tr><td><p>q").root) == "<html><body><p>a</p><p>b</p><table><tbody><tr><td><p>q</p></td></tr></tbody></table></body></html>"
    assert shape(Tree("<ul><li>a<ul><li>b</ul><li>c<dl><dt>d<dd>e").body) == "<body><ul><li>a<ul><li>b</li></ul></li><li>c<dl><dt>d</dt><dd>e</dd></dl></li></ul></body>"
    assert shape(Tree("<td>lone</tr></b></p>").body) == "<body>lone<p></p></body>"


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 200_000 + "x", "<ul><li>" * 60_000 + "x", "<b>" * 200_000 + "x", "<p><b>" * 60_000 + "x", "<select>" * 100_000 + "x", "x" + "<a '" + "b '" * 100_000, "x" + "<!--" * 100_000, "x" + '<a href="' * 50_000,
        "<table>" + "<tr><td rowspan=65534>x" * 20_000, "<table><tr><td>" + "w" * 300_000 + "<td>y" + "<tr><td>a<td>b" * 20_000, "<blockquote>x" * 20_000, "<svg><g>" * 50_000 + "<text>x", "x" + "</b></div></p>" * 50_000,
    ],
)
def test_time_and_text_are_bounded_by_the_page(html):
    began = time.perf_counter()
    text = render(html)
    assert "x" in text or "y" in text
    assert len(text) <= 64 * len(html) and time.perf_counter() - began < 20


def test_tables_within_tables_keep_all_text():
    assert sorted(re.findall(r"t\d+", render("".join(f"<table><tr><td>t{i}" for i in range(500))))) == sorted(f"t{i}" for i in range(500))


class Flat(HTMLParser):
    """Another renderer, for pages without tables: marks in one string, then rules on the marks."""

    def __init__(self, html):
        super().__init__()
        self.parts, self.skip, self.in_p = [], 0, False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("title", "style", "script")
        self.end_p(tag in ("p", "h1", "ul", "li", "div", "nav", "article", "footer"), tag == "p")
        self.parts.append({"p": "\x02", "h1": "\x02", "ul": "\x02", "br": "\x03", "li": "\x01- "}.get(tag, "\x01" if tag in ("div", "nav", "article", "footer", "body") else ""))

    def handle_endtag(self, tag):
        self.skip -= tag in ("title", "style", "script")
        self.end_p(tag in ("p", "ul", "li", "div", "nav", "article", "footer", "body"), False)
        self.parts.append("\x02" if tag in ("p", "h1", "ul") else "\x01" if tag in ("div", "nav", "article", "footer", "li") else "")

    def end_p(self, ends, then):
        self.parts.append("\x02" if self.in_p and ends else "")
        self.in_p = then if ends else then or self.in_p

    def handle_data(self, data):
        self.parts.append("" if self.skip else re.sub(r"[ \t\n\r\f]+", " ", data))

    def text(self):
        lines, gap = [], False
        for line, mark in re.findall("([^\x01-\x03]*)([\x01-\x03]|$)", "".join(self.parts)):
            line = re.sub(" +", " ", line).strip(" ")
            if line or mark == "\x03":
                lines += [""] * (gap and bool(lines)) + [line]
                gap = False
            gap = gap or mark == "\x02"
        return "\n".join(lines).strip("\n")


def test_pages_against_another_renderer(spark, sf_dir):
    pages = [r for f in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")) for r in spark.read.parquet(f"{f}/pages.parquet").collect()]
    for r in pages:
        if not re.search("<(table|pre|ol|dl)", r["html"] or ""):
            assert render(r["html"]) == Flat(r["html"] or "").text()
    assert len(pages) > 250


def test_wide_spanning_cells_keep_columns_aligned():
    assert render("<table><tr><td colspan=2>a very long heading cell<td>X<tr><td>1<td>2<td>Y</table>") == "a very long heading cell  X\n1            2            Y"
    assert render("<table><tr><td>n<td colspan=3>1234567890<td>Z<tr><td>a<td>b<td>c<td>d<td>e</table>") == "n  1234567890  Z\na  b   c   d   e"


def grid(rows):
    """Where the standard's table model puts each cell: a matrix of places taken."""
    taken, out = set(), []
    for y, row in enumerate(rows):
        x = 0
        for word, across, down in row:
            while (x, y) in taken:
                x += 1
            taken |= {(x + i, y + j) for i in range(across) for j in range(down)}
            out.append((word, x, x + across, y))
            x += across
    return out


def test_random_tables_against_a_grid():
    """Cells that begin in one column of the grid stand in one column of the text, in order, and no cell reaches into the next."""
    rnd = random.Random(5)
    for _ in range(400):
        n = 0
        rows = []
        for _ in range(rnd.randint(1, 6)):
            row = []
            for _ in range(rnd.randint(1, 5)):
                n += 1
                row.append((f"c{n}" + "x" * rnd.choice([0, 0, 3, 12]), rnd.choice([1, 1, 1, 2, 3]), rnd.choice([1, 1, 1, 2, 3])))
            rows.append(row)
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{w}" for w, a, d in row) for row in rows) + "</table>"
        lines = render(html).split("\n")
        assert len(lines) == len(rows)
        cells = grid([[(w, a, min(d, len(rows) - y)) for w, a, d in row] for y, row in enumerate(rows)])
        at = {}
        if len({(x, y) for _, a, b, y in cells for x in range(a, b)}) < sum(b - a for _, a, b, _ in cells):
            continue  # cells of this table overlap, which the standard leaves open
        for word, x, _, y in cells:
            assert re.search(rf"(^| ){word}( |$)", lines[y])
            at.setdefault(x, set()).add(re.search(rf"(^| ){word}( |$)", lines[y]).start() + (0 if lines[y].startswith(word) and lines[y].index(word) == 0 else 1))
        assert all(len(v) == 1 for v in at.values()), (html, lines)
        order = [min(at[x]) for x in sorted(at)]
        assert order == sorted(set(order))


def test_extract_of_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "<p>x", "c"), (3, "<p>x", "c"), (None, "y", "d")], "page_id long, html string, text string")
    assert sorted(map(str, html_layout.extract(df).collect())) == sorted(map(str, [*(html_layout.extract(df.drop("text")).collect())]))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_layout.extract(df).collect()) == [(0, "y", 1), (1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    assert html_layout.extract(df.where("false")).count() == 0
