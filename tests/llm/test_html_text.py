"""Rendered pages: layout by example, and all visible words against the standard parser."""

import time
from html.parser import HTMLParser

import pytest

from codequarry.llm.html_text import extract_text, render

CASES = [
    (None, ""),
    ("", ""),
    ("just &lt;text&gt; &amp; more\n  words", "just <text> & more words"),
    ("<p>One<p>Two <b>bold</b>\n text</p>tail", "One\n\nTwo bold text\n\ntail"),
    ("<div>a</div><div>b<span> c</span></div>", "a\nb c"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ol start=3><li>z</li><li value=9>w<li>v</ol></ul>end", "- x\n- y\n  3. z\n  9. w\n  10. v\n\nend"),
    ("<table><tr><th>Name<th>N<tr><td>long name</td><td>1<tr><td colspan=2>both</table>", "Name      | N\nlong name | 1\nboth"),
    ("<table>\n<caption>C</caption><td>a<td>b</table>", "C\na | b"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table></td><td>b</table>", "a        | b\n         |\nin | ner |"),
    ("<pre>  keep\n   this </pre>x", "keep\n   this\n\nx".replace("keep", "  keep")),
    ("<head><title>t</title><style>p{}</style></head><script>var a='</p>';</script>seen", "seen"),
    ("<div hidden>no</div><p style='color:red; DISPLAY : none'>no</p><p style='visibility:hidden'>no</p>yes", "yes"),
    ("<!-- no --><![CDATA[no]]>a<!-- never closed", "a"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<dl><dt>T<dd>d1<dd>d2</dl>", "T\n  d1\n  d2"),
    ("<p>a</div></span></p></p>b", "a\n\nb"),
    ("<a href='x>y'>q</a> <img alt='no'> 1 < 2 <unknown x=\"never closed>z", "q 1 < 2 z"),
    ("<textarea> a\n b</textarea>", "a\n b".replace("a", " a", 1)),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td colspan=2>wide one<tr><td>x<td>y</table>", "A | B\n  | C\nwide one\nx | y"),
    ("<div style='visibility:hidden'>no <span style='visibility: visible'>yes</span> no</div><p>z", "yes\n\nz"),
    ("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math> <svg><text>label</text><title>no</title></svg><select><option>one<option>two</select>", "x= label\none\ntwo"),
    ("<table><thead><tr><th rowspan=2>H<th>K</thead><tbody><tr><td>a<td>b</table>", "H | K\na | b"),
    ("<table><tfoot><tr><td>sum<td>3</tfoot><tr><td>a<td>1<tr><td>b<td>2<thead><tr><th>n<th>v</thead></table>", "n   | v\na   | 1\nb   | 2\nsum | 3"),
    ("<table><tr><td rowspan=2 colspan=3>A<td>x<tr><td>B</table>", "A | x\n  | B"),
    ("<table><tr><td rowspan=0>A<td>x<tr><td>y<tbody><tr><td>B<td>z</table>", "A | x\n  | y\nB | z"),
    ("<table><tr><td rowspan=2>A<td>x<tr></tr><tr><td>y<td>z</table>", "A | x\ny | z"),
    ("Name <input value='Ada'><input type=submit value='Send'><input type=hidden value=no><input type=password value=no><input type=checkbox value=no><button>Go</button>", "Name Ada Send Go"),
    ("<input hidden value=no><span style='visibility:hidden'><input value=no></span>a", "a"),
    ("<style>/* .z{} */ .x, p.y{color:red;display:none} #k{visibility:hidden}</style><p class='a x'>no<p class=y>no<div class=y>yes</div><b id=k>no</b><p>z", "yes\n\nz"),
    ("<style>@media print{.x{display:none}} .h{display:none!important} div{display:none} .s{display:block}</style><p class=x>x<p class=h style='display:block'>no<div>no</div><div class=s>s</div>", "x\n\ns"),
    ("<ol type=a><li>x<li value=27>y</ol><ol type=I><li value=4>z<li value=-1>w</ol>", "a. x\naa. y\n\nIV. z\n-1. w"),
    ("<datalist><option>no</datalist><p>word<p" + " word" * 3, "word\n\n".strip()),
    ("<p>" + "long " * 40_000, ("long " * 40_000).strip()),
    ("<h1>T</h1>" + "<div>" * 5000 + "deep", "T\n\ndeep"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_layout(page, want):
    assert render(page) == want


#: Elements that show nothing, listed here apart from the module.
UNSEEN = set("head script style template noscript title iframe noembed noframes datalist object audio video canvas rp desc defs metadata annotation".split())


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.depth, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.depth.append(tag)

    def handle_endtag(self, tag):
        if self.depth and self.depth[-1] == tag:
            self.depth.pop()

    def handle_data(self, data):
        if not self.depth:
            self.words += data.split()


def test_all_visible_text_of_pages_in_order(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    bare = lambda s: "".join(s.split()).replace("|", "").replace("-", "")
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert bare(got[r.page_id]) == bare(" ".join(plain.words)), r.page_id


@pytest.mark.parametrize("part", ["<blockquote>a", "<ul><li>a", "<table><tr><td>a", "<table><tr><td rowspan=99999>a<tr><td colspan=1000>a", "<p><button><div>x"])
def test_nesting_costs_and_gives_what_the_page_is_long(part):
    seconds = []
    for n in (3000, 6000):
        t = time.perf_counter()
        out = render(part * n)
        seconds.append(time.perf_counter() - t)
        assert len(out) <= 400 * n
    assert seconds[1] < 3 * seconds[0] + 1


def test_spans_have_no_bound_of_their_own():
    page = "<table><tr><td rowspan=5000>A<td>r0" + "".join(f"<tr><td>r{k}" for k in range(1, 5000)) + "<tr><td>B<td>z</table>"
    lines = render(page).split("\n")
    assert lines[0] == "A | r0" and lines[4999] == "  | r4999" and lines[5000] == "B | z"


def test_spans_that_fill_too_much_are_blocks():
    n = 3000
    out = render("<table>" + "".join(f"<tr><td rowspan=65534 colspan=1000>c{k}" for k in range(n)) + "</table>")
    assert out.split("\n") == [f"c{k}" for k in range(n)]


def test_nested_tables_keep_their_grids():
    page = "<table><tr><td>a<td>" * 20 + "in" + "</table>" * 20
    assert render(page) == "a | " * 20 + "in"


def test_deep_nesting_takes_linear_time():
    assert render("<div>" * 60_000 + "<p>deep<p>er" + "</span>" * 1000) == "deep\n\ner"


def test_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None), (1, "<p>a"), (1, "<p>a"), (None, "b")], "page_id long, html string").selectExpr("*", "1 as text", "2 as id", "3 as n_chars")
    assert sorted(map(tuple, extract_text(df).collect()), key=str) == [(1, "", 0), (1, "a", 1), (1, "a", 1), (None, "b", 1)]
    assert extract_text(df.limit(0)).count() == 0
