"""Layout-aware text of web pages.

A tokenizer and a tree builder with implied tags make a tree of elements; visibility rules drop what
a browser doesn't show; the rest is laid out as text. Blocks start on lines of their own, with a
blank line around paragraphs, headings, lists and tables; list items get markers (numbers, letters or
Roman numerals as the list's type says) and are indented by their depth; cells of a table stand on a
grid, with the columns and rows they span, and are padded so that columns align; white space collapses
except in preformatted text. A table's first thead comes first and its first tfoot last; spans end with
their row group. What is hidden by the property visibility hides its descendants until one is visible
again. Rules of style elements count where their selector is one of names, classes and ids without
combinators, and outside of at-rules. All options of a select are text, and so are the labels of buttons
and the values of text inputs, but not placeholders and passwords.

Each page is one row and is rendered by itself, so any split of the table is a good one; nothing
is shuffled. All loops are over explicit stacks, so deep nesting is no limit. Two limits keep the
work and the output in proportion to the page: indents grow up to INDENT columns, and tables that
are nested in TABLES others, or whose spans would fill more than PLACES places for each cell, are laid
out as blocks; no text is lost by it. By the rules of HTML, colspan counts up to 1000 and rowspan up to
65534; numbers of more than nine digits are ignored.

Defined cases: null and empty pages give empty text; very long pages are read whole; text without tags is a paragraph; unclosed
comments, tags and quotes end with the page; unknown elements are inline; repeated rows are
answered one by one; other columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_words = lambda s: frozenset(s.split())
# Element names by role.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noembed noframes")
HIDDEN = _words("head script style template noscript title iframe noembed noframes datalist object audio video canvas area param source track rp desc defs metadata annotation annotation-xml")
TABLE = _words("table caption tr td th tbody thead tfoot")
BLOCK = _words("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary ul table caption tr td th tbody thead tfoot")
SPACED = _words("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dl table figure fieldset")
CLOSES_P = _words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul")
#: Element that starts -> open elements that it ends, and those beyond which it doesn't look.
IMPLIED_END = {
    "li": (_words("li"), _words("ul ol menu")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "option": (_words("option"), _words("select datalist optgroup")),
    "optgroup": (_words("option optgroup"), _words("select")),
    "tr": (_words("tr td th caption"), _words("table")),
    "td": (_words("td th caption"), _words("tr table")),
    "th": (_words("td th caption"), _words("tr table")),
    "tbody": (_words("tbody thead tfoot tr td th caption"), _words("table")),
    "thead": (_words("tbody thead tfoot tr td th caption"), _words("table")),
    "tfoot": (_words("tbody thead tfoot tr td th caption"), _words("table")),
    "caption": (_words("caption"), _words("table")),
    "rt": (_words("rt rp"), _words("ruby")),
    "rp": (_words("rt rp"), _words("ruby")),
    "body": (_words("head"), _words("")),
}
SCOPE = _words("table td th caption button object template html body")
_P, _TABLE = _words("p"), _words("table")
CELLS = _words("td th tr tbody thead tfoot caption")
GROUPS = _words("thead tbody tfoot")
LABELLED = _words("submit button reset")
TYPED = _words("text search url tel email number date time month week datetime-local")
INDENT, TABLES, PLACES = 64, 32, 100

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>?|(?P<text>[^<]+|<)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_SHOW = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_SHOW = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
_RULE = re.compile(r"([^{};]*)([{};])")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)", re.I)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_VISIBLE = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\s*(!\s*important)?", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attr(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where open elements of a name stand, so that no tag needs a walk

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def innermost(tags: frozenset) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    def close(ends: frozenset, until: frozenset) -> None:
        """Close the outermost open element of ends that stands within until."""
        if not any(places.get(t) for t in ends):
            return
        wall = innermost(until)
        first = [p[k] for t in ends if (p := places.get(t)) and (k := bisect_right(p, wall)) < len(p)]
        if first:
            cut(min(first))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            top = stack[-1]
            if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not text.isspace():
                _foster(stack, places["table"]).children.append(html.unescape(text))
            else:
                top.children.append(html.unescape(text) if "&" in text else text)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and innermost(_P) <= innermost(SCOPE):
                stack[-1].children.append(Node("p"))
            elif places.get(name):
                scope = _TABLE if name in CELLS else SCOPE - {name}
                if name in ("table", "body", "html") or innermost(scope) < places[name][-1]:
                    cut(places[name][-1])
            continue
        if name in ("html", "body") and places.get(name):
            continue
        if name in CLOSES_P:
            close(_P, SCOPE)
        if name in IMPLIED_END:
            close(*IMPLIED_END[name])
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(_child(stack[-1], "tr"))
        if name not in HIDDEN and name not in ("html", "base", "link", "meta") and stack[-1].tag == "head":
            cut(len(stack) - 1)
        node = _child(stack[-1], name, m["attrs"] or m["attrs2"] or "")
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            inner = page[at : stop.start() if stop else n]
            if name in ("textarea", "xmp", "style"):
                node.children.append(html.unescape(inner) if name == "textarea" else inner)  # a style shows nothing itself
            at = stop.end() if stop else n
        elif name not in VOID:
            push(node)
    return root


def _child(parent: Node, tag: str, attrs: str = "") -> Node:
    node = Node(tag, attrs)
    parent.children.append(node)
    return node


def _foster(stack: list[Node], tables: list[int]) -> Node:
    """Text straight in a table goes before it."""
    if not tables:
        return stack[-1]
    k = tables[-1]
    parent = stack[k - 1]
    if parent.children and parent.children[-1] is stack[k]:
        holder = Node("div")
        parent.children.insert(len(parent.children) - 1, holder)
        return holder
    return parent


class Styles:
    """What the style elements of a page say of display and visibility."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = defaultdict(list)  # by the id, class or name that an element must have
        order = 0
        for sheet in sheets:
            depth, head, at_rule = 0, "", False
            for m in _RULE.finditer(_COMMENT.sub(" ", sheet)):
                if m[2] == "{":
                    depth += 1
                    if depth == 1:
                        head, at_rule, body = m[1].strip(), m[1].strip().startswith("@"), ""
                elif depth:
                    body += m[1] + ";" if depth == 1 else ""
                    if m[2] == "}":
                        depth -= 1
                        if not depth and not at_rule:
                            order += 1
                            self.add(head, body, order)

    def add(self, head: str, body: str, order: int) -> None:
        for kind, pattern in (("display", _DISPLAY), ("visibility", _VISIBLE)):
            found = [(bool(m[2]), m[1].lower()) for m in pattern.finditer(body)]
            if not found:
                continue
            strong, value = max(enumerate(found), key=lambda x: (x[1][0], x[0]))[1]
            for part in head.split(","):
                m = _SELECTOR.fullmatch(part.strip())
                if not m or not m[0]:
                    continue
                needs = re.findall(r"[.#][\w-]+", m[2])
                tag = (m[1] or "*").lower()
                rank = (strong, sum(x[0] == "#" for x in needs), sum(x[0] == "." for x in needs), tag != "*", order)
                self.rules[needs[0] if needs else tag].append((kind, rank, tag, needs, value))

    def of(self, node: Node) -> dict[str, tuple]:
        """For display and visibility the strongest rule that holds: its rank and value."""
        best: dict[str, tuple] = {}
        if not self.rules:
            return best
        has = {node.tag, "*"}
        if node.attrs:
            has |= {"." + c for c in (node.attr("class") or "").split()}
            own = node.attr("id")
            has |= {"#" + own} if own else set()
        for key in has & self.rules.keys():
            for kind, rank, tag, needs, value in self.rules[key]:
                if tag in ("*", node.tag) and has.issuperset(needs) and (kind not in best or rank > best[kind][0]):
                    best[kind] = (rank, value)
        return best


def sheets_of(root: Node) -> list[str]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            out += [c for c in node.children if isinstance(c, str)]
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def displayed(node: Node, rules: dict[str, tuple]) -> bool:
    if node.tag in HIDDEN or (node.tag == "dialog" and node.attr("open") is None):
        return False
    rank, value = rules.get("display", (None, None))
    style = (node.attr("style") or "") if node.attrs else ""
    if style and _NO_SHOW.search(style):
        return False
    if value and (rank[0] or not _DISPLAY.search(style)):  # an important rule is stronger than the element's own style
        return value != "none"
    return not (node.attrs and node.attr("hidden") is not None)


def shows(node: Node, outer: bool, rules: dict[str, tuple]) -> bool:
    """Whether text straight in a node is visible, given that of its parent."""
    own = _SHOW.search(node.attr("style") or "") if node.attrs else None
    rank, value = rules.get("visibility", (None, None))
    if value and (rank[0] or not own):
        return value == "visible"
    return own[1].lower() == "visible" if own else outer


def label_of(node: Node) -> str:
    """What an input shows: a button's label, a text field's value."""
    kind = (node.attr("type") or "text").strip().lower()
    return (node.attr("value") or "") if kind in LABELLED or kind in TYPED else ""


def number(n: int, kind: str) -> str:
    """An item's number as an ordered list's type writes it; what a type can't write is decimal."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(ord(kind) + k) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


class Page:
    """Lines of text with an indent for each open list."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.indent, self.marker = "", "", ""
        self.gap = 0  # 1: a new line is due, 2: a blank line

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.replace("\r\n", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.end_line(True)
                if part:
                    self.put(part)
            return
        s = _SPACE.sub(" ", s)
        if s.startswith(" ") and (not self.line or self.line.endswith(" ") or self.gap):
            s = s[1:]
        if s:
            self.put(s)

    def put(self, s: str) -> None:
        if self.gap:
            self.end_line()
            if self.gap == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.line:
            self.line = self.indent + self.marker
            self.indent += " " * len(self.marker) if len(self.indent) < INDENT else ""
            self.marker = ""
        self.line += s

    def end_line(self, always: bool = False) -> None:
        if self.line.strip() or always:
            self.lines.append(self.line.rstrip())
        self.line = ""

    def due(self, gap: int) -> None:
        self.gap = max(self.gap, gap)

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def grid(groups: list[list[list[tuple[str, int, int]]]]) -> list[list[tuple[int, int, list[str]]]] | None:
    """Rows of (text, columns, rows that a cell spans), by row group, as rows of (first column, columns, lines).

    Columns that a cell from above still spans hold one empty cell; a span ends with its row group, and a row
    without cells counts for it. Columns in which no cell starts are left out. None if spans would fill more than
    PLACES places for each cell.
    """
    room = PLACES * (PLACES + sum(len(row) for rows in groups for row in rows))
    out = []
    for rows in groups:
        taken: list[tuple[int, int, int]] = []  # first column, the one after the last, rows left; disjoint and in order
        for row in rows:
            room -= len(taken)
            if room < 0:
                return None
            at, i, cells, new = 0, 0, [], []
            for text, span, down in [*row, (None, 0, 0)]:
                while i < len(taken) and taken[i][0] <= at:
                    if taken[i][1] > at:
                        cells.append((at, taken[i][1] - at, [""]))
                        at = taken[i][1]
                    i += 1
                if text is not None:
                    cells.append((at, span, text.split("\n")))
                    if down > 1:
                        new.append((at, at + span, down - 1))
                    at += span
            old, taken, k = [(a, b, n - 1) for a, b, n in taken if n > 1], [], 0
            for a, b, n in old:  # a new span may cover the start of an old one
                while k < len(new) and new[k][0] <= a:
                    taken.append(new[k])
                    k += 1
                a = max(a, taken[-1][1]) if taken else a
                if a < b:
                    taken.append((a, b, n))
            taken += new[k:]
            if row:
                out.append(cells)
    starts = sorted({at for cells in out for at, _, _ in cells})
    return [[(k := bisect_left(starts, at), max(1, bisect_left(starts, at + span) - k), lines) for at, span, lines in cells] for cells in out]


def table_lines(groups: list[list[list[tuple[str, int, int]]]]) -> list[str]:
    """Lines of the rows, each column as wide as its widest cell of one column."""
    cells = grid(groups)
    if cells is None:
        return [line for rows in groups for row in rows for text, _, _ in row for line in text.split("\n")]
    wide = [0] * max((at + span for row in cells for at, span, _ in row), default=0)
    for row in cells:
        for at, span, lines in row:
            if span == 1:
                wide[at] = max(wide[at], *map(width, lines))
    for row in cells:
        for at, span, lines in row:
            lack = max(map(width, lines)) - sum(wide[at : at + span]) - 3 * (span - 1)
            wide[at + span - 1] += max(0, lack)
    made = []
    for row in cells:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts = []
            for at, span, lines in row:
                s = lines[k] if k < len(lines) else ""
                parts.append(s + " " * (sum(wide[at : at + span]) + 3 * (span - 1) - width(s)))
            made.append(" | ".join(parts).rstrip())
    return made


def _number(s: str | None, default: int) -> int:
    return int(s) if s and re.fullmatch(r"-?[0-9]{1,9}", s.strip()) else default


def _rows(groups: list[tuple[str, list]]) -> list:
    """The rows of the row group that is open; rows straight in a table make one of their own."""
    if not groups:
        groups.append(("", []))
    return groups[-1][1]


def _in_place(groups: list[tuple[str, list]]) -> list[list]:
    """The row groups with the first thead at the top and the first tfoot at the bottom."""
    head = next((k for k, (tag, _) in enumerate(groups) if tag == "thead"), None)
    foot = next((k for k, (tag, _) in enumerate(groups) if tag == "tfoot"), None)
    order = [k for k in (head,) if k is not None] + [k for k in range(len(groups)) if k not in (head, foot)] + [k for k in (foot,) if k is not None]
    return [groups[k][1] for k in order]


def render(page: str | None) -> str:
    """The visible text of a page."""
    out = Page()
    pages, tables, lists = [], [], []
    pre = flat = 0  # open preformatted elements; tables that are laid out as blocks
    seen = [True]  # visibility of the open elements
    root = parse(page or "")
    styles = Styles(sheets_of(root))
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if seen[-1]:
                out.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            rules = styles.of(node)
            if not displayed(node, rules):
                continue
            if tag == "input":
                if shows(node, seen[-1], rules) and (label := label_of(node)):
                    out.text(f" {label} ", pre > 0)
                continue
            if tag == "br":
                if out.gap or not out.line:
                    out.put("")
                out.end_line(True)
                continue
            seen.append(shows(node, seen[-1], rules))
            if tag == "table" and (flat or len(tables) >= TABLES):
                flat += 1
            if tag == "details" and node.attr("open") is None:
                kids = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"]
            else:
                kids = node.children
            if tag in ("td", "th", "caption") and not flat:
                pages.append(out)
                out = Page()
            elif tag in BLOCK:
                out.due(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag in ("ul", "ol", "menu"):
                step = -1 if node.attr("reversed") is not None else 1
                items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
                lists.append([(node.attr("type") or "1").strip() if tag == "ol" else "", _number(node.attr("start"), items if step < 0 else 1), step])
            elif tag == "li":
                todo.append((node, (out.indent, out.marker)))
                numbered, n, step = lists[-1] if lists else ("", 0, 0)
                if numbered:
                    n = _number(node.attr("value"), n)
                    lists[-1][1] = n + step
                out.marker = f"{number(n, numbered)}. " if numbered else "- "
            elif tag in ("dd", "blockquote"):
                todo.append((node, (out.indent, out.marker)))
                out.indent += "  " if len(out.indent) < INDENT else ""
            elif tag == "table" and not flat:
                tables.append(([], []))
                pages.append(out)
                out = Page()
            elif tag in GROUPS and tables and not flat:
                tables[-1][0].append((tag, []))
            elif tag == "tr" and tables and not flat:
                _rows(tables[-1][0]).append([])
            pre += tag in ("pre", "textarea", "xmp")
            if tag not in ("li", "dd", "blockquote"):
                todo.append((node, True))
            todo += [(c, False) for c in reversed(kids)]
            continue
        seen.pop()
        pre -= tag in ("pre", "textarea", "xmp")
        if flat and tag in TABLE:
            flat -= tag == "table"
            out.due(1)
            continue
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif leaving is not True:
            out.indent, out.marker = leaving
        if tag in GROUPS and tables:
            tables[-1][0].append(("", []))  # what follows is no longer in this group
        if tag in ("td", "th", "caption"):
            text, out = out.done(), pages.pop()
            if not tables:
                out.text(text + " ", True)
            elif tag == "caption":
                tables[-1][1].append(text)
            else:
                rows = _rows(tables[-1][0])
                if not rows:
                    rows.append([])
                down = _number(node.attr("rowspan"), 1)
                rows[-1].append((text, max(1, min(1000, _number(node.attr("colspan"), 1))), 65534 if down == 0 else max(1, min(65534, down))))
        elif tag == "table":
            groups, captions = tables.pop()
            stray, out = out.done(), pages.pop()
            for line in [*captions, *([stray] if stray else []), *table_lines(_in_place(groups))]:
                for part in line.split("\n"):
                    if part.strip():
                        out.due(1)
                        out.put(part)
        if tag in BLOCK and tag not in ("td", "th", "caption"):
            out.due(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
    return out.done()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id, text and n_chars."""
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "text": pa.array([render(h) for h in b.column("html").to_pylist()], pa.string())})

    out = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "text", F.char_length("text").cast("long").alias("n_chars"))
