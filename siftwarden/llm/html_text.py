"""Operator 7, HTML extraction: layout-aware rendering of whole pages to text.

A tree builder turns tags into nodes, with the end tags that HTML implies (p before a block, li, dt and dd, table parts,
options) and void and raw-text elements; what is left open ends with its parent or the page.  All visible text is given out: not
the head, scripts, styles, templates, or elements that `hidden`, `display:none` or `visibility:hidden` hide.  Blocks stand on lines of
their own, paragraphs, headings, lists and tables with a blank line about them; list items have a mark or number and an indent for each
level; `br` breaks a line; `pre` keeps its white space; table cells are padded to their column's width.

Time is linear in the page's length, whatever it holds: open elements are looked up by name, a tag ends at the next `<` outside
quotes, cells are padded to WIDEST at most, lists indented to DEEPEST levels, spans widened to SPAN cells, and tables nested deeper than
NESTED given out as blocks; all their text stays.

Nulls and edges: a null page gives null, an empty one or one without visible text an empty text; a lone `<` is text; tags that
close nothing are dropped; any depth of nesting is walked without recursion; of attributes of one name the first counts; repeated rows
give a row each; a very long page is rendered whole by its task; other columns of pages stay as they are, one named as the text
column gives way to it; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# A quote opens a value only just after `=`; one that never closes is a part of the value.
_ATTR = r"(?:=[^\s/>=<]*+|[^\s/>=<]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s><]++|(?=>)))?+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/><]*+)((?:[\s/]++|{_ATTR})*+)>", re.S)
_SPACE = re.compile(r"[ \t\n\f\r]+")
_EACH = re.compile(_ATTR, re.S)
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes datalist title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt fieldset figcaption footer form header hr html legend li main nav option section summary tr td th caption thead tbody tfoot".split())
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
# What a start tag ends, and what it may not reach beyond.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}


#: Bounds of layout: what a cell is padded to, levels of indent, cells that a span widens to, tables within tables.
WIDEST, DEEPEST, SPAN, NESTED = 80, 20, 50, 8


def attributes_of(text: str) -> dict[str, str]:
    """Names, in lower case, and values; the first of a name counts."""
    seen: dict[str, str] = {}
    for m in _EACH.finditer(text):
        name, _, value = m[0][1:].partition("=")
        value = value.strip()
        seen.setdefault((m[0][0] + name).strip().lower(), value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1] else value)
    return seen


def _hides(attributes: str) -> bool:
    """Whether there is an attribute `hidden`, or one `style` that hides."""
    seen = attributes_of(attributes)
    if "hidden" in seen:
        return True
    rules = {}
    for rule in _COMMENT.sub("", unescape(seen.get("style", ""))).lower().split(";"):
        name, _, value = rule.partition(":")
        value, important, _ = value.partition("!")
        if important or not rules.get(name.strip(), ("", ""))[1]:
            rules[name.strip()] = (value.strip(), important)
    return rules.get("display", ("",))[0] == "none" or rules.get("visibility", ("",))[0] == "hidden"


def _span(attributes: str, name: str) -> int:
    value = attributes_of(attributes).get(name, "")
    return min(SPAN, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


class Node:
    __slots__ = ("tag", "hidden", "children", "columns", "rows")

    def __init__(self, tag: str, hidden: bool, attributes: str = ""):
        self.tag, self.hidden, self.children = tag, hidden, []
        spans = tag in ("td", "th") and "span" in attributes.lower()
        self.columns, self.rows = (_span(attributes, "colspan"), _span(attributes, "rowspan")) if spans else (1, 1)


class _Open:
    """The elements that are open, outermost first, and for each name at what depths."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], defaultdict(list)

    def last(self, tag: str) -> int:
        """The depth of the innermost open element of a name; 0 if none is open."""
        return self.depths[tag][-1] if self.depths.get(tag) else 0

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Ends all from a depth on."""
        for node in self.path[depth:]:
            self.depths[node.tag].pop()
        del self.path[depth:]

    def close(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        """Ends the outermost open element among tags this side of a wall, with all within it."""
        wall = max(map(self.last, walls))
        found = [d[k] for d in (self.depths.get(t, ()) for t in tags) if (k := bisect_right(d, wall)) < len(d)]
        if found:
            self.cut(min(found))


# End tags that reach beyond a cell.
_TABLE_ENDS = frozenset("table tr tbody thead tfoot body html".split())


def tree(html: str) -> Node:
    root, pos = Node("", False), 0
    open_ = _Open(root)
    while m := _TAG.search(html, pos):
        if m.start() > pos:
            open_.path[-1].children.append(unescape(html[pos : m.start()]))
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            at = open_.last(tag)
            if at and (tag in ("td", "th") or tag in _TABLE_ENDS or at > max(open_.last("td"), open_.last("th"))):
                open_.cut(at)
            continue
        if tag in BLOCK:
            open_.close(("p",), ("td", "th", "li", "div", "button", "table"))
        if tag in ENDS:
            open_.close(ENDS[tag], WALLS.get(tag, ("table",)))
        node = Node(tag, tag in UNSEEN or _MAY_HIDE.search(m[3]) is not None and _hides(m[3]), m[3])
        open_.path[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, pos)
            raw = html[pos : end.start() if end else len(html)]
            node.children.append(unescape(raw) if tag == "textarea" else raw)
            pos = end.start() if end else len(html)
            pos = html.find(">", pos) + 1 or len(html) if end else pos
        elif tag not in VOID:
            open_.push(node)
    if pos < len(html):
        open_.path[-1].children.append(unescape(html[pos:]))
    return root


class _Flow:
    """Lines under way: inline text gathers until a block's edge; edges ask for one line end or a blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap, self.lead = 0, ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.inline.append(first)
            for x in rest:
                self.flush(True)
                self.inline.append(x)
        else:
            self.inline.append(_SPACE.sub(" ", s))

    def flush(self, keep: bool = False) -> None:
        s = "".join(self.inline)
        s = s if keep else re.sub(" +", " ", s).strip(" ")
        self.inline.clear()
        if s or keep or self.lead.strip():
            if s or self.lines:
                if self.gap == 2 and self.lines and self.lines[-1]:
                    self.lines.append("")
            self.lines.append((self.lead + s).rstrip() if not keep else self.lead + s)
            self.gap, self.lead = 0, re.sub(r"\S", " ", self.lead)

    def edge(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.flush()
        return self.lines


class _Grid:
    """A table's rows of cells; `below` holds, by column, how many rows a cell from above still reaches into."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.below: dict[int, int] = {}

    def _skip(self) -> None:
        row = self.rows[-1]
        while (n := self.below.get(len(row), 0)) > 0:
            self.below[len(row)] = n - 1
            row.append("")

    def start(self) -> None:
        self.rows.append([])

    def add(self, cell: str, node: Node) -> None:
        self._skip()
        for k in range(node.columns):
            if node.rows > 1:
                self.below[len(self.rows[-1])] = node.rows - 1
            self.rows[-1].append(cell if k == 0 else "")


def _aligned(rows: list[list[str]]) -> list[str]:
    """Columns side by side, each as wide as its widest cell, WIDEST at most."""
    width = [0] * max(map(len, rows), default=0)
    for r in rows:
        for k, cell in enumerate(r):
            width[k] = max(width[k], min(len(cell), WIDEST))
    return [" | ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows]


def render(html: str) -> str:
    flow, flows, lists, grids, pre, beyond = _Flow(), [], [], [], 0, 0
    todo: list[tuple[Node | str, bool]] = [(tree(html), True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            flow.text(node, pre > 0)
            continue
        tag = node.tag
        if enter:
            if node.hidden:
                continue
            todo.append((node, False))
            beyond += tag == "table" and len(grids) >= NESTED
            if tag == "br":
                flow.flush(True) if flow.inline and pre == 0 and "".join(flow.inline).strip() == "" else flow.flush()
            elif tag in ("td", "th") and grids and not beyond:
                flows.append(flow)
                flow = _Flow()
                if not grids[-1].rows:
                    grids[-1].start()
            elif tag == "tr" and grids and not beyond:
                grids[-1].start()
            elif tag in BLOCK:
                # a list within an item stays with it
                flow.edge(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
                if tag == "table" and not beyond:
                    grids.append(_Grid())
                elif tag == "pre":
                    pre += 1
                elif tag in ("ul", "ol"):
                    lists.append([tag, 0])
                elif tag == "li":
                    mark = "- "
                    if lists:
                        lists[-1][1] += 1
                        mark = f"{lists[-1][1]}. " if lists[-1][0] == "ol" else "- "
                    flow.lead = "  " * min(DEEPEST, max(0, len(lists) - 1)) + mark
            todo += [(c, True) for c in reversed(node.children)]
        elif tag in ("td", "th") and grids and not beyond:
            cell = " ".join(x.strip() for x in flow.done() if x.strip())
            flow = flows.pop()
            grids[-1].add(cell, node)
        elif tag == "table" and beyond:
            beyond -= 1
            flow.edge(2)
        elif tag == "table" and grids:
            flow.edge(2)
            for line in _aligned([r for r in grids.pop().rows if r]):
                flow.inline.append(line)
                flow.flush(True)
            flow.gap = 2
        elif tag in BLOCK and tag != "tr":
            if tag == "pre" and flow.inline:
                flow.flush(True)
            flow.edge(2 if tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1) else 1)
            if tag == "pre":
                pre -= 1
            elif tag in ("ul", "ol") and lists:
                lists.pop()
            if tag in ("li", "ul", "ol"):
                flow.lead = ""
    return "\n".join(flow.done()).strip("\n")


def rendered(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the visible text of column `html`."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else render(x) for x in column.to_pylist()], pa.string())

    return pages.withColumn(text, run(html))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rendered(table(spark, sf_dir, "pages", "page_id", "html"))
    return out.select("page_id", F.char_length("text").cast("long").alias("n_chars"), "text")
