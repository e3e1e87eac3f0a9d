"""HTML to text by layout: a tree with implied tags, visibility rules, and a rendering of blocks, lists and tables.

The tree builder follows what browsers do with the markup pages really hold: void elements, raw text, end tags implied by a
following block, list item, cell or row, and stray end tags ignored. The renderer emits all visible text: blocks on lines of
their own, a blank line around paragraphs and headings, list markers with indentation, table cells in aligned columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import shape

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noframes noembed iframe xmp".split())
RAW_WITH_ENTITIES = frozenset("title textarea".split())
HIDDEN = frozenset("head title script style noscript noframes noembed template iframe object video audio canvas datalist svg map col colgroup link meta base param source track rp dialog".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr caption ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre listing xmp ul ol menu dir dl table figure hr fieldset".split())
ENDS_PARAGRAPH = BLOCK - frozenset("html body option optgroup legend caption tbody td tfoot th thead tr dd dt li".split()) | frozenset(("li", "dd", "dt"))
#: start tag -> (open elements it ends, elements that stop the search).
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th", "caption"), ("table", "tr")),
    "th": (("td", "th", "caption"), ("table", "tr")),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "colgroup": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
#: Elements whose children are table parts only; whatever else stands in them is moved before the table.
TABLE_CONTEXT = SECTIONS | {"table", "tr"}
TABLE_PARTS = SECTIONS | {"tr", "td", "th", "caption", "colgroup", "col"}
#: Elements are nested so deep at most; deeper ones become siblings, as in browsers.
DEEPEST = 200
#: A table column is padded to so many characters at most; longer cells stand whole and push the next one right.
WIDEST = 40

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_BLANK = " \t\n\r\f"
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> Node:
    """The element tree; text nodes are strings with entities resolved."""
    root = Node("#root", {})
    stack = [root]
    at, end = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            piece = unescape(piece)
            if stack[-1].tag in ("head", "colgroup") and piece.strip(_BLANK):
                _leave(stack, "head", "colgroup")
            _place(stack, piece)

    while at < end:
        open_at = html.find("<", at)
        if open_at < 0:
            text(html[at:])
            break
        text(html[at:open_at])
        if html.startswith("<!--", open_at):
            close = html.find("-->", open_at + 4)
            if html.startswith((">", "->"), open_at + 4):
                close = html.find(">", open_at) - 2
            at = close + 3 if close >= 0 else end
            continue
        if html.startswith(("<!", "<?"), open_at):
            close = html.find(">", open_at)
            at = close + 1 if close >= 0 else end
            continue
        match = _TAG.match(html, open_at) or _PLAIN_TAG.match(html, open_at)
        if not match:
            if html.startswith("</", open_at) and (close := html.find(">", open_at)) >= 0:
                at = close + 1  # a bogus comment
            else:
                text("<")
                at = open_at + 1
            continue
        at = match.end()
        tag = match[2].lower()
        if match[1]:
            _close(stack, tag)
            continue
        attrs = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(match[3])} if match[3].strip(" \t\r\n/") else {}
        _open(stack, tag, attrs)
        if tag in RAW or tag in RAW_WITH_ENTITIES:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            raw = html[at : close.start() if close else end]
            stack[-1].children.append(unescape(raw) if tag in RAW_WITH_ENTITIES else raw)
            at = close.start() if close else end
    return root


def _open(stack: list[Node], tag: str, attrs: dict[str, str]) -> None:
    if tag in ("html", "body") and any(n.tag == tag for n in stack):
        return
    if tag not in HIDDEN or tag in ("dialog",):
        _leave(stack, "head", "colgroup")  # body is implied by the first thing that cannot be in head
    elif tag not in ("col", "template"):
        _leave(stack, "colgroup")
    if tag in ENDS_PARAGRAPH:
        _end_within(stack, ("p",), ("button", "td", "th", "caption", "table", "object", "template"))
    if tag in IMPLIED_ENDS:
        ends, stops = IMPLIED_ENDS[tag]
        while _end_within(stack, ends, (*stops, "template")):
            pass
    if tag in TABLE_PARTS:
        _back_to_table(stack)
    elif stack[-1].tag in TABLE_CONTEXT:
        if tag == "form":
            return  # empty in a table: what follows belongs to the table
        if tag == "table":
            _end_within(stack, ("table",), ("template",))
    if tag in ("td", "th") and stack[-1].tag != "tr" and any(n.tag == "table" for n in stack):
        _push(stack, Node("tr", {}))
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        stack.pop()
    node = Node(tag, attrs)
    _push(stack, node)
    if tag in VOID:
        stack.pop()


def _push(stack: list[Node], node: Node) -> None:
    if len(stack) > DEEPEST:
        stack.pop()
    _place(stack, node)
    stack.append(node)


def _place(stack: list[Node], child: Node | str) -> None:
    """Append to the innermost open element; from outside the cells of a table it moves before the table."""
    if stack[-1].tag in TABLE_CONTEXT and (child.strip(_BLANK) if isinstance(child, str) else child.tag not in TABLE_PARTS and child.tag not in ("table", "template")):
        i = len(stack) - 1
        while stack[i].tag in TABLE_CONTEXT and stack[i].tag != "table":
            i -= 1
        if stack[i].tag == "table":
            stack[i - 1].children.insert(-1, child)  # an open table is its parent's last child
            return
    stack[-1].children.append(child)


def _leave(stack: list[Node], *tags: str) -> None:
    while stack[-1].tag in tags:
        stack.pop()


def _back_to_table(stack: list[Node]) -> None:
    """Before a part of a table, end what was opened in the table outside of its cells."""
    for i in range(len(stack) - 1, 0, -1):
        tag = stack[i].tag
        if tag in TABLE_CONTEXT:
            del stack[i + 1 :]
            return
        if tag in ("td", "th", "caption") or tag in HIDDEN:
            return


def _end_within(stack: list[Node], tags: tuple[str, ...], stops: tuple[str, ...]) -> bool:
    """Close the innermost open element among ``tags`` unless one of ``stops`` is further in."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return True
        if stack[i].tag in stops:
            return False
    return False


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        _place(stack, Node("br", {}))
        return
    if tag == "p" and not any(n.tag == "p" for n in stack):
        _place(stack, Node("p", {}))
        return
    if tag in ("html", "body"):
        return  # what follows still belongs to the body
    stops = ("table",) if tag in ("td", "th", "tr") else ("td", "th", "caption", "button", "table") if tag == "form" else ("td", "th", "caption", "button") if tag not in ("table", "tbody", "thead", "tfoot", "template") else ()
    _end_within(stack, (tag,), tuple(s for s in stops if s != tag))


def visible(node: Node) -> bool:
    if node.tag in HIDDEN and not (node.tag == "dialog" and "open" in node.attrs):
        return False
    if "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found":
        return False
    if node.tag == "input":
        return False
    return not (style := node.attrs.get("style")) or not _HIDING.search(style)


class _Lines:
    """Lines under construction: collapses blanks, keeps at most one empty line between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.open = False  # a space is due before the next word
        self.gap = False

    def words(self, text: str) -> None:
        body = _SPACES.sub(" ", text)
        if not body:
            return
        if body == " ":
            self.open = self.open or bool(self.now)
            return
        if (self.open or body[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(body.strip(" "))
        self.open = body[-1] == " "

    def exact(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline(keep=True)
            if line:
                self.now.append(line)
        self.open = False

    def newline(self, keep: bool = False) -> None:
        """End the line; an empty one only counts with ``keep``."""
        line = "".join(self.now).replace("\xa0", " ").rstrip()
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(line)
        self.now, self.open = [], False

    def space(self) -> None:
        self.newline()
        self.gap = True

    def add(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.newline()
        for i, line in enumerate(lines):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(((first if i == 0 else rest) + line).rstrip())


def render(node: Node, out: _Lines, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if pre:
                out.exact(child)
            else:
                out.words(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            out.newline(keep=True)
        elif tag == "hr":
            out.space()
        elif tag == "table":
            out.space()
            out.add(table_lines(child))
            out.space()
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = node.tag == "li"
            out.newline() if nested else out.space()
            _list(child, out)
            out.newline() if nested else out.space()
        elif tag == "li":  # outside any list
            out.add(inner(child) or [""], "- ", "  ")
        elif tag == "dd":
            out.add(inner(child), "  ", "  ")
        elif tag == "details" and "open" not in child.attrs:
            out.newline()
            summary = Node("div", {})
            summary.children = [c for c in child.children if not isinstance(c, str) and c.tag == "summary"][:1]
            render(summary, out, pre)
            out.newline()
        elif tag in ("pre", "listing", "xmp", "textarea"):
            out.space()
            body = _Lines()
            render(child, body, True)
            body.newline()
            out.add(body.lines[1:] if body.lines[:1] == [""] else body.lines)
            out.space()
        elif tag in BLOCK:
            out.space() if tag in SPACED else out.newline()
            render(child, out, pre)
            out.space() if tag in SPACED else out.newline()
        else:
            render(child, out, pre)


def inner(node: Node) -> list[str]:
    out = _Lines()
    render(node, out)
    out.newline()
    return out.lines


def _list(node: Node, out: _Lines) -> None:
    start = node.attrs.get("start", "1").strip()
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    step = -1 if "reversed" in node.attrs else 1
    loose = Node("div", {})
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            loose.children.append(child)
            continue
        out.add(inner(loose), "  ", "  ")
        loose = Node("div", {})
        if not visible(child):
            continue
        value = child.attrs.get("value", "").strip()
        number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
        marker = f"{number}. " if node.tag == "ol" else "- "
        number += step
        out.add(inner(child) or [""], marker, " " * len(marker))
    out.add(inner(loose), "  ", "  ")


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(most, max(1, int(value))) if value.isdigit() and len(value) < 6 else 1


def _rows(table: Node) -> Iterator[Node]:
    for child in table.children:
        if not isinstance(child, str) and visible(child):
            if child.tag == "tr":
                yield child
            elif child.tag in SECTIONS:
                yield from _rows(child)


def _strays(table: Node) -> Iterator[Node | str]:
    for child in table.children:
        if isinstance(child, str) or child.tag not in TABLE_CONTEXT - {"table"} and child.tag not in ("colgroup", "col"):
            yield child
        elif child.tag in SECTIONS and visible(child):
            yield from _strays(child)


def table_lines(table: Node) -> list[str]:
    """Caption and rows of a table, cells padded to the width of their column.

    A cell keeps its own lines; spanned columns and rows stay empty beside and below their cell. What stands in a table
    outside of cells comes before it, as browsers move it.
    """
    lines: list[str] = []
    stray = Node("div", {})
    stray.children = list(_strays(table))
    lines += inner(stray)
    grid: list[dict[int, list[str]]] = []
    below: dict[int, int] = {}  # column -> rows still spanned from above
    for row in _rows(table):
        cells: dict[int, list[str]] = {}
        column = 0
        spanned, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip():
                    cells.setdefault(column, []).append(" ".join(cell.split()))
                continue
            if not visible(cell):
                continue
            while column in spanned:
                column += 1
            cells[column] = cells.get(column, []) + inner(cell)
            wide, tall = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            if tall > 1:
                below |= dict.fromkeys(range(column, column + wide), tall - 1)
            column += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, body in cells.items():
            widths[column] = max(widths.get(column, 0), min(WIDEST, max(map(len, body), default=0)))
    used = sorted(c for c, width in widths.items() if width)
    for cells in grid:
        for i in range(max((len(body) for body in cells.values()), default=0)):
            parts = [(body[i] if i < len(body) else "") for body in (cells.get(c, []) for c in used)]
            line = "  ".join(part.ljust(widths[c]) for part, c in zip(parts, used, strict=True)).rstrip()
            if line:
                lines.append(line)
    return lines


def text_of(html: str | None) -> str | None:
    """The visible text of a page; null for null, empty where nothing is visible."""
    if html is None:
        return None
    lines = inner(parse(html.replace("\x00", "")))
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The columns of ``pages`` but ``column``, and ``text``, its visible text; one row per row.

    Null gives null; broken markup gives what a browser would show of it. A column called text is replaced.
    """
    rest = [c for c in pages.columns if c not in (column, "text")]
    rows = pages.select(*rest, F.col(column).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([text_of(html) for html in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(run, shape(rows, *rest, text="string"))
