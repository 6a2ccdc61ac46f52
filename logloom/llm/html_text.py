"""HTML extraction by layout-aware rendering.

A tree builder makes elements out of the tags, supplying end tags that HTML lets authors leave
out; visibility rules decide which elements show; a renderer lays the rest out as text: blocks
on lines of their own, paragraphs, headings, lists and tables set off by a blank line, list
items with their marks and indented, preformatted text as written, and table cells padded so
that columns line up. All visible text is emitted, that of formulas and drawings inline.

Tables: cell lines above `PADDED` characters do not widen their column, and a line is padded only
as long as blanks and bars are no more than three times its text and `PADDED`; else, and in tables
of more than `COLUMNS` columns, its cells follow each other. So the text of a page is at most a
small multiple of its markup.

Hidden: what never shows (head, script, style, template, ...), the parts of formulas and drawings
that are there for machines (annotation, desc, metadata, defs, symbol), `hidden`, `display:none`,
`visibility:hidden` (until an element inside is visible again), closed `details` but for their
summary, and closed dialogs. Elements nested deeper than `MAX_DEPTH` are laid out as if at that
depth; their text stays.

Defined results: null gives null; text without tags is text; broken markup never fails (end
tags without a start are ignored, open elements end with the page); repeated rows and null ids
are rendered row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 120
#: Longest line of a cell that others are padded to, and most columns that are lined up.
PADDED, COLUMNS = 100, 100

# HTML's fixed element groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = set("head title script style template noscript iframe object canvas audio video datalist noframes"
                  " annotation annotation-xml desc metadata defs symbol".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure"
            " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre"
            " search section summary table caption tbody tfoot thead tr ul".split())
SET_OFF = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure menu dir".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form"
             " h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd"
             .split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose content is no markup.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noframes", "xmp"}
#: start tag -> (open elements it ends, elements that shield those outside them)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "table"}),
    "optgroup": ({"option", "optgroup"}, {"select", "table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "a": ({"a"}, {"td", "th", "table"}),
}
ROW_GROUPS = {"table", "tbody", "thead", "tfoot"}
SHIELDS_END = {"td", "th", "table", "caption"}

SPACES = re.compile(r"[ \t\n\r\f]+")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
BETWEEN = re.compile(r"[\s/]*")
NAME = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
HIDES = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Element | str] = []


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from `at` on, and the place after the tag; -1 if the tag never ends."""
    found: dict[str, str] = {}
    while True:
        at = BETWEEN.match(page, at).end()
        if at >= len(page):
            return found, -1
        if page[at] == ">":
            return found, at + 1
        name = NAME.match(page, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(page, at):
            at = equals.end()
            quote = page[at:at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = page[at + 1:end], end + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare.group(), bare.end()
        found.setdefault(name.group().lower(), unescape(value))


def tokens(page: str) -> Iterator[tuple]:
    """("text", data), ("start", name, attributes) and ("end", name), in one pass.

    What an unfinished tag or comment holds at the end of a page is no text.
    """
    at = 0
    while at < len(page):
        sign = page.find("<", at)
        if sign < 0:
            yield "text", unescape(page[at:])
            return
        if sign > at:
            yield "text", unescape(page[at:sign])
        if page.startswith("<!--", sign):
            end = page.find("-->", sign + 2)
            at = end + 3 if end >= 0 else len(page)
        elif page[sign + 1:sign + 2] in ("!", "?"):
            end = page.find(">", sign)
            at = end + 1 if end >= 0 else len(page)
        elif tag := TAG.match(page, sign):
            name = tag.group(2).lower()
            given, at = _attributes(page, tag.end())
            if at < 0:
                return
            if tag.group(1):
                yield "end", name
                continue
            yield "start", name, given
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                end = close.start() if close else len(page)
                if end > at:
                    yield "text", unescape(page[at:end]) if name in ("title", "textarea") else page[at:end]
                at = end
        else:
            yield "text", "<"
            at = sign + 1


class TreeBuilder:
    """Elements and texts of a page under one root."""

    def __init__(self, page: str) -> None:
        self.root = Element("html", {})
        self.open = [self.root]
        for kind, *of in tokens(page):
            if kind == "text":
                self.open[-1].children.append(of[0])
            elif kind == "start":
                self.start(*of)
            else:
                self.end(*of)

    def _end(self, names: set[str], shields: set[str]) -> None:
        """Close the innermost open element of these names, and all inside it."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in names:
                del self.open[k:]
                return
            if tag in shields:
                return

    def _end_all(self, names: set[str], shields: set[str]) -> None:
        """Close every open element of these names up to the first shield."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in shields or k == 0:
                cut = [j for j in range(k + 1, len(self.open)) if self.open[j].tag in names]
                if cut:
                    del self.open[cut[0]:]
                return

    def start(self, tag: str, given: dict[str, str]) -> None:
        if tag in ("html", "body"):  # implied anyway; a body ends the head
            self._end({"head"}, set())
            self.open[-1].attrs.update({k: v for k, v in given.items() if k in ("hidden", "style")})
            return
        if tag in BLOCK:
            self._end({"head"}, set())
        if tag in ENDS_P:
            self._end({"p"}, {"td", "th", "table", "caption", "button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in ENDS:
            self._end_all(*ENDS[tag])
        if tag in ("td", "th") and self._inside_table() and self.open[-1].tag in ROW_GROUPS:
            self._add(Element("tr", {}))
        element = Element(tag, given)
        if tag in VOID:
            self.open[-1].children.append(element)
        else:
            self._add(element)

    def _inside_table(self) -> bool:
        return any(e.tag == "table" for e in self.open)

    def _add(self, element: Element) -> None:
        """Open an element; one too deep takes the place of the innermost, beside it."""
        self.open[-1 if len(self.open) < MAX_DEPTH else -2].children.append(element)
        if len(self.open) < MAX_DEPTH:
            self.open.append(element)
        else:
            self.open[-1] = element

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Element("br", {}))
        elif tag in HEADINGS:
            self._end(HEADINGS, SHIELDS_END)
        else:
            self._end({tag}, {"table"} if tag in SHIELDS_END else SHIELDS_END)


class Layout:
    """Lines of text: words flow into the last line, blocks start new ones."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False       # a space is due before the next word
        self.blank = False       # a blank line is due before the next line
        self.indent = ""
        self.mark = ""           # list mark for the next line

    def text(self, data: str) -> None:
        flow = SPACES.sub(" ", data)
        word = flow.strip(" ")
        if (self.space or flow[:1] == " ") and word and self.parts:
            self.parts.append(" ")
        if word:
            self.parts.append(word)
            self.space = False
        self.space = self.space or flow[-1:] == " "

    def end_line(self, always: bool = False) -> None:
        if self.parts or always:
            self.put("".join(self.parts))
        self.parts, self.space = [], False

    def put(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.blank = False
        if self.mark:
            line = self.indent[:-len(self.mark)] + self.mark + line
            self.mark = ""
        elif line:
            line = self.indent + line
        self.lines.append(line.rstrip())

    def set_off(self) -> None:
        self.end_line()
        self.blank = True


def _shown(element: Element, visible: bool) -> bool | None:
    """Whether the element's own text shows; None if nothing inside can."""
    if element.tag in NEVER_SHOWN or "hidden" in element.attrs:
        return None
    if element.tag == "dialog" and "open" not in element.attrs:
        return None
    for name, value in HIDES.findall(element.attrs.get("style", "")):
        if name.lower() == "display" and value.lower() == "none":
            return None
        if name.lower() == "visibility":
            visible = value.lower() == "visible"
    return visible


def _number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"\s*-?\d{1,9}\s*", text) else default


def render(element: Element, out: Layout, visible: bool = True, pre: bool = False) -> None:
    counter = _number(element.attrs.get("start", ""), 1)
    closed = element.tag == "details" and "open" not in element.attrs
    for child in element.children:
        if isinstance(child, str):
            if visible and not closed:
                if pre:
                    first, *rest = child.expandtabs(8).split("\n")
                    out.parts += [first] if first else []
                    for line in rest:
                        out.end_line(always=True)
                        out.parts = [line] if line else []
                else:
                    out.text(child)
            continue
        tag, shows = child.tag, _shown(child, visible)
        if shows is None or (closed and tag != "summary"):
            continue
        if tag == "br":
            out.end_line(always=bool(out.lines))
        elif tag == "hr":
            out.end_line()
            out.put("-" * 20)
        elif tag == "table":
            out.set_off()
            table(child, out, shows)
            out.set_off()
        elif tag == "li":
            out.end_line()
            before, own = out.indent, "- "
            if element.tag == "ol":
                counter = _number(child.attrs.get("value", ""), counter)
                own = f"{counter}. "
                counter += 1
            out.indent, out.mark = before + " " * len(own), own
            render(child, out, shows, pre)
            out.end_line()
            out.indent, out.mark = before, ""
        elif tag in BLOCK:
            nested_list = tag in ("ul", "ol", "menu", "dir") and bool(out.indent)
            set_off = tag in SET_OFF and not nested_list
            (out.set_off if set_off else out.end_line)()
            before = out.indent
            if tag in ("blockquote", "dd"):
                out.indent += "  "
            if tag == "pre":
                text_starts = child.children and isinstance(child.children[0], str)
                if text_starts and child.children[0].startswith("\n"):
                    child.children[0] = child.children[0][1:]
            render(child, out, shows, pre or tag == "pre")
            out.end_line()
            out.indent = before
            (out.set_off if set_off else out.end_line)()
        else:
            render(child, out, shows, pre or tag == "textarea")


def _rows(element: Element, visible: bool):
    """(row, visible) of a table, and what else it holds, in order."""
    for child in element.children:
        if isinstance(child, str):
            if child.strip():
                yield "loose", child, visible
            continue
        shows = _shown(child, visible)
        if shows is None:
            continue
        if child.tag in ("tbody", "thead", "tfoot"):
            yield from _rows(child, shows)
        elif child.tag == "tr":
            yield "row", child, shows
        elif child.tag not in ("col", "colgroup"):
            yield "loose", child, shows


def table(element: Element, out: Layout, visible: bool) -> None:
    """Captions and loose content as blocks, then the rows with their cells padded to columns."""
    rows: list[dict[int, list[str]]] = []
    below: dict[int, int] = {}  # columns taken by a cell from above, and for how many rows
    for kind, child, shows in _rows(element, visible):
        holder = Element("div", {})
        if kind == "loose":
            holder.children = [child]
            render(holder, out, shows)
            out.end_line()
            continue
        cells: dict[int, list[str]] = {}
        column, taken = 0, below
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in child.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                holder = Element("td", {})
                holder.children = [cell]
                cell = holder
            cell_shows = _shown(cell, shows)
            if cell_shows is None:
                continue
            while column in taken:
                column += 1
            inner = Layout()
            render(cell, inner, cell_shows) if cell.tag in ("td", "th") else _wrap(cell, inner, cell_shows)
            inner.end_line()
            cells[column] = inner.lines
            across = min(max(_number(cell.attrs.get("colspan", ""), 1), 1), 1000)
            down = min(max(_number(cell.attrs.get("rowspan", ""), 1), 1), 65534)
            for c in range(column, column + across):
                if down > 1:
                    below[c] = down - 1
            column += across
        rows.append(cells)
    used = sorted({c for cells in rows for c, lines in cells.items() if any(lines)})
    width = dict.fromkeys(used, 0)
    for cells in rows:
        for c, lines in cells.items():
            if c in width:
                width[c] = max(width[c], *(len(line) for line in lines if len(line) <= PADDED), 0)
    for cells in rows:
        for k in range(max((len(lines) for lines in cells.values()), default=0)):
            own = {c: lines[k] for c, lines in cells.items() if k < len(lines) and lines[k]}
            close = " | ".join(own[c] for c in sorted(own))
            if len(used) <= COLUMNS:
                last = used.index(max(own)) + 1 if own else 0  # bars behind the last text but one are left out
                line = " | ".join(own.get(c, "").ljust(width[c]) for c in used[:last + 1])
                if len(line.rstrip()) <= 4 * len(close) + PADDED:
                    close = line
            out.put(close)


def _wrap(element: Element, out: Layout, visible: bool) -> None:
    holder = Element("div", {})
    holder.children = [element]
    render(holder, out, visible)


def extract(html: str | None) -> str | None:
    """The visible text of a page, laid out."""
    if html is None:
        return None
    root = TreeBuilder(html).root
    shows = _shown(root, True)
    out = Layout()
    if shows is not None:
        render(root, out, shows)
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def visible_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py()) for p in pages], pa.string())

    return run(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, text."""
    return pages.select(F.col(id_col).alias("page_id"), visible_text(F.col(html_col)).alias("text"))
