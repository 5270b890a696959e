"""Visible text of HTML pages, laid out.

``TreeBuilder`` turns tags into a tree of open elements with the end tags that HTML implies (a
``li`` ends the ``li`` before it, a block ends an open ``p``, a cell ends a cell, what may not stand in a
head ends it) and ignores end
tags of what is not open. Elements that are not rendered, or are hidden by attribute or
style hide all they hold, also by simple selectors (tag, class, id) of style sheets that stand before
them; closed dialogs and details do too. Text that is only invisible leaves its place, and what is made visible again
inside shows. What is visible goes to a stack of boxes: blocks begin on a new
line, paragraphs, headings, lists and tables have an empty line around them, list items have a
mark and are indented by depth, ``pre`` keeps its white space, and table rows are lines whose cells
are padded to the widths of their columns, cells of several rows keeping their place below. Buttons and
fields show their values. Declarations that are malformed are comments.

Pages are rendered one by one without recursion, so depth of nesting does not matter; a task
holds one page at a time.

Defined results: a null or empty page has an empty text. Repeated rows are rendered one by one. An
empty table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe object canvas audio video datalist noframes".split()
)
#: Elements with rules of their own, and what in them is not rendered.
FOREIGN = frozenset("svg math".split())
FOREIGN_UNSEEN = frozenset("desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split())
#: Their white space is kept.
KEPT = frozenset("pre textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center dd details dialog div dt fieldset figcaption footer form header"
    " hgroup legend li main menu nav section summary caption tr thead tbody tfoot td th option".split()
)
ENDS_P = SPACED | frozenset(
    "address article aside center details dialog div dl fieldset figcaption footer form header hgroup main menu"
    " nav section summary".split()
)
#: For an opening tag: the open elements it ends, and those beyond which it does not look.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: What may stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("head title script style template noscript base link meta noframes".split())
#: An end tag does not close what is outside of these.
SCOPES = frozenset("table td th caption html".split())
_GAP = re.compile(r"[ \t\n\r\f]+")
#: Fixed values of HTML: fields that show their value; elements that an end tag of another kind does not close.
SHOWN_INPUTS = frozenset("text search email url tel number date month week time datetime-local submit button reset".split())
SPECIAL = BLOCKS | frozenset("button head iframe noscript object script select style template textarea title marquee".split())
INDENT = "  "

_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)")
_PART = re.compile(r"([.#])([\w-]+)")
SEEN_STYLES = ("display", "visibility")


def declared(style: str) -> dict[str, str]:
    """What a list of declarations says about display and visibility."""
    found: dict[str, str] = {}
    style = style.lower()
    if "display" in style or "visibility" in style:
        for part in style.split(";"):
            name, _, value = part.partition(":")
            if name.strip() in SEEN_STYLES:
                found[name.strip()] = value.replace("!important", "").strip()
    return found


class StyleSheet:
    """Rules of simple selectors that touch display or visibility."""

    def __init__(self) -> None:
        #: By tag, class or id that a rule needs: its weight, place, all it needs, and what it says.
        self.rules: dict[str, list[tuple[tuple[int, int, int], int, str, frozenset, dict[str, str]]]] = {}
        self.count = 0

    def read(self, text: str) -> None:
        text = _COMMENT.sub(" ", text)
        if "display" not in text.lower() and "visibility" not in text.lower():
            return
        depth_free = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", " ", text)
        for selectors, body in _RULE.findall(depth_free):
            said = declared(body)
            for selector in selectors.split(",") if said else ():
                whole = _SELECTOR.fullmatch(selector.strip())
                if not whole or not selector.strip():
                    continue
                tag, parts = whole[1] or "", frozenset(k + name for k, name in _PART.findall(whole[2]))
                ids = sum(p[0] == "#" for p in parts)
                self.count += 1
                rule = ((ids, len(parts) - ids, bool(tag)), self.count, tag, parts, said)
                self.rules.setdefault(min(parts) if parts else tag, []).append(rule)

    def says(self, tag: str, given: dict[str, str]) -> dict[str, str]:
        if not self.rules:
            return {}
        own = {"." + c for c in given.get("class", "").split()}
        if "id" in given:
            own.add("#" + given["id"])
        found = [r for key in (tag, *own) for r in self.rules.get(key, ()) if r[2] in ("", tag) and r[3] <= own]
        said: dict[str, str] = {}
        for rule in sorted(found, key=lambda r: r[:2]):
            said.update(rule[4])
        return said


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class Box:
    """Lines of text under construction, with the empty lines that stand between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.pending = ""
        self.wanted = 0
        self.space = False
        self.prefix: list[str] = []
        self.mark = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.end_line(keep=True)
                self._put(line)
            return
        words = _GAP.sub(" ", data)
        if words.startswith(" "):
            self.space = self.space or bool(self.parts)
            words = words[1:]
        if not words:
            return
        tail = words.endswith(" ")
        self._put((" " if self.space and self.parts else "") + words.rstrip(" "))
        self.space = tail

    def _put(self, text: str) -> None:
        if text:
            if not self.parts:
                self.lines += [""] * (self.wanted if self.lines else 0)
                self.wanted = 0
                lead = "".join(self.prefix)
                self.parts.append(lead[: len(lead) - len(self.mark)] + self.mark if self.mark else lead)
                self.mark = ""
            self.parts.append(text)

    def end_line(self, keep: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        elif keep and self.lines:
            self.lines.append("")
        self.space = False

    def gap(self) -> None:
        self.end_line()
        self.wanted = 1

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self.end_line()
            if line:
                self._put(line)
        self.end_line()

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


class Cell:
    def __init__(self, columns: int, rows: int) -> None:
        self.columns, self.rows = columns, rows
        self.lines: list[str] = []


class Table:
    def __init__(self) -> None:
        self.rows: list[list[Cell]] = []

    def placed(self) -> list[list[tuple[int, Cell]]]:
        """The cells of each row with their column; cells of rows above keep their columns."""
        out, below = [], []
        for k, row in enumerate(self.rows):
            below = [(at, to, last) for at, to, last in below if last >= k]
            taken, at, places, begun = sorted(below), 0, [], []
            for cell in row:
                for low, high, _ in taken:
                    if low < at + cell.columns and at < high:
                        at = high
                places.append((at, cell))
                if cell.rows != 1:
                    last = k + cell.rows - 1 if cell.rows else len(self.rows)
                    begun.append((at, at + cell.columns, last))
                at += cell.columns
            below += begun
            out.append(places)
        return out

    def lines(self) -> list[str]:
        """Rows with their cells one beside the other, padded to the width of the column."""
        placed = self.placed()
        widths = [0] * max((at + cell.columns for row in placed for at, cell in row), default=0)
        for row in placed:
            for at, cell in row:
                if cell.columns == 1:
                    widths[at] = max(widths[at], max(map(width, cell.lines), default=0))
        out = []
        for row in placed:
            for k in range(max((len(cell.lines) for _, cell in row), default=0)):
                parts, done = [], 0
                for at, cell in row:
                    parts += [" " * widths[c] for c in range(done, at)]
                    room = sum(widths[at : at + cell.columns]) + 3 * (cell.columns - 1)
                    text = cell.lines[k] if k < len(cell.lines) else ""
                    parts.append(text + " " * (room - width(text)))
                    done = at + cell.columns
                out.append(" | ".join(parts).rstrip())
        return [line for line in out if line]


class TreeBuilder(HTMLParser):
    #: No tags inside; entities of a textarea are read in ``handle_data``.
    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hides: list[bool] = []
        self.hidden = 0
        #: Whether the text of each open element is seen where it is not hidden.
        self.visible: list[bool] = []
        #: How many details that are closed are open elements.
        self.folded: list[int] = []
        self.sheet = StyleSheet()
        self.pre = 0
        self.foreign = 0
        self.boxes = [Box()]
        self.tables: list[Table] = []
        self.lists: list[list] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and self.open[-1] == "head" and tag not in IN_HEAD:
            self._close_at(len(self.open) - 1)
        if tag in ENDS_P and self._within("p"):
            self._close_to("p")
        ended, bounds = ENDS.get(tag, ((), ()))
        for k in range(len(self.open) - 1, -1, -1):
            if not ended or self.open[k] in bounds:
                break
            if self.open[k] in ended:
                self._close_at(k)
                break
        if tag in ("td", "th") and self.tables and not self._within("tr", ("table",)):
            self.handle_starttag("tr", [])
        given = {name: value or "" for name, value in attrs}
        said = {**self.sheet.says(tag, given), **declared(given.get("style", ""))}
        hides = (
            tag in UNSEEN
            or (tag in FOREIGN_UNSEEN and self._foreign())
            or said.get("display", "none" if "hidden" in given else "") == "none"
            or (tag == "dialog" and "open" not in given)
            or (tag != "summary" and self._folded())
        )
        seen = self.visible[-1] if self.visible else True
        if "visibility" in said:
            seen = said["visibility"] not in ("hidden", "collapse") if said["visibility"] != "inherit" else seen
        if tag in VOID:
            if not self.hidden and not hides:
                if tag == "br":
                    self.boxes[-1].end_line(keep=True)
                elif tag == "hr":
                    self.boxes[-1].gap()
                elif tag == "input" and seen and given.get("type", "text").lower() in SHOWN_INPUTS:
                    self.boxes[-1].text(given.get("value", ""), False)
            return
        if tag == "details" and "open" not in given:
            self.folded.append(len(self.open))
        self.open.append(tag)
        self.visible.append(seen)
        self.hides.append(hides)
        self.hidden += hides
        self.foreign += tag in FOREIGN
        if not self.hidden:
            self._begin(tag, given)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._foreign():
            self._close_at(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in VOID:
            self._close_to(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "head" and data.strip(" \t\n\r\f"):
            self._close_at(len(self.open) - 1)
        if self.open and self.open[-1] == "style":
            self.sheet.read(data)
        if self.hidden or self._folded():
            return
        if self.open and self.open[-1] in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol") and not data.strip():
            return
        if self.visible and not self.visible[-1]:
            data = " "
        elif self.open and self.open[-1] == "textarea":
            data = unescape(data)
        self.boxes[-1].text(data, self.pre > 0)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Text of a CDATA section in drawings and formulas; anything else of its kind is a comment."""
        cdata = self.rawdata.startswith("<![CDATA[", i) and self._foreign()
        end = self.rawdata.find("]]>" if cdata else ">", i)
        if end < 0:
            return -1
        if cdata:
            self.handle_data(self.rawdata[i + 9 : end])
        return end + (3 if cdata else 1)

    def _folded(self) -> bool:
        """Whether what comes stands directly in details that are closed."""
        return bool(self.folded) and self.folded[-1] == len(self.open) - 1

    def _foreign(self) -> bool:
        if self.foreign:
            for name in reversed(self.open):
                if name in FOREIGN or name == "foreignobject":
                    return name in FOREIGN
        return False

    def _within(self, tag: str, bounds: tuple[str, ...] | frozenset = SCOPES) -> bool:
        for name in reversed(self.open):
            if name == tag:
                return True
            if name in bounds:
                return False
        return False

    def _close_to(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag:
                if tag not in SPECIAL and any(name in SPECIAL for name in self.open[k + 1 :]):
                    # what stands around a block that is still open ends without it
                    self.hidden -= self.hides[k]
                    self.hides[k] = False
                    self.open[k] = "span" if tag != "span" else "font"
                    return None
                return self._close_at(k)
            if self.open[k] in SCOPES and tag not in ("table", "html", "body", "tr", "tbody", "thead", "tfoot"):
                return None
            if self.open[k] == "table" and tag in ("tr", "tbody", "thead", "tfoot"):
                return None

    def _close_at(self, k: int) -> None:
        while len(self.open) > k:
            tag, hides = self.open.pop(), self.hides.pop()
            self.visible.pop()
            if self.folded and self.folded[-1] == len(self.open):
                self.folded.pop()
            if not self.hidden:
                self._end(tag)
            self.hidden -= hides
            self.foreign -= tag in FOREIGN

    def _begin(self, tag: str, given: dict[str, str]) -> None:
        box = self.boxes[-1]
        if tag == "table":
            box.gap()
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th") and self.tables:
            columns, rows = (given.get(n, "1").strip() for n in ("colspan", "rowspan"))
            number = lambda n, most: min(most, int(n[:6])) if n.isascii() and n.isdigit() else 1
            self.tables[-1].rows[-1].append(Cell(max(1, number(columns, 1000)), number(rows, 65_534)))
            self.boxes.append(Box())
        elif tag in SPACED:
            nested = tag in ("ul", "ol") and self.lists
            box.end_line() if nested else box.gap()
            if tag in ("ul", "ol"):
                start = given.get("start", "1")
                self.lists.append([tag, int(start) if start.isascii() and start.isdigit() else 1])
                box.prefix.append(INDENT)
        elif tag == "li" and self.lists:
            box.end_line()
            kind, number = self.lists[-1]
            self.lists[-1][1] += 1
            mark = f"{number}. " if kind == "ol" else "- "
            box.prefix.append(" " * len(mark))
            box.mark = mark
        elif tag in BLOCKS:
            box.end_line()
            if tag == "dd":
                box.prefix.append(INDENT)
        elif tag == "text" and self.foreign:
            box.text(" ", False)
        elif tag == "textarea" and box.space:
            box.parts.append(" ")
            box.space = False
        self.pre += tag in KEPT

    def _end(self, tag: str) -> None:
        box = self.boxes[-1]
        self.pre -= tag in KEPT
        if tag in ("td", "th") and self.tables and len(self.boxes) > 1:
            self.tables[-1].rows[-1][-1].lines = self.boxes.pop().result()
        elif tag == "table" and self.tables:
            made = self.tables.pop().lines()
            box.rows(made)
            box.gap()
        elif tag in ("ul", "ol") and self.lists:
            box.end_line()
            self.lists.pop()
            if box.prefix:
                box.prefix.pop()
            if not self.lists:
                box.gap()
        elif tag == "li" and self.lists:
            box.end_line()
            box.mark = ""
            if box.prefix:
                box.prefix.pop()
        elif tag == "dd":
            box.end_line()
            if box.prefix:
                box.prefix.pop()
        elif tag in SPACED:
            box.gap()
        elif tag in BLOCKS:
            box.end_line()
        elif tag == "text" and self.foreign:
            box.text(" ", False)

    def rendered(self, html: str) -> str:
        self.feed(html)
        if self.cdata_elem == "textarea":
            # never closed: the rest of the page is its text
            rest, self.rawdata = self.rawdata, ""
            self.handle_data(rest)
        self.close()
        self._close_at(0)
        return "\n".join(self.boxes[0].result())


def visible_text(html: str | None) -> str:
    return TreeBuilder().rendered(html) if html else ""


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of each page."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [visible_text(html) for html in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(render, "page_id long, text string")
