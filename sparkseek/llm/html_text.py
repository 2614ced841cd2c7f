"""Visible text of web pages, laid out roughly as a browser would show it.

A page is cut into tags and text, a tree is built (end tags that HTML lets authors leave out are implied), and the tree is
rendered: blocks stand on their own lines, paragraphs, headings, lists and tables are set off by an empty line, list items
are indented and marked with their bullet or number, table cells are padded so that columns line up, white space collapses
except in `pre` and text areas. Scripts, styles, templates, comments, the head, frames, descriptions of drawings and
formulas, and whatever is marked hidden show nothing. Options of a list, labels of a drawing, formulas, text areas, what
stands in for media or scripts, and what only screen readers skip are shown.

Defined results: a null or empty page has an empty text; broken markup is never an error (unknown tags are inline, stray
end tags are ignored, what is left open ends with the page, behind a tag whose quotes never close tags end at the next
`>`, and a tag that never ends is text); repeated rows and extra columns pass through; a column named as the added one is
an error of the caller, who chooses its name. Pages are rendered whole; depth is bounded by memory only, as no step
recurses, and building a tree takes time in proportion to the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .arrow import with_columns

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template title datalist iframe noembed noframes desc metadata annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup legend li main nav search section"
    " summary caption thead tbody tfoot tr td th menu option optgroup text".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("html body caption thead tbody tfoot tr td th option optgroup text".split())
#: An opening tag -> open elements that it ends, and those behind which it doesn't look.
_TABLE = frozenset(["table"])
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "td": (frozenset("td th".split()), _TABLE | {"tr"}),
    "th": (frozenset("td th".split()), _TABLE | {"tr"}),
    "tr": (frozenset("tr td th caption".split()), _TABLE),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), _TABLE),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), _TABLE),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), _TABLE),
    "body": (frozenset(["head"]), frozenset()),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

#: An end tag ends nothing outside of its cell or table, but for those of parts of the table and of the page.
_CELLS = ("table", "td", "th")
_THROUGH_CELLS = frozenset("table tr tbody thead tfoot body html".split())

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []

    def hidden(self) -> bool:
        found = self.attributes
        return self.name in HIDDEN or "hidden" in found or bool(_UNSEEN.search(found.get("style", "")))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


class _Open:
    """The open elements; where each name is open is known without a search."""

    def __init__(self, root: Node):
        self.nodes, self.depths, self.blocks = [root], defaultdict(list), []

    def last(self, names) -> int:
        """The depth of the innermost open element of these names, 0 if there is none."""
        return max((self.depths[name][-1] for name in names if self.depths.get(name)), default=0)

    def push(self, node: Node) -> None:
        self.depths[node.name].append(len(self.nodes))
        if node.name in BLOCKS and node.name != "p":
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """End the element at a depth and all inside."""
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().name].pop()
            if self.blocks and self.blocks[-1] == len(self.nodes):
                self.blocks.pop()

    def end(self, name: str) -> None:
        depth = self.last((name,))
        if depth and (name in _THROUGH_CELLS or depth >= self.last(_CELLS)):
            self.close(depth)

    def start(self, name: str) -> None:
        """End what an opening tag of this name implies the end of."""
        if name in ENDS_PARAGRAPH and (depth := self.last(("p",))) and (not self.blocks or depth > self.blocks[-1]):
            self.close(depth)
        if name in IMPLIED:
            names, stop = IMPLIED[name]
            while (depth := self.last(names)) > self.last(stop):
                self.close(depth)
                if not names & IMPLIED["tr"][0]:
                    break


def build(html: str) -> Node:
    """The tree of a page."""
    root = Node("#page", {})
    open_nodes = _Open(root)
    place, quotes, last_end = 0, True, html.rfind(">")
    start = 0  # of the text that isn't in the tree yet

    def add_text(end: int) -> None:
        if end > start:
            open_nodes.nodes[-1].children.append(unescape(html[start:end]))

    while found := _OPENS.search(html, place):
        here, place, name = found.start(), found.end(), (found[2] or "").lower()
        if not name:
            mark = "-->" if found[0] == "<!--" else ">"
            end = html.find(mark, place)
            add_text(here)
            start = place = end + len(mark) if end >= 0 else len(html)
            continue
        if place > last_end:
            break  # no tag ends behind here
        rest = _QUOTED.match(html, place) if quotes else None
        quotes = rest is not None
        end = rest.end() if rest else html.index(">", place) + 1
        inside = html[place : end - 1]
        add_text(here)
        start = place = end
        if found[1]:
            open_nodes.end(name)
            continue
        open_nodes.start(name)
        node = Node(name, _attributes(inside))
        open_nodes.nodes[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(html, place)
            raw = html[place : close.start() if close else len(html)]
            node.children.append(unescape(raw) if name in ("title", "textarea") else raw)
            start = place = (html.find(">", close.end() - 1) + 1 if close else 0) or len(html)
        elif name not in VOID and not inside.endswith("/"):
            open_nodes.push(node)
    add_text(len(html))
    return root


class _Lines:
    """Text in the making: collapsed white space, blocks, empty lines between."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.prefix, self.mark = "", False, "", ""

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self.line += first
            for line in rest:
                self.end(force=True)
                self.line = line
            return
        text = _SPACE.sub(" ", text)
        self.line += text[1:] if text[:1] == " " and (not self.line or self.line[-1] == " ") else text

    def end(self, force: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if not line and not force:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.prefix[: len(self.prefix) - len(self.mark)] + self.mark + line if self.mark else self.prefix + line).rstrip())
        self.mark = ""


class _Stack(list):
    """Frames of [node, next child, lines, whether white space stays, indent, kind-specific state], and those of them that
    are lists or tables."""

    def __init__(self):
        super().__init__()
        self.lists: list[list] = []
        self.tables: list[list] = []

    def append(self, frame: list) -> None:
        super().append(frame)
        name = frame[0].name
        if name in ("ul", "ol", "menu"):
            self.lists.append(frame)
        elif name == "table":
            self.tables.append(frame)


def render(root: Node) -> str:
    """The visible text below a node."""
    stack = _Stack()
    out = _Lines()
    stack.append([root, 0, out, False])
    while stack:
        frame = stack[-1]
        node, child, lines, keep = frame[:4]
        if child < len(node.children):
            frame[1] += 1
            one = node.children[child]
            if isinstance(one, str):
                if not (node.name in ("table", "thead", "tbody", "tfoot", "tr", "ul", "ol", "dl") and not one.strip()):
                    lines.text(one, keep)
            elif one.name == "br":
                lines.end(force=True)
            elif one.name == "img":
                lines.text(one.attributes.get("alt", ""), False)
            elif not one.hidden():
                _enter(stack, one, lines, keep)
        else:
            stack.pop()
            for frames in (stack.lists, stack.tables):
                if frames and frames[-1] is frame:
                    frames.pop()
            _leave(stack, frame)
    out.end()
    return "\n".join(out.lines)


def _enter(stack: _Stack, node: Node, lines: _Lines, keep: bool) -> None:
    name, indent = node.name, 0
    if name in BLOCKS:
        lines.end()
        nested = name in ("ul", "ol") and bool(stack.lists)
        if name in SPACED and not nested:
            lines.gap = True
    if name == "optgroup":
        lines.text(node.attributes.get("label", ""), False)
        lines.end()
    elif name == "hr":
        lines.text("---", True)
        lines.end()
    elif name == "li":
        lists = stack.lists[-1] if stack.lists else None
        number = ""
        if lists is not None and lists[0].name == "ol":
            start = lists[0].attributes.get("start", "1")
            value = node.attributes.get("value", "")
            lists[5] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else lists[5] + 1 if lists[5] is not None else int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            number = f"{lists[5]}. "
        mark = number or "- "
        indent = len(mark)
        lines.prefix += " " * indent
        lines.mark = mark
    elif name in ("dd", "blockquote"):
        indent = 4
        lines.prefix += " " * indent
    elif name in ("td", "th"):
        stack.append([node, 0, _Lines(), False, indent, None])
        return
    elif name == "table":
        stack.append([node, 0, lines, False, indent, []])  # rows of cells
        return
    elif name == "tr":
        table = stack.tables[-1] if stack.tables else None
        if table is not None:
            table[5].append([])
    stack.append([node, 0, lines, keep or name in ("pre", "textarea"), indent, None])


def _leave(stack: _Stack, frame: list) -> None:
    node, _, lines = frame[:3]
    if not stack:
        return
    if node.name in ("td", "th"):
        lines.end()
        table = stack.tables[-1] if stack.tables else None
        cell = [line for line in lines.lines if line]
        span = node.attributes.get("colspan", "1")
        span = int(span) if re.fullmatch(r"[1-9]\d{0,2}", span) else 1
        if table is None:
            for line in cell:
                stack[-1][2].text(line, True)
                stack[-1][2].end()
        else:
            if not table[5]:
                table[5].append([])
            table[5][-1] += [cell] + [[]] * (span - 1)
        return
    if node.name == "table":
        lines.end()
        _table(frame[5], lines)
    if node.name in BLOCKS:
        lines.end()
        nested = node.name in ("ul", "ol") and bool(stack.lists)
        if node.name in SPACED and not nested:
            lines.gap = True
    if frame[4]:
        lines.prefix = lines.prefix[: len(lines.prefix) - frame[4]]
        lines.mark = ""


def _table(rows: list[list[list[str]]], lines: _Lines) -> None:
    rows = [row for row in rows if any(row)]
    columns = max(map(len, rows), default=0)
    widths = [max((len(line) for row in rows if len(row) > c for line in row[c]), default=0) for c in range(columns)]
    for row in rows:
        for k in range(max(map(len, row))):
            cells = [cell[k] if k < len(cell) else "" for cell in row]
            lines.line = " | ".join(cell.ljust(width) for cell, width in zip(cells, widths, strict=False)).rstrip()
            lines.end()


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The frame with the visible text of each page."""
    ship(pages.sparkSession)
    shown = lambda column: [pa.array([render(build(one)) if one else "" for one in column], pa.string())]
    return with_columns(pages, html, f"`{text}` string", lambda: shown)
