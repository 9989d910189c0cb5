"""Layout-aware rendering of HTML pages to text.

A tolerant tree builder inserts the end tags that HTML implies; a renderer then walks the
visible part of the tree and lays it out: blocks on lines of their own, blank lines around
paragraphs, headings, lists and tables, list markers with indents, and table cells padded
to common column widths.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.shared import small_batches

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes audio video canvas datalist title math object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir listing".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend".split()) - {"summary"}

#: A start tag ends the nearest open element of these, up to the boundary elements.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
_SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template"})

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Tables nested deeper than this are laid out as plain blocks.
TABLE_DEPTH = 8


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def build(page: str) -> Node:
    """The tree of a page; never fails, whatever the markup."""
    root = Node("#root", {})
    stack = [root]
    at = 0

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(entities.unescape(page[at:upto]))

    while True:
        match = _MARKUP.search(page, at)
        if match is None:
            text(len(page))
            return root
        text(match.start())
        at = match.end()
        tag = match[2] or match[5]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1] or match[4]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        source = match[3] if match[2] else match[6]
        node = Node(tag, attributes(source))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            node.children.append(entities.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(node)


def _imply(stack: list[Node], tag: str) -> None:
    """Close what the start of ``tag`` ends."""
    if tag == "body" or (tag in BLOCK and tag not in ("html",)):
        if len(stack) > 1 and stack[-1].tag == "head":
            stack.pop()
    if tag in CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in _SCOPE:
                break
    if tag in IMPLIED_END:
        ends, bounds = IMPLIED_END[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
                break
            if stack[i].tag in bounds:
                break


def _close(stack: list[Node], tag: str) -> None:
    """The end tag of an element that is not open does nothing."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
            return


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "input" or (node.tag == "dialog" and "open" not in node.attrs):
        return False
    return not ("style" in node.attrs and _UNSEEN.search(node.attrs["style"]))


class _Layout:
    """Collects words and line breaks; blank lines never pile up."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = 0
        self.gap = False
        self.started = False
        self.indent = ""
        self.marker = ""

    def block(self, lines: int) -> None:
        if self.started:
            self.breaks = max(self.breaks, lines)
        self.gap = False

    def _flush(self) -> None:
        if self.breaks or not self.started:
            self.parts.append("\n" * self.breaks + self.indent)
            self.breaks = 0
            if self.marker:
                self.parts.append(self.marker)
                self.marker = ""
        elif self.gap:
            self.parts.append(" ")
        self.gap, self.started = False, True

    def words(self, text: str) -> None:
        squeezed = _SPACE.sub(" ", text)
        if squeezed == " ":
            self.gap = True
            return
        if squeezed[0] == " ":
            self.gap = True
            squeezed = squeezed[1:]
        ends = squeezed[-1] == " "
        self._flush()
        self.parts.append(squeezed[:-1] if ends else squeezed)
        self.gap = ends

    def verbatim(self, text: str) -> None:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if text:
            self._flush()
            self.parts.append(text.replace("\n", "\n" + self.indent))

    def line_break(self) -> None:
        if self.started:
            self.breaks += 1
        self.gap = False

    def text(self) -> str:
        return "\n".join(line.rstrip(" ") for line in "".join(self.parts).split("\n"))


def render(node: Node, depth: int = 0) -> str:
    """The visible text below ``node``, laid out."""
    out = _Layout()
    stack: list[tuple] = [("open", node, None)]
    lists: list[list] = []
    pre = 0
    while stack:
        step, what, state = stack.pop()
        if step == "close":
            if what.tag in ("pre", "textarea", "listing"):
                pre -= 1
            if what.tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if what.tag in ("li", "dd", "blockquote"):
                if what.tag == "li" and out.marker and not state[1]:
                    out.marker = ""
                out.indent = state[0]
            if what.tag in BLOCK:
                out.block(2 if what.tag in SPACED and not (lists and what.tag in ("ul", "ol", "menu", "dir")) else 1)
            continue
        if isinstance(what, str):
            if not what:
                continue
            (out.verbatim if pre else out.words)(what)
            continue
        tag = what.tag
        if tag == "br":
            out.line_break()
            continue
        if not visible(what):
            continue
        if tag in BLOCK:
            out.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")) else 1)
        if tag == "table" and depth < TABLE_DEPTH:
            grid = table_text(what, depth + 1)
            if grid:
                out.verbatim(grid)
            out.block(2)
            continue
        before = out.indent
        children = what.children
        if tag in ("ul", "ol", "menu", "dir"):
            start = what.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            level = max(len(lists) - 1, 0)
            base = "  " * level
            if lists and lists[-1][0]:
                out.marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                out.marker = "- "
            out.indent = base
        elif tag in ("dd", "blockquote"):
            out.indent = before + "  "
        elif tag in ("pre", "textarea", "listing"):
            pre += 1
        elif tag == "details" and "open" not in what.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        stack.append(("close", what, (before, False)))
        if tag in ("td", "th"):
            out.gap = True
        stack.extend(("open", c, None) for c in reversed(children))
    return out.text()


def table_text(table: Node, depth: int) -> str:
    """A table with its cells padded to common widths, two spaces between columns."""
    rows: list[list[tuple[str, int]]] = []
    captions: list[str] = []
    stray: list = []
    todo: list = list(reversed(table.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if not child.isspace():
                stray.append(child)
            continue
        if child.tag in ("tbody", "thead", "tfoot"):
            if visible(child):
                todo.extend(reversed(child.children))
        elif child.tag == "caption":
            if visible(child):
                captions.append(render(_plain(child), depth))
        elif child.tag == "tr":
            if visible(child):
                row, loose = [], []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        if visible(cell):
                            span = cell.attrs.get("colspan", "1")
                            row.append((_one_line(render(_plain(cell), depth)), max(1, min(int(span), 1000)) if re.fullmatch(r"\d{1,9}", span) else 1))
                    elif not (isinstance(cell, str) and cell.isspace()):
                        loose.append(cell)
                if loose:
                    stray.extend(loose)
                if row:
                    rows.append(row)
        elif child.tag in ("td", "th"):
            if visible(child):
                rows.append([(_one_line(render(_plain(child), depth)), 1)])
        elif child.tag not in ("colgroup", "col"):
            stray.append(child)
    widths: list[int] = []
    for row in rows:
        at = 0
        for text, span in row:
            while len(widths) < at + span:
                widths.append(0)
            if span == 1:
                widths[at] = max(widths[at], len(text))
            at += span
    lines = []
    for row in rows:
        at, cells = 0, []
        for text, span in row:
            cells.append(text.ljust(sum(widths[at : at + span]) + 2 * (span - 1)))
            at += span
        lines.append("  ".join(cells).rstrip())
    head = []
    if stray:  # content that stands in a table outside any cell is shown before it
        holder = Node("#cell", {})
        holder.children = stray
        head.append(render(holder, depth))
    return "\n".join(x for x in [*head, *captions, *lines] if x)


def _plain(cell: Node) -> Node:
    """The content of a cell, without the cell's own block."""
    inner = Node("#cell", {})
    inner.children = cell.children
    return inner


def _one_line(text: str) -> str:
    return " ".join(text.split())


def title_of(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _one_line("".join(c for c in node.children if isinstance(c, str)))
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag != "svg")
    return None


def extract(page: str) -> tuple[str | None, str]:
    root = build(page)
    return title_of(root), render(root)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_chars and n_lines of every row of ``pages``.

    A null or empty html gives an empty text and no title; repeated rows give a row each;
    an empty table gives none. Other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def render_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "title": [t for t, _ in found], "text": [x for _, x in found]})

    return (
        pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
        .mapInPandas(render_all, "page_id long, title string, text string")
        .select("*", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    )
