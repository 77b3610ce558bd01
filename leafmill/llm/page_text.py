"""Visible text of HTML pages, laid out: blocks, lists and tables keep their form.

A scanner cuts a page into tags and text; a tree builder opens and closes elements, with the tags that may be left
out (a block ends an open paragraph, an item the item before, a row the row before, and so on);
a writer walks the tree without recursion, leaves out what is not visible, collapses white
space outside ``pre``, sets blocks apart, marks list items, and pads the cells of a table so that
columns stand below each other.

Visible is what a browser with scripts shows in its window: not the head, scripts, styles, templates, ``noscript``; not what
``hidden``, ``display: none`` or ``visibility: hidden`` take away; of a closed ``details`` its summary; of a drawing
its ``text`` elements, each on a line; of a ``select`` its options, each on a line, as in the rendered text of the HTML standard.
What stands in a table but in no cell comes before the table.

The time is linear in the page: open elements are found by name, lines and rows are joined once.  Only cells that reach over
many rows cost a step for each row below them.

Defined results: null and empty pages give the empty text; text without tags is one paragraph; an unclosed tag,
comment or quote ends with the page or at the next ``>``.  Tables nested more than 20 deep are written as plain
blocks, lists and quotes nested more than 20 deep without further indent; their text stays.  Repeated rows stay; columns other than the id and the page are not
looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, rows_of, table, text_steps

# Element names of the HTML standard by their part in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset hr".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside nav header footer main address form li dt dd tr td th thead tbody tfoot caption "
    "details summary dialog figcaption legend hgroup search center option".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("html body tr td th thead tbody tfoot caption option legend".split())
#: An opening tag closes these, up to the nearest of the fences.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, set()), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "body": ({"head"}, set()),
}
#: An opening tag inside a table closes everything up to the nearest of these.
_SECTIONS = ("thead", "tbody", "tfoot")
PARENTS = {
    **dict.fromkeys(("td", "th"), ("tr", *_SECTIONS, "table")), "tr": (*_SECTIONS, "table"),
    **dict.fromkeys((*_SECTIONS, "caption"), ("table",)),
}
#: Parts of a drawing that are not painted where they stand.
UNPAINTED = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
#: An end tag does not reach over these.
FENCES = frozenset("table td th caption button".split())
IN_HEAD = frozenset("head title meta link style script base noscript template html".split())

_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
MAX_TABLES = 20
MAX_INDENTS = 20


class Element:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def get(self, name: str) -> str | None:
        """The value of an attribute, the empty text for one without value."""
        if self.attributes:
            for key, *values in _ATTRIBUTE.findall(self.attributes):
                if key.lower() == name:
                    return unescape(next(filter(None, values), ""))
        return None

    def number(self, name: str, other: int) -> int:
        found = re.match(r"\s*([+-]?\d{1,9})", self.get(name) or "")
        return int(found[1]) if found else other


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is text, open or close."""
    at, end, quotes = 0, len(page), True
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            yield "text", "", page[at:start]
        if start == end:
            return
        tag = _TAG.match(page, start)
        if tag is None:
            closing = ("-->" if page.startswith("<!--", start) else ">") if page[start + 1 : start + 2] in ("!", "?", "/") else None
            if closing is None:
                yield "text", "", "<"
                at = start + 1
            else:
                found = page.find(closing, start + 2)
                at = end if found < 0 else found + len(closing)
            continue
        rest = _REST.match(page, tag.end()) if quotes else None
        quotes = quotes and rest is not None  # after a quote that never ends, tags end at the next sign
        stop = rest.end() if rest else page.find(">", tag.end()) + 1 or end
        name = tag[1].lower()
        yield "close" if page[start + 1] == "/" else "open", name, page[tag.end() : stop].rstrip(">")
        at = stop
        if name in RAW and page[start + 1] != "/":
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : close.start() if close else end]
            yield "text", "", inner
            at = close.start() if close else end


def tree(page: str) -> Element:
    root = Element("html")
    body, stack = Element("body"), [root]
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements by name

    def push(element: Element) -> None:
        where[element.name].append(len(stack))
        stack.append(element)

    def cut(length: int) -> None:
        while len(stack) > length:
            where[stack.pop().name].pop()

    def nearest(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    def close(names, fences) -> None:
        first = nearest(names)
        if first > nearest(fences):
            while first > 1 and stack[first - 1].name in names:
                first -= 1
            cut(first)

    def begin_body() -> None:
        cut(1)
        root.children.append(body)
        push(body)

    for kind, name, rest in tokens(page):
        if kind == "text" or kind == "open" and name not in IN_HEAD:
            if len(stack) == 1 and name != "body" and (kind == "open" or rest.strip()):
                begin_body()
            elif stack[-1].name == "head" and (kind == "open" or rest.strip()):
                begin_body()
        if kind == "text":
            if len(stack) > 1:
                stack[-1].children.append(unescape(rest))
        elif kind == "open":
            if name == "html":
                continue
            if name == "body":
                if len(stack) == 1 or stack[1] is not body:
                    begin_body()
                body.attributes = body.attributes or rest
                continue
            if name in ENDS_PARAGRAPH:
                close({"p"}, FENCES)
            if name in PARENTS and where["table"]:
                cut(nearest(PARENTS[name]) + 1)
            elif name in CLOSES:
                close(*CLOSES[name])
            element = Element(name, rest)
            stack[-1].children.append(element)
            if name not in VOID and not (rest.endswith("/") and (name in ("svg", "path") or where["svg"])):
                push(element)
        elif name == "br":
            stack[-1].children.append(Element("br"))
        elif name not in ("body", "html"):
            fences = frozenset() if name in FENCES or name in ("tr", "thead", "tbody", "tfoot") else FENCES
            if nearest((name,)) > nearest(fences):
                cut(nearest((name,)))
    return root


class Writer:
    """Lines with indents; blank lines between spaced blocks, never at the start."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the open line, none empty
        self.gap, self.indents, self.mark = False, [], ""

    def say(self, text: str, kept: bool) -> None:
        if kept:
            first, *more = text.split("\n")
            self.parts += [first] if first else []
            for part in more:
                self.end(False, True)
                self.parts = [part] if part else []
            return
        text = _SPACE.sub(" ", text)
        if not self.parts or self.parts[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def end(self, spaced: bool, empty: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        if line or empty:
            if self.gap and self.lines:
                self.lines.append("")
            indent = "".join(self.indents[:MAX_INDENTS])
            if self.mark:
                indent = indent[: len(indent) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((indent + line).rstrip(" "))
            self.gap = False
        self.parts = []
        self.gap = self.gap or bool(spaced)

    def text(self) -> str:
        self.end(False)
        return "\n".join(self.lines).replace("\xa0", " ").rstrip()


def unseen(element: Element) -> bool:
    if element.name in UNSEEN or element.name == "input":
        return True
    if not element.attributes:
        return False
    style = (element.get("style") or "").lower().replace(" ", "")
    return (
        element.get("hidden") is not None or "display:none" in style or (element.name == "dialog" and element.get("open") is None)
    )


def see(element: Element, shown: bool) -> bool:
    """Whether text directly in an element is visible, given its parent's state."""
    style = (element.get("style") or "").lower().replace(" ", "") if element.attributes else ""
    if "visibility:hidden" in style or "visibility:collapse" in style:
        return False
    return True if "visibility:visible" in style else shown


def render(root: Element, depth: int = 0, shown: bool = True) -> str:
    """The laid-out text of an element's children."""
    writer = Writer()
    # (element, entering, text is visible, white space is kept, list counter)
    stack: list[tuple] = [(child, True, shown, False, None) for child in reversed(root.children)]
    while stack:
        node, entering, shown, kept, counter = stack.pop()
        if isinstance(node, str):
            if shown:
                writer.say(node, kept)
            continue
        name = node.name
        # a list inside an item stands close to it
        spaced = name in SPACED and not (name in ("ul", "ol", "menu") and writer.indents)
        if not entering:
            writer.end(spaced)
            if name in ("li", "dd", "blockquote"):
                writer.indents.pop()
                writer.mark = ""
            continue
        if unseen(node):
            continue
        shown = see(node, shown)
        if name == "br":
            writer.end(False, bool(writer.parts) or bool(writer.lines) and not writer.gap)
            continue
        if name == "hr":
            writer.end(True)
            continue
        if name == "table" and depth < MAX_TABLES:
            writer.end(True)
            for line in grid(node, depth + 1, shown):
                writer.parts = [line] if line else []
                writer.end(False, True)
            writer.end(True)
            continue
        if name in BLOCKS:
            writer.end(spaced)
            stack.append((node, False, shown, kept, None))
        if name == "li":
            mark = "- "
            if counter is not None:
                counter[0] = node.number("value", counter[0] + counter[1])
                mark = f"{counter[0]}. "
            writer.indents.append(" " * len(mark))
            writer.mark = mark
        elif name in ("dd", "blockquote"):
            writer.indents.append("    ")
        numbers = None
        if name == "ol":
            step = -1 if node.get("reversed") is not None else 1
            items = sum(isinstance(c, Element) and c.name == "li" for c in node.children)
            numbers = [node.number("start", items if step < 0 else 1) - step, step]
        children = node.children
        if name == "svg":
            stack.extend((c, True, visible, kept, None) for c, visible in reversed(painted(node, shown)))
            continue
        if name == "select":
            children = [c for c, _ in inside(node, {"option"}, frozenset(), shown)]
        if name == "details" and node.get("open") is None:
            children = [c for c in children if isinstance(c, Element) and c.name == "summary"][:1]
        if name == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\n"), *children[1:]]
        keep = kept or name in ("pre", "textarea")
        passed = numbers if name in ("ol", "ul", "menu") else counter if name not in BLOCKS else None
        stack.extend((c, True, shown, keep, passed) for c in reversed(children))
    return writer.text()


def inside(node: Element, names, without, shown: bool) -> list[tuple[Element, bool]]:
    """The nearest elements of these names below a node, with the visibility of their parents."""
    found, stack = [], [(child, shown) for child in reversed(node.children)]
    while stack:
        child, visible = stack.pop()
        if isinstance(child, str) or child.name in without or unseen(child):
            continue
        if child.name in names:
            found.append((child, visible))
        else:
            stack.extend((c, see(child, visible)) for c in reversed(child.children))
    return found


def painted(drawing: Element, shown: bool) -> list[tuple[Element, bool]]:
    """The texts of a drawing as blocks."""
    blocks = []
    for child, visible in inside(drawing, {"text", "foreignobject"}, UNPAINTED, shown):
        block = Element("div", child.attributes)
        block.children = child.children
        blocks.append((block, visible))
    return blocks


def grid(node: Element, depth: int, shown: bool) -> list[str]:
    """The lines of a table: what stands in no cell, its captions, then rows with padded cells."""
    loose, captions, rows = [], [], []
    stack = [(child, shown) for child in reversed(node.children)]
    while stack:
        child, visible = stack.pop()
        name = child.name if isinstance(child, Element) else ""
        if name in _SECTIONS:
            if not unseen(child):
                stack.extend((c, see(child, visible)) for c in reversed(child.children))
        elif name == "tr":
            if not unseen(child):
                visible = see(child, visible)
                rows.append(([c for c in child.children if isinstance(c, Element) and c.name in ("td", "th")], visible))
                stack.extend((c, visible) for c in reversed(child.children) if isinstance(c, str) or c.name not in ("td", "th"))
        elif name in ("td", "th"):
            rows.append(([child], visible))
        elif name == "caption":
            captions.append((child, visible))
        elif name or child.strip():
            loose.append((child, visible))
    lines = []
    for part, visible in [*_together(loose), *_together(captions)]:
        lines += [x for x in render(part, depth, visible).split("\n") if x]
    placed: list[dict[int, list[str]]] = []
    held: list[tuple[int, int, int]] = []  # (first column, end, last row) that a cell from above covers
    widths: dict[int, int] = {}
    for number, (row, visible) in enumerate(rows):
        held = sorted(h for h in held if h[2] >= number) if held else held
        cells, column, at, following = {}, 0, 0, []
        for cell in row:
            if unseen(cell):
                continue
            while at < len(held) and held[at][0] <= column:
                column = max(column, held[at][1])
                at += 1
            text = render(cell, depth, see(cell, visible)).split("\n")
            span, down = min(max(1, cell.number("colspan", 1)), 1000), min(max(1, cell.number("rowspan", 1)), 65534)
            cells[column] = text
            if span == 1:
                widths[column] = max(widths.get(column, 0), *map(len, text))
            if down > 1:
                following.append((column, column + span, number + down - 1))
            column += span
        held += following
        placed.append(cells)
    before, offset = {}, 0
    for c in sorted({c for cells in placed for c in cells}):
        before[c] = offset
        offset += widths.get(c, 0) + 2
    for cells in placed:
        if not any("".join(text) for text in cells.values()):
            continue
        going = sorted(cells.items())
        for k in range(max(map(len, cells.values()))):
            going = [(c, text) for c, text in going if len(text) > k]
            parts, length = [], 0
            for c, text in going:
                # a wide cell above other columns pushes its line, not the columns
                pad = before[c] - length if length <= before[c] else 2
                parts += (" " * pad, text[k])
                length += pad + len(text[k])
            lines.append("".join(parts).rstrip())
    return lines


def _together(children: list) -> list[tuple[Element, bool]]:
    """Neighbours of the same visibility under one element."""
    out: list[tuple[Element, bool]] = []
    for child, visible in children:
        if not out or out[-1][1] != visible:
            out.append((Element("div"), visible))
        out[-1][0].children.append(child)
    return out


def page_text(page: str) -> str:
    return render(tree(page))


_TEXTS = pa.schema([("page_id", pa.int64()), ("text", pa.string())])


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches):
            yield rows_of(_TEXTS, rows.column(0).cast(pa.int64()), [page_text(t.decode()) for t in texts])

    return pages.select("page_id", F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")


@query("op3_page_text")
def op3_page_text(spark, folder):
    return page_texts(table(spark, folder, "pages"))
