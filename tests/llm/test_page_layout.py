"""Layout of pages against an independent recursion over random trees, text that browsers show, and broken or huge pages."""

import random
import time

import pytest

from leafmill.llm.page_text import page_text

MARKUP = ("<table><tr>stray text<td>cell</td></tr></table><svg><defs><text>not here</text></defs><rect/><g><text>label</text></g></svg>"
          "<select><option>one<option selected>two</select>")


def test_all_visible_text():
    assert page_text(MARKUP).split("\n") == ["stray text", "cell", "", "label", "one", "two"]


@pytest.mark.parametrize(
    "page, lines",
    [("<table><tr><p>before<td>a<td>b</table>", ["before", "a  b"]),
     ("<table><caption>c</caption>loose<tr><td>a</table>", ["loose", "c", "a"]),
     ("<svg><g style='display:none'><text>x</text></g><text><tspan>a</tspan>b</text>not drawn<text>c</text></svg>", ["ab", "c"]),
     ("<svg><circle r=1 /><foreignObject><p>in html</p></foreignObject></svg>after", ["in html", "", "after"]),
     ("<select>x<optgroup label=g><option>a<option hidden>b<optgroup><option>c</select>", ["a", "c"]),
     ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", ["a  b", "   c"]),
     ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>c</table>", ["wide one  x", "a  b  c"]),
     ("<div><td>no table<td>here</div>", ["no table", "here"])],
)
def test_parts_of_pages(page, lines):
    assert page_text(page).split("\n") == lines


def block(draw, depth):
    """(markup, lines) of a random paragraph, list or table; tags that may be left out often are."""
    kind = draw.choice(["p", "ul", "ol", "table"] if depth < 3 else ["p"])
    words = lambda: " ".join(draw.choice(["ant", "bee", "cow", "dormouse"]) for _ in range(draw.randrange(1, 4)))
    maybe = lambda tag: draw.choice(["", f"</{tag}>"])
    if kind == "p":
        text = words()
        return f"<p>{text.replace(' ', draw.choice([' ', chr(10), ' <b></b>']))}{maybe('p')}", [text]
    if kind == "table":
        rows = [[words() for _ in range(draw.randrange(1, 4))] for _ in range(draw.randrange(1, 4))]
        widths = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(3)]
        markup = "".join("<tr>" + "".join(f"<td>{c}{maybe('td')}" for c in r) + maybe("tr") for r in rows)
        return f"<table>{markup}</table>", ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows]
    markup, lines, first = "", [], draw.choice([1, 7])
    for i in range(draw.randrange(1, 4)):
        text, mark = words(), "- " if kind == "ul" else f"{first + i}. "
        below, inner = "", []
        if depth < 2 and draw.random() < 0.4:
            below, inner = block_list(draw, depth + 1)
        markup += f"<li>{text}{below}{maybe('li')}"
        lines += [mark + text, *(" " * len(mark) + x for x in inner)]
    return (f"<ul>{markup}</ul>" if kind == "ul" else f"<ol start={first}>{markup}</ol>"), lines


def block_list(draw, depth):
    while True:
        markup, lines = block(draw, depth)
        if markup.startswith(("<ul", "<ol")):
            return markup, lines


def test_layout_equals_a_recursion():
    draw = random.Random(5)
    for _ in range(400):
        blocks = [block(draw, 0) for _ in range(draw.randrange(1, 6))]
        want = "\n\n".join("\n".join(lines) for _, lines in blocks)
        assert page_text("".join(m for m, _ in blocks)) == want


@pytest.mark.parametrize(
    "page, text",
    [("<div></x>" * 100_000 + "end", "end"), ("<div>" * 50_000 + "</td></p></li>" * 50_000 + "end", "end"),
     ("<table><tr>" + "<td>a" * 40_000 + "</table>", "  ".join(["a"] * 40_000)), ("<b>a</b> " * 100_000, " ".join(["a"] * 100_000)),
     ("<p><table><tr><td>" + "<div>" * 50_000 + "end", "end"), ("<table>" + "<tr><td>a" * 40_000, "\n".join(["a"] * 40_000))],
    ids=["strays", "deep", "cells", "inline", "fenced", "rows"],
)
def test_time_is_linear(page, text):
    start = time.process_time()
    assert page_text(page) == text
    assert time.process_time() - start < 15
