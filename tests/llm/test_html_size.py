"""Pages made to blow up render in time and size near their own, and layout stays as it was."""

import random
import time

import pytest

from quarry.llm.htmltext import render

SHAPES = {
    "spans both ways": lambda n: "<table>" + "<tr><td rowspan=999 colspan=999>x" * n,
    "staggered rows": lambda n: "<table>" + "<tr><td rowspan=999>x" * n,
    "many cells in a row": lambda n: "<table><tr>" + "<td rowspan=9>x" * n + "<tr><td>y" * 20,
    "spans before terms": lambda n: "<span>" * (4 * n) + "<dt>a" * n,
    "divs before items": lambda n: "<div>" * n + "<li>a" * n + "<tr><td>b" * n,
    "nested lists": lambda n: "<ul><li>x" * n,
    "nested numbers": lambda n: "<ol start=999999999><li>" * n + "x",
    "nested quotations": lambda n: "<blockquote>x" * n,
    "quotations in items": lambda n: "<ul><li><blockquote>x" * n,
    "end tags without a start": lambda n: "<b>" * n + "</i></td></p>" * n,
    "paragraphs behind borders": lambda n: "<p><table><td>" * 30 + "<div>x" * n,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_time_and_size_stay_near_the_page(shape):
    page = SHAPES[shape](3000)
    began = time.process_time()
    text = render(page)
    assert time.process_time() - began < 10
    # A line of a deep list has a margin of 64 signs.
    assert len(text) <= 4 * len(page) + 70 * text.count("\n") + 10_000


def aligned(rows):
    """Plain layout of a table given as rows of (text, columns, rows)."""
    taken, placed = set(), []
    for r, row in enumerate(rows):
        at, line = 0, []
        for text, span, down in row:
            while (r, at) in taken:
                at += 1
            line.append((at, text, span))
            taken |= {(r + d, at + k) for d in range(1, down) for k in range(span)}
            at += span
        placed.append(line)
    owned = sorted({at for line in placed for at, _, _ in line})
    width = {k: max([len(t) for line in placed for at, t, span in line if at == k and span == 1], default=0) + 2 for k in owned}
    out = []
    for line in placed:
        s = ""
        for at, text, span in line:
            s = s.ljust(sum(w for k, w in width.items() if k < at)) + text
            end = sum(w for k, w in width.items() if k < at + span)
            s += "  " if len(s) > end - 2 else ""
        out.append(s.rstrip())
    return [x for x in out if x]


@pytest.mark.parametrize("seed", range(20))
def test_spanning_tables_against_a_plain_layout(seed):
    rng = random.Random(seed)
    rows = [[("x" * rng.randint(0, 6), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
    page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{t}</td>" for t, c, d in row) for row in rows) + "</table>"
    assert render(page).split("\n") == (aligned(rows) or [""])


def listed(items, ordered, depth=0):
    """Plain layout of nested lists: an item is a text, or a text and a list below it."""
    out = []
    for k, item in enumerate(items, 1):
        mark = f"{k}. " if ordered else "- "
        text, below = item if isinstance(item, tuple) else (item, None)
        inner = ([text] if text else []) + (listed(*below) if below else [])
        out += [(mark if not j else " " * len(mark)) + line for j, line in enumerate(inner)]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_nested_lists_against_a_plain_layout(seed):
    rng = random.Random(seed)

    def some(depth):
        return [(rng.choice(["a", "b c", ""]), (some(depth - 1), rng.random() < 0.5)) if depth and rng.random() < 0.5 else rng.choice(["d", "e", ""]) for _ in range(rng.randint(1, 4))]

    def source(items, ordered):
        each = (i if isinstance(i, tuple) else (i, None) for i in items)
        tag = "ol" if ordered else "ul"
        return f"<{tag}>" + "".join(f"<li>{t}{source(*b) if b else ''}" + rng.choice(["", "</li>"]) for t, b in each) + f"</{tag}>"

    items = some(4)
    assert [x for x in render(source(items, False)).split("\n") if x] == listed(items, False)


def test_containers_keep_blank_lines_apart():
    assert render("<dl><dt>t<dd><p>a</p><p>b</p><dt>u</dl>") == "t\n  a\n\n  b\nu"
    assert render("a<blockquote><p>b</p><p>c</p></blockquote>d") == "a\n\n  b\n\n  c\n\nd"
    assert render("<ul><li><p>a</p><p>b</p><li><blockquote>c</blockquote>d</ul>e") == "- a\n  b\n-   c\n  d\n\ne"
    assert render("<p>a<ul><li></li><li><ul><li>b</ul></ul>c") == "a\n\n- - b\n\nc"
    assert render("<ol><li><pre>x\n\n  y</pre></ol>") == "1. x\n     y"
