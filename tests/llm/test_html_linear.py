"""HTML text of pages built to blow up, and of random trees against a plain recursive renderer."""

from __future__ import annotations

import random
import time

import pytest

from vellum.llm.html_text import page_text

HOSTILE = {
    "nested lists": lambda n: "<ul><li>x" * (n // 9),
    "empty nested lists": lambda n: "<ul><li>" * (n // 8) + "x",
    "spans": lambda n: "<table>" + "<td colspan=1000 rowspan=0>y" * (n // 60) + "<tr><td>x" * (n // 20),
    "growing spans": lambda n: "<table>" + "".join(f"<tr><td rowspan={i % 60000}>y<td>z" for i in range(n // 30)),
    "padding": lambda n: "<table><tr>" + ("<td>" + "z" * 60) * 500 + "<tr><td colspan=499>a<td>b" * ((n - 32_000) // 25),
    "nested tables": lambda n: "<table><tr><td>x" * (n // 16),
    "tables in lists": lambda n: "<ul><li>a<table><tr><td>x<td>y" * (n // 30),
    "definitions": lambda n: "<dl><dd>x" * (n // 9),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_stays_in_proportion(name):
    page = HOSTILE[name](1_000_000)
    began = time.time()
    text = page_text(page)
    assert time.time() - began < 40 and len(text) < 12 * len(page)
    for mark in "xyz":
        assert text.count(mark) == page.count(mark)  # every letter of the text is there


def _lines(tree, mark=""):
    """Lines of a tree of lists: (text, items) or text, items marked and indented."""
    out = []
    for node in tree:
        if isinstance(node, str):
            out.append(node)
        else:
            kind, start, items = node
            for i, item in enumerate(items):
                head = f"{start + i}. " if kind == "ol" else "- "
                inner = _lines(item)
                out += [(head if k == 0 else " " * len(head)) + x for k, x in enumerate(inner)]
    return out


def _html(tree):
    out = ""
    for node in tree:
        if isinstance(node, str):
            out += f"<div>{node}</div>"
        else:
            kind, start, items = node
            out += f"<{kind} start={start}>" + "".join(f"<li>{_html(i)}" for i in items) + f"</{kind}>"
    return out


def _tree(rng, depth):
    nodes = [rng.choice(["one", "two words", "three"]) for _ in range(rng.randint(0, 2))]
    if depth and rng.random() < 0.8:
        nodes.append((rng.choice(["ul", "ol"]), rng.randint(-2, 12), [_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]))
    return nodes


@pytest.mark.parametrize("seed", range(6))
def test_random_lists_equal_a_recursive_renderer(seed):
    rng = random.Random(seed)
    for _ in range(150):
        tree = _tree(rng, 4)
        got = [x for x in page_text(_html(tree)).split("\n") if x]
        assert got == _lines(tree), _html(tree)


def _grid(rows):
    """Aligned lines of single-line cells without spans."""
    width = [max(len(r[c]) for r in rows if c < len(r)) for c in range(max(map(len, rows)))]
    return ["".join(x.ljust(width[c] + 2) for c, x in enumerate(r)).rstrip() for r in rows]


def test_random_tables_equal_padded_rows():
    rng = random.Random(1)
    for _ in range(200):
        rows = [["c" * rng.randint(1, 20) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>"
        assert page_text(page).split("\n") == _grid(rows)


def test_rowspans_push_cells_aside():
    rng = random.Random(2)
    for _ in range(200):
        taken, rows, want = set(), [], []
        for r in range(5):
            cells, at = [], 0
            for _ in range(rng.randint(1, 4)):
                while (r, at) in taken:
                    at += 1
                down, across = rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])
                cells.append(f"<td rowspan={down} colspan={across}>{r}")
                want.append((r, at))
                taken |= {(r + i, at + j) for i in range(down) for j in range(across)}
                at += across
            rows.append("<tr>" + "".join(cells))
        lines = page_text("<table>" + "".join(rows) + "</table>").split("\n")
        assert [x.split().count(str(r)) for r, x in enumerate(lines)] == [sum(1 for q, _ in want if q == r) for r in range(5)]


def test_visible_text_of_drawings_formulas_and_choices():
    assert page_text("a<svg><title>no</title><text>drawn</text><desc>no</desc></svg>b") == "adrawnb"
    assert page_text("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>") == "x=2"
    assert page_text("<select><option>one<option selected>two</select>") == "one\ntwo"
    assert page_text("<ol start=5><li>a<li value=9>b<li>c</ol>") == "5. a\n9. b\n10. c" and page_text("<ol start=x><li>a</ol>") == "1. a"
