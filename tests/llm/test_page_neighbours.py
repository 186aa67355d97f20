"""The tree's use of neighbouring blocks, pages without main markup, and the scan's running time."""

import re
import time

import numpy as np
import pytest

from quarterline.llm import html
from quarterline.llm.shared import read_table

TREE = html.train_tree()


def used(tree) -> set:
    return {tree[0]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()


def test_the_tree_asks_neighbours_where_markup_is_silent():
    assert {0, 1} & used(TREE) and {4, 5} & used(TREE) and {2, 3, 6, 7} <= used(TREE)
    grid = [(a, b) for a in (0, 1, 4, 9, 25, 60, 400) for b in (0, 0.3, 1)]
    for marks, main in (((1, 0, 1), False), ((0, 1, 1), True), ((0, 0, 1), False), ((1, 0, 0), False), ((1, 1, 1), False)):
        rows = np.array([(*p, *o, *q, *marks) for p in grid for o in grid[3:] for q in grid], dtype=float)
        assert ((html.classify(TREE, rows) >= 0.5) == main).all()


def bare(page: str) -> str:
    for tag in ("nav", "article", "footer"):
        page = re.sub(rf"<(/?){tag}(?=[\s>])", r"<\1div", page)
    return page.replace(' class="ad"', "")


def test_pages_without_any_markup(spark):
    """The markup of the synthetic pages says what is right; without it the tree has only words, links and neighbours."""
    right, all_blocks, main, kept = 0, 0, 0, 0
    for row in read_table(spark, "/root/testdata/sf0.01", "pages").collect():
        marked = [b[4] and not b[3] for b in html.blocks(row.html or "")]
        got = html.classify(TREE, html.features(html.blocks(bare(row.html or "")))) >= 0.5
        right += sum(a == b for a, b in zip(marked, got))
        all_blocks += len(marked)
        main += sum(marked)
        kept += sum(a and b for a, b in zip(marked, got))
    assert right >= 0.97 * all_blocks and kept >= 0.99 * main


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold</p></article>", "Let x=2 hold"),
        ('<article class="post no-sidebar"><p>one</p></article>', "one"),
        ('<body class="has-sidebar"><article><p>one</p></article></body>', "one"),
        ("<article><p>a <a x=\"1>b</p><p>c</p></article>", "a b\nc"),
        ("<article><p title='>'>a</p><p title = \">\">b</p></article>", "a\nb"),
    ],
)
def test_odd_markup(page, text):
    assert html.main_text(page, TREE) == text


def test_headings_and_lists_without_main_markup():
    words = lambda n: " ".join(["word"] * n)
    blocks = [f"<h1>{words(6)}</h1>", f"<p>{words(48)}</p>", f"<h2>{words(3)}</h2>", f"<ul><li>{words(4)}<li>{words(5)}<li>{words(3)}</ul>", f"<p>{words(64)}</p>"]
    menu = "<div>" + "".join(f'<div><a href="/{k}">{words(1)}</a></div>' for k in range(4)) + "</div>"
    page = f"<body>{menu}<div><p>{words(7)}</p>{''.join(blocks)}</div><div><a>{words(4)}</a></div><div><a>{words(6)}</a></div><div>{words(9)}</div></body>"
    got = html.main_text(page, TREE).split("\n")
    assert [len(x.split()) for x in got][-6:] == [48, 3, 4, 5, 3, 64]


@pytest.mark.parametrize("piece", ['<a "', '<a x="', "<div><script></div>", "<b></i>", "<p>", '<a x="a>', "<!--", "<!", "<![CDATA[", "<button>", "<a href='>"])
def test_the_scan_is_linear(piece):
    seconds = []
    for size in (40_000, 320_000):
        page = "<article>" + piece * (size // len(piece))
        start = time.perf_counter()
        html.main_text(page, TREE)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 24 * seconds[0] + 0.3
