"""Pages whose markup used to hide their text."""

import pytest

from quarterline.llm import html

TREE = html.train_tree()
STORY = " ".join(["word"] * 50)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>one</p><svg width="1"/><p>two</p></article>', "one\ntwo"),
        ('<article><p>one <svg><path d="M0"/><text>x</text></svg> two</p></article>', "one two"),
        *[(f"<article><div><p>one</p><{tag}>x<b>y</b></div><p>two</p></article>", "one\ntwo") for tag in ("button", "object", "canvas", "select", "script", "svg")],
        *[(f"<article><div>one <{tag}>x</div><p>two</p><{tag}>y</{tag}><p>three</p></article>", "one\ntwo\nthree") for tag in ("button", "object", "canvas", "select")],
        ("<article><p>one <button>x<div>y</div><p>z</p></button> two</p></article>", "one two"),
        ('<body class="has-sidebar"><article class="post no-comments"><p>one</p></article></body>', "one"),
        ('<body class="sidebar"><main id="search"><p>one</p></main></body>', "one"),
        (f'<div class="post with-comments"><p>{STORY}</p><p>{STORY}</p></div>', f"{STORY}\n{STORY}"),
        (f'<body><div><p>{STORY}</p><p>{STORY}</p></div><article class="comment"><p>nice</p></article></body>', f"{STORY}\n{STORY}"),
        (f'<body><div><p>{STORY}</p><p>{STORY}</p></div><section id="comments"><article><p>nice</p></article></section></body>', f"{STORY}\n{STORY}"),
    ],
)
def test_pages_keep_their_text(page, text):
    assert html.main_text(page, TREE) == text
