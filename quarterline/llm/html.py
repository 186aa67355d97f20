"""Main text of web pages: flat text blocks classified by a decision tree over neighbouring blocks."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import map_texts, read_table

# Elements of HTML by what they do to text blocks.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul head".split())
SILENT_TAGS = ("script", "style", "noscript", "template", "textarea", "select", "button", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "title", "head")
BOILER_TAGS = frozenset("nav header footer aside form menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus dialog footer foot form gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply reader respond share sharing sidebar side "
    "signup skip social sponsor sponsored subscribe tags toolbar topbar widget alert responses feedback login search legal".split()
)
#: Silent elements whose content is no markup, and those that may close themselves.
RAW_TAGS = frozenset("script style noscript textarea iframe title".split())
FOREIGN_TAGS = frozenset(["svg"])
#: Classes of what holds the page say what else is on it; an article is boilerplate only where a class starts with one of the item words.
PAGE_TAGS = frozenset("html body main".split())
ITEM_WORDS = frozenset("ad ads advert advertisement comment comments promo promoted recommended related reply replies response responses sponsored".split())
#: Words that start a class of what an element has, not of what it is, as in has-sidebar.
STATE_WORDS = frozenset("has no with without".split())
PHRASE_TAGS = frozenset("p span b i em strong a".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())

_begin = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_stop = re.compile(r"""=\s*["']|>""")
_silent_ends = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT_TAGS}
_tokens_in = re.compile(r"\S+").findall
_hints = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_words_in = re.compile(r"[a-z]+").findall
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_implied_p = frozenset(t for t in BLOCK_TAGS if t not in ("body", "html", "head"))


def _boiler(tag: str, attributes: str) -> bool:
    if tag in BOILER_TAGS:
        return True
    if not attributes:
        return False
    for name, value in _hints.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag in PAGE_TAGS:
                continue
            for token in _tokens_in(value):
                words = _words_in(_camel.sub(" ", token).lower())
                if tag == "article" and ITEM_WORDS.isdisjoint(words[:1]) or words and words[0] in STATE_WORDS:
                    continue
                if not BOILER_WORDS.isdisjoint(words) or tag == "article":
                    return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Tags:
    """Finds the tags of a page one after another, in time linear in its length.

    A quoted value begins behind '='. Where one is not closed, or no end of the tag follows, tags end at the next '>' from
    there to the end of the page.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, {}
        self.last_end = page.rfind(">")

    def end(self, at: int) -> int:
        """Behind the '>' of the tag whose name ends at the given place, or -1 if none follows."""
        start = at
        while self.quotes:
            stop = _stop.search(self.page, at)
            if not stop:
                break
            if stop[0] == ">":
                return stop.end()
            at = self.page.find(stop[0][-1], stop.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.page.find(">", start) + 1 or -1

    def next(self, at: int):
        """(start, end, name, closing, attributes) of the next tag; comments and the like have no name. None if there is none."""
        page = self.page
        while found := _begin.search(page, at):
            start, name = found.start(), found[2]
            if name is None:
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0], ">")
                end = page.find(close, found.end()) if self.last_end >= found.end() else -1
                if end >= 0 or len(close) > 1:
                    return start, end + len(close) if end >= 0 else len(page), None, False, ""
            elif (end := self.end(found.end())) >= 0:
                return start, end, name.lower(), bool(found[1]), page[found.end() : end - 1]
            else:
                return None
            at = found.end()
        return None

    def silent_end(self, tag: str, at: int):
        """The match of the end tag behind the given place; looked for only if there is one."""
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in _silent_ends[tag].finditer(self.page)), default=-1)
        return _silent_ends[tag].search(self.page, at) if self.last[tag] >= at else None


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Flat text blocks of a page: (text, words, linked words, inside boilerplate markup, inside main markup).

    Text in silent elements is left out. One that is not closed ends with its parent.
    """
    out: list[tuple[str, int, int, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    open_tags: Counter = Counter()
    tags = _Tags(page)
    in_link = in_boiler = in_main = in_silent = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, len(text.split()), len(entities.unescape(" ".join(linked)).split()), in_boiler > 0, in_main > 0))
            parts.clear()
        linked.clear()

    def close(k: int) -> None:
        nonlocal in_boiler, in_main, in_silent
        while len(stack) > k:
            name, boiler, main, silent = stack.pop()
            open_tags[name] -= 1
            in_boiler -= boiler
            in_main -= main
            in_silent -= silent

    at, size = 0, len(page)
    while at < size:
        found = tags.next(at)
        start = found[0] if found else size
        if start > at and not in_silent:
            parts.append(page[at:start])
            if in_link:
                linked.append(page[at:start])
        if not found:
            break
        _, at, tag, closing, attributes = found
        if tag is None:
            continue
        if closing:
            ends = None
            if tag not in VOID_TAGS and open_tags[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        ends = k
                        break
                    if tag in PHRASE_TAGS and (stack[k][0] in MAIN_TAGS or stack[k][3] and (k == 0 or stack[k - 1][0] != tag)):
                        break
            if tag == "a":
                in_link = 0
            if tag in BLOCK_TAGS and not (in_silent and (ends is None or any(x[3] for x in stack[:ends]))):
                flush()
                in_link = 0
            if ends is not None:
                close(ends)
            continue
        if tag in _silent_ends:
            if tag in ("button", "select") and open_tags[tag]:
                # One that is still open ends here.
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][3]:
                        break
            if tag in BLOCK_TAGS and not in_silent:
                flush()
            if tag == "head" or tag in FOREIGN_TAGS and attributes.rstrip().endswith("/"):
                continue
            if tag in RAW_TAGS:
                end = tags.silent_end(tag, at)
                if end:
                    at = end.end()
                else:
                    parent = re.compile(rf"</{re.escape(stack[-1][0])}\s*>", re.I).search(page, at) if stack else None
                    at = parent.start() if parent else size
                continue
            stack.append((tag, False, False, True))
            open_tags[tag] += 1
            in_silent += 1
            continue
        if in_silent and tag == "br" or in_silent and tag == "a":
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 1
        if tag in BLOCK_TAGS:
            if not in_silent:
                flush()
                in_link = 0
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th") or tag in _implied_p:
                # An open paragraph, or item of the same list, ends here.
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                        close(k)
                        break
                    if stack[k][0] in BLOCK_TAGS or stack[k][3]:
                        break
        if tag in VOID_TAGS or attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        boiler, main = _boiler(tag, attributes), tag in MAIN_TAGS
        stack.append((tag, boiler, main, False))
        open_tags[tag] += 1
        in_boiler += boiler
        in_main += main
    flush()
    return out


def features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    """For each block: words and link density of the block before, of itself and of the next; its markup; main markup anywhere outside boilerplate."""
    if not found:
        return np.zeros((0, 9))
    words = np.array([b[1] for b in found], dtype=float)
    density = np.array([b[2] for b in found]) / np.maximum(words, 1)
    around = [np.r_[0, x[:-1]] if k == 0 else x if k == 1 else np.r_[x[1:], 0] for k in range(3) for x in (words, density)]
    page = any(b[4] and not b[3] for b in found)
    main = np.array([b[4] and page for b in found], dtype=float)
    return np.column_stack([*around, [float(b[3]) for b in found], main, np.full(len(found), main.max())])


# Labelled blocks. Words and link density of the block before, itself and the next, whether it is
# inside boilerplate markup, inside main markup, whether the page has main markup; then 1 for main text.
LABELLED = (
    (0, 0, 8, 0, 6, 0, 0, 1, 1, 1), (8, 0, 22, 0, 41, 0, 0, 1, 1, 1), (22, 0, 3, 0, 60, 0, 0, 1, 1, 1), (60, 0, 1, 0, 9, 0, 0, 1, 1, 1),
    (1, 1, 9, 0, 25, 0, 0, 1, 1, 1), (40, 0, 300, 0, 9, 0, 0, 1, 1, 1), (40, 0, 5, 0.4, 80, 0, 0, 1, 1, 1), (33, 0, 2, 1, 50, 0, 0, 1, 1, 1),
    (0, 0, 1, 1, 1, 1, 1, 0, 1, 0), (1, 1, 1, 1, 9, 0, 1, 0, 1, 0), (1, 1, 9, 0, 12, 0, 1, 0, 1, 0), (50, 0, 11, 0, 0, 0, 1, 0, 1, 0),
    (50, 0, 120, 0, 30, 0, 1, 1, 1, 0), (12, 0, 7, 0.5, 10, 0, 1, 1, 1, 0), (20, 0, 60, 0, 20, 0, 1, 0, 1, 0), (0, 0, 14, 0, 9, 0, 0, 0, 1, 0),
    (3, 1, 40, 0, 8, 0, 0, 0, 1, 0), (50, 0, 3, 1, 3, 1, 0, 0, 1, 0), (9, 0, 200, 0, 0, 0, 0, 0, 1, 0), (2, 1, 6, 0, 5, 1, 0, 0, 1, 0),
    (0, 0, 9, 0, 45, 0, 0, 0, 0, 1), (9, 0, 45, 0, 30, 0, 0, 0, 0, 1), (45, 0, 14, 0, 52, 0, 0, 0, 0, 1), (60, 0, 20, 0.1, 38, 0, 0, 0, 0, 1),
    (38, 0, 17, 0, 0, 0, 0, 0, 0, 1), (35, 0.1, 90, 0.05, 4, 1, 0, 0, 0, 1), (3, 1, 70, 0, 40, 0, 0, 0, 0, 1), (30, 0, 12, 0.2, 44, 0.1, 0, 0, 0, 1),
    (0, 0, 1, 1, 1, 1, 0, 0, 0, 0), (1, 1, 2, 1, 1, 1, 0, 0, 0, 0), (1, 1, 3, 0.9, 30, 0, 0, 0, 0, 0), (40, 0, 5, 1, 6, 1, 0, 0, 0, 0),
    (6, 1, 12, 0.8, 0, 0, 0, 0, 0, 0), (2, 1, 4, 0, 3, 1, 0, 0, 0, 0), (4, 1, 3, 0, 0, 0, 0, 0, 0, 0), (0, 0, 2, 0, 2, 1, 0, 0, 0, 0),
    (0, 0, 80, 0, 40, 0, 1, 0, 0, 0), (40, 0, 25, 0, 3, 1, 1, 0, 0, 0), (1, 1, 1, 0, 1, 1, 1, 0, 0, 0), (30, 0, 8, 0.3, 30, 0, 1, 0, 0, 0),
)


# Labelled pages. Words and link density of each block in page order; then 1 for main text. The first eight are pages of
# the synthetic table, the others are laid out by hand: headings, lists, related links, a page of links alone, one without a frame.
LABELLED_PAGES = (
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (8, 0, 0), (10, 0, 1), (51, 0, 1), (8, 0, 1), (11, 0, 1), (36, 0, 1), (32, 0, 1), (52, 0, 1), (25, 0, 1), (11, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (8, 0, 0), (11, 0, 1), (17, 0, 1), (143, 0, 1), (31, 0, 1), (189, 0, 1), (43, 0, 1), (51, 0, 1), (22, 0, 1), (11, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (4, 0, 0), (6, 0, 1), (6, 0, 1), (10, 0, 1), (15, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (12, 0, 0), (12, 0, 1), (184, 0, 1), (9, 0, 1), (10, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (7, 0, 0), (9, 0, 1), (9, 0, 1), (90, 0, 1), (30, 0, 1), (125, 0, 1), (42, 0, 1), (15, 0, 1), (50, 0, 1), (189, 0, 1), (107, 0, 1), (10, 0, 1), (34, 0, 1), (12, 0, 1), (13, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (12, 0, 0), (6, 0, 1), (6, 0, 1), (36, 0, 1), (38, 0, 1), (78, 0, 1), (92, 0, 1), (46, 0, 1), (167, 0, 1), (48, 0, 1), (60, 0, 1), (80, 0, 1), (243, 0, 1), (9, 0, 1), (89, 0, 1), (33, 0, 1), (135, 0, 1), (7, 0, 1), (7, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (13, 0, 0), (13, 0, 1), (31, 0, 1), (97, 0, 1), (3, 0, 1), (15, 0, 1), (33, 0, 1), (3, 0, 1), (43, 0, 1), (33, 0, 1), (15, 0, 1), (67, 0, 1), (25, 0, 1), (29, 0, 1), (17, 0, 1), (92, 0, 1), (7, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (4, 0, 0), (8, 0, 1), (8, 0, 1), (45, 0, 1), (1, 0, 1), (30, 0, 1), (37, 0, 1), (47, 0, 1), (2, 0, 1), (1, 0, 1), (15, 0, 1), (3, 0, 1), (8, 0, 1), (8, 0, 0)),
    ((1, 1, 0), (1, 1, 0), (2, 1, 0), (6, 0, 1), (48, 0, 1), (3, 0, 1), (4, 0, 1), (5, 0, 1), (3, 0, 1), (64, 0.05, 1), (4, 1, 0), (6, 1, 0), (5, 1, 0), (9, 0.2, 0)),
    ((4, 0, 0), (1, 1, 0), (1, 1, 0), (9, 0, 1), (3, 0, 1), (72, 0, 1), (2, 0, 1), (6, 0, 1), (4, 0, 1), (5, 0, 1), (41, 0, 1), (2, 0, 0), (7, 1, 0), (8, 1, 0), (6, 1, 0), (12, 0, 0)),
    ((2, 1, 0), (2, 1, 0), (7, 0, 1), (120, 0.02, 1), (85, 0, 1), (4, 0, 1), (90, 0.1, 1), (3, 1, 0), (2, 1, 0), (1, 1, 0)),
    ((1, 1, 0), (3, 1, 0), (2, 0, 0), (2, 1, 0), (3, 1, 0), (2, 0, 0), (4, 1, 0), (3, 1, 0), (8, 0.5, 0)),
    ((8, 0, 1), (35, 0, 1), (4, 0, 1), (6, 0, 1), (5, 0, 1), (7, 0, 1), (28, 0, 1), (52, 0, 1)),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, first: tuple[int, ...] = (6, 7, 8)) -> tuple | float:
    """A classification tree by Gini impurity: (feature, cut, below, above), or the share of ones in a leaf.

    Features in first, by default the markup, are split by as long as that gains anything; so what stands beside a block
    decides where markup doesn't.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    for some in (first, [k for k in range(x.shape[1]) if k not in first]):
        best = (1e-9, 0, 0.0)
        for k in some:
            values = np.unique(x[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, k] < cut
                p, q, w = y[low].mean(), y[~low].mean(), low.mean()
                gain = share * (1 - share) - w * p * (1 - p) - (1 - w) * q * (1 - q)
                if gain > best[0]:
                    best = (gain, k, float(cut))
        if best[2]:
            _, k, cut = best
            low = x[:, k] < cut
            return k, cut, grow(x[low], y[low], depth - 1, first), grow(x[~low], y[~low], depth - 1, first)
    return share


def classify(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    k, cut, below, above = tree
    return np.where(x[:, k] < cut, classify(below, x), classify(above, x)) if len(x) else np.zeros(0)


def main_text(page: str, tree: tuple | float) -> str:
    found = blocks(page)
    keep = classify(tree, features(found)) >= 0.5
    return "\n".join(block[0] for block, main in zip(found, keep) if main)


def page_rows(page: tuple) -> list[tuple]:
    """Rows as in LABELLED for the blocks of a labelled page: without any markup, and with markup around the main text and the rest."""
    rows = []
    for k, (words, density, label) in enumerate(page):
        beside = [page[j][:2] if 0 <= j < len(page) else (0, 0) for j in (k - 1, k + 1)]
        rows += [(*beside[0], words, density, *beside[1], *marks, label) for marks in ((0, 0, 0), (1 - label, label, 1))]
    return rows


def train_tree() -> tuple | float:
    """Grows the tree from the labelled blocks and pages."""
    table = np.array([*LABELLED, *(row for page in LABELLED_PAGES for row in page_rows(page))], dtype=float)
    return grow(table[:, :-1], table[:, -1])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The kept columns, text and n_chars (code points) of each page.

    A null or empty page, or one without main text, gives an empty text. Rows are independent: repeated
    rows give repeated results, and there is no shuffle. Other columns are not read.
    """
    tree = train_tree()

    def make():
        def run(pages_: list[str]):
            texts = [main_text(page, tree) for page in pages_]
            return [texts, [len(text) for text in texts]], None

        return run

    return map_texts(pages, {c: c for c in keep}, html_col, "text string, n_chars long", make)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
