"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its number of words, its share of
characters inside links, and the same two figures of its neighbours; further whether an article, page
furniture (menu, header, footer, sidebar) or a heading encloses it, whether it stands beside an article, and, where a class or id names an
advert, a notice, a form or reader comments, the share of the page's words that lies in that element: a
name on an element that holds most of the page tells nothing about a block. A decision tree trained on
labelled pages (``LABELLED_PAGES`` and layouts drawn by rules) tells which blocks are main text.

Scripts, styles, markup, comments of the markup and hidden elements are no text. Character
references are decoded; white space inside a block (line breaks too) becomes one space; blocks
without text vanish. A null or empty page has the text ''. Unclosed and wrongly nested tags are
borne: an end tag closes what is open inside its element, one without a start is ignored, and a tag that
is not closed ends at the next ``<``. A page is read in time proportional to its length, whatever it
holds; it is worked on whole. Equal pages have equal texts.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.llm.codes import unused

# ---- blocks --------------------------------------------------------------------------------

#: Names of elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre"
    " section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED_TAGS = frozenset(
    "head noscript template select button svg math object canvas audio video datalist".split()
)
FURNITURE_TAGS = frozenset("nav footer aside menu".split())
#: Elements that count like those a class names: usually small, but some pages are wrapped in one.
HINT_TAGS = frozenset(("form", "dialog"))
#: Elements whose class or id says something about the page, not about a block.
PAGE_TAGS = frozenset("html body main article".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words of a class or an id, split at what is no letter.
HINT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner promo promotion sponsor"
    " sponsored cookie cookies consent notice notices alert alerts popup modal overlay newsletter"
    " subscribe subscription share sharing social related recommended recommendations sidebar"
    " sidenav widget breadcrumb breadcrumbs menu menubar nav navbar navigation footer masthead"
    " toolbar pagination pager login signup signin register search toc skip copyright legal"
    " disclaimer gdpr paywall trending popular tags tagcloud".split()
)
COMMENT_WORDS = frozenset(
    "comment comments commentlist commenter disqus reply replies respond discussion"
    " feedback responses".split()
)
ARTICLE_WORDS = frozenset("article content post entry story maincontent".split())

_OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/><]*))")
_COMMENT_END = re.compile(r"--!?>")
_STOP = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I
)
_LETTERS = re.compile(r"[a-z]+")

ARTICLE, FURNITURE, HINT, COMMENT, DROPPED, LINK, HEADING = (1 << i for i in range(7))


def _flags(tag: str, attributes: str, outer: int) -> int:
    """What an element adds to what encloses it."""
    flags = 0
    if tag in ARTICLE_TAGS:
        flags |= ARTICLE
    elif tag in FURNITURE_TAGS or (tag == "header" and not outer & ARTICLE):
        flags |= FURNITURE
    elif tag in DROPPED_TAGS:
        flags |= DROPPED
    elif tag in HINT_TAGS:
        flags |= HINT
    elif tag == "a":
        flags |= LINK
    elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        flags |= HEADING
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                flags |= DROPPED
            elif name == "style":
                if "display:none" in value.replace(" ", ""):
                    flags |= DROPPED
            elif name == "role":
                if value in FURNITURE_ROLES:
                    flags |= FURNITURE
                elif value in ("main", "article"):
                    flags |= ARTICLE
            elif tag not in PAGE_TAGS:
                words = set(_LETTERS.findall(value))
                if words & COMMENT_WORDS:
                    flags |= COMMENT
                elif words & HINT_WORDS:
                    flags |= HINT
                elif words & ARTICLE_WORDS and tag in ("div", "section"):
                    flags |= ARTICLE
            elif tag == "article" and set(_LETTERS.findall(value)) & COMMENT_WORDS:
                # Reader comments may be articles themselves.
                flags |= COMMENT
    return flags


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Pieces of a page in order: the text before a tag, its slash, its lower-case name, its attributes.

    The last piece has no name. A quote counts behind an equals sign and if it is closed. Each
    character is looked at a bounded number of times.
    """
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while opening := _OPENING.search(page, at):
        text = page[at : opening.start()]
        comment, declaration, slash, tag = opening.groups()
        if comment:
            end = _COMMENT_END.search(page, opening.end())
            at = end.end() if end else size
            yield text, "", "!", ""
            continue
        if declaration:
            end = page.find(">", opening.end())
            at = end + 1 if end >= 0 else size
            yield text, "", "!", ""
            continue
        place = first = opening.end()
        while True:
            stop = _STOP.search(page, place)
            if stop is None:
                last = at = size
                break
            mark, last = stop.group(), stop.start()
            if mark == ">":
                at = last + 1
                break
            if mark == "<":
                at = last
                break
            place = last + 1
            if mark not in unclosed and page[first:last].rstrip().endswith("="):
                closing = page.find(mark, place)
                if closing < 0:
                    unclosed.add(mark)
                else:
                    place = closing + 1
                    first = place
        yield text, slash, tag.lower(), page[opening.end() : last]
    yield page[at:], "", "", ""


@dataclass
class Block:
    text: str
    words: int
    links: float
    flags: int
    #: Numbers of the innermost elements that a hint, and reader comments, are named on; 0 for none.
    hint: int = 0
    comment: int = 0


@dataclass
class Page:
    """Blocks, and for each named element the one that it lies in."""

    blocks: list[Block]
    outer: list[int]


def text_blocks(page: str | None) -> Page:
    """The flat blocks of a page that hold text, in order."""
    page = page or ""
    blocks: list[Block] = []
    outer = [0]
    parts: list[str] = []
    linked = 0
    # What is open, with what held before it; the parts of a block all lie in one block-level element.
    stack: list[tuple[str, tuple[int, int, int]]] = []
    opened: dict[str, int] = {}
    flags = hint = comment = 0

    def put(raw: str) -> None:
        nonlocal linked
        if not flags & DROPPED and raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if flags & LINK:
                linked += len(text.strip())

    def close() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                text = " ".join(words)
                share = min(1.0, linked / max(1, sum(map(len, words))))
                blocks.append(Block(text, len(words), share, flags, hint, comment))
            parts.clear()
        linked = 0

    skipped = ""  # the element whose raw content is left out
    for text, slash, tag, attributes in markup(page):
        if skipped:
            # What stands before its end tag is no text, whatever it looks like.
            if not (slash and tag == skipped):
                continue
            skipped = ""
            continue
        put(text)
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
        if slash:
            if opened.get(tag):
                name = ""
                while name != tag:
                    name, (flags, hint, comment) = stack.pop()
                    opened[name] -= 1
            continue
        if not tag or tag == "!" or tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            skipped = tag
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:
            _, (flags, hint, comment) = stack.pop()
            opened[tag] -= 1
        if tag == "body":
            flags = hint = comment = 0
            stack.clear()
            opened.clear()
        stack.append((tag, (flags, hint, comment)))
        opened[tag] = opened.get(tag, 0) + 1
        added = _flags(tag, attributes, flags)
        flags |= added
        if added & HINT:
            outer.append(hint)
            hint = len(outer) - 1
        elif tag in ARTICLE_TAGS:
            # What is named around a whole article says nothing about its blocks.
            hint = 0
        if added & COMMENT:
            outer.append(comment)
            comment = len(outer) - 1
    close()
    return Page(blocks, outer)


def named_shares(page: Page) -> tuple[list[float], list[float]]:
    """For each block the share of the page's words, outside furniture, in the innermost element around
    it that a hint is named on, and in the one that reader comments are named on; 0 without one."""
    inside = [0] * len(page.outer)
    total = 0
    for block in page.blocks:
        if not block.flags & FURNITURE:
            total += block.words
            inside[block.hint] += block.words
            if block.comment != block.hint:
                inside[block.comment] += block.words
    # Inner elements have larger numbers than those they lie in.
    for number in range(len(page.outer) - 1, 0, -1):
        inside[page.outer[number]] += inside[number]
    share = [0.0, *(n / max(total, 1) for n in inside[1:])]
    # An element without such words is as small as can be, yet named.
    least = 1e-6
    return (
        [max(share[b.hint], least) if b.hint else 0.0 for b in page.blocks],
        [max(share[b.comment], least) if b.comment else 0.0 for b in page.blocks],
    )


#: Columns of the feature table.
FEATURES = (
    "words",
    "links",
    "words_before",
    "links_before",
    "words_after",
    "links_after",
    "article",
    "furniture",
    "heading",
    "beside_article",
    "hint_share",
    "comment_share",
)


def block_features(
    words: list[int],
    links: list[float],
    flags: list[int],
    hint_shares: list[float],
    comment_shares: list[float],
) -> np.ndarray:
    """One row of ``FEATURES`` for each block of a page; the neighbours of the ends are empty."""
    own = np.zeros((len(words), len(FEATURES)))
    own[:, 0], own[:, 1] = words, links
    own[1:, 2], own[1:, 3] = own[:-1, 0], own[:-1, 1]
    own[:-1, 4], own[:-1, 5] = own[1:, 0], own[1:, 1]
    marks = np.array(flags, np.int64)
    for column, flag in enumerate((ARTICLE, FURNITURE, HEADING), 6):
        own[:, column] = (marks & flag) > 0
    inside = own[:, 6] > 0
    own[:, 9] = ~inside & inside.any()
    own[:, 10], own[:, 11] = hint_shares, comment_shares
    return own


# ---- the tree ------------------------------------------------------------------------------

#: Labelled blocks of small pages: words, share of linked characters, what encloses the block (A
#: article, F furniture, H an element that a hint is named on, C one of reader comments, T heading) and
#: whether it is main text. Neighbours with the same H or C lie in one element.
LABELLED_PAGES: list[list[tuple[int, float, str, int]]] = [
    [(1, 1.0, "F", 0), (1, 1.0, "F", 0), (2, 1.0, "F", 0), (9, 0.0, "H", 0), (8, 0.0, "AT", 1),
     (60, 0.0, "A", 1), (3, 0.0, "A", 1), (45, 0.1, "A", 1), (12, 0.0, "F", 0)],
    [(3, 1.0, "F", 0), (14, 0.0, "H", 0), (5, 0.0, "AT", 1), (1, 0.0, "A", 1), (120, 0.02, "A", 1),
     (30, 0.0, "AH", 0), (80, 0.0, "A", 1), (2, 0.0, "A", 1), (25, 0.0, "AC", 0), (40, 0.0, "AC", 0),
     (8, 0.3, "F", 0)],
    [(6, 0.0, "F", 0), (20, 0.9, "F", 0), (7, 0.0, "T", 1), (75, 0.0, "", 1), (4, 0.0, "", 1),
     (66, 0.05, "", 1), (35, 0.0, "C", 0), (18, 0.0, "C", 0), (5, 1.0, "", 0), (6, 0.2, "F", 0)],
    [(2, 1.0, "", 0), (3, 1.0, "", 0), (2, 1.0, "", 0), (9, 0.0, "T", 1), (55, 0.0, "", 1),
     (38, 0.1, "", 1), (90, 0.0, "", 1), (4, 1.0, "", 0), (3, 1.0, "", 0), (7, 0.0, "", 0)],
    [(40, 0.0, "H", 0), (55, 0.0, "F", 0), (10, 0.0, "AT", 1), (33, 0.0, "A", 1), (5, 0.6, "A", 1),
     (28, 0.9, "AH", 0), (22, 0.0, "A", 1), (15, 0.0, "AF", 0), (70, 0.0, "AC", 0)],
    [(4, 1.0, "F", 0), (1, 0.0, "AT", 1), (1, 0.0, "A", 1), (2, 0.0, "A", 1), (1, 1.0, "A", 1),
     (6, 0.0, "A", 1), (3, 0.0, "F", 0)],
    [(25, 0.0, "F", 0), (30, 0.0, "H", 0), (50, 0.3, "F", 0), (12, 0.0, "T", 1), (200, 0.0, "", 1),
     (3, 0.0, "T", 1), (150, 0.02, "", 1), (60, 0.0, "C", 0), (4, 0.0, "CT", 0), (20, 0.8, "", 0)],
    [(8, 1.0, "", 0), (5, 1.0, "", 0), (6, 0.0, "", 0), (4, 0.9, "", 0), (48, 0.0, "", 1),
     (52, 0.0, "", 1), (3, 1.0, "", 0), (5, 0.8, "", 0), (2, 1.0, "", 0)],
    [(5, 0.0, "FT", 0), (3, 1.0, "F", 0), (2, 0.0, "HT", 0), (9, 1.0, "H", 0), (6, 0.0, "AT", 1),
     (15, 0.0, "A", 1), (4, 0.0, "AHT", 0), (11, 1.0, "AH", 0), (3, 0.0, "ACT", 0), (9, 0.0, "AC", 0),
     (6, 0.0, "AFT", 0), (7, 0.9, "AF", 0)],
    [(110, 0.0, "A", 1), (95, 0.0, "AF", 0), (130, 0.0, "AH", 0), (140, 0.0, "AC", 0),
     (85, 0.0, "A", 1), (100, 0.0, "F", 0), (105, 0.0, "H", 0), (115, 0.0, "C", 0)],
    [(5, 0.0, "AT", 1), (40, 0.0, "A", 1)],
    [(3, 1.0, "F", 0), (30, 0.4, "A", 1), (3, 1.0, "F", 0), (50, 0.7, "A", 1), (2, 1.0, "F", 0),
     (4, 1.0, "A", 1), (6, 1.0, "A", 1), (9, 0.9, "A", 1), (2, 1.0, "A", 1)],
    [(1, 1.0, "A", 1), (9, 1.0, "A", 1), (25, 1.0, "A", 1), (1, 0.0, "A", 1), (8, 0.5, "A", 1),
     (3, 1.0, "AH", 0), (14, 0.3, "A", 1), (3, 1.0, "AC", 0), (2, 0.3, "A", 1), (1, 1.0, "AF", 0)],
    [(7, 1.0, "AT", 1), (12, 0.2, "A", 1), (5, 1.0, "A", 1), (40, 0.6, "A", 1), (70, 0.3, "A", 1)],
    [(3, 1.0, "F", 0), (2, 0.0, "", 0), (40, 0.0, "", 1)],
    [(3, 1.0, "F", 0), (60, 0.2, "", 1), (2, 0.0, "", 1), (45, 0.0, "", 1), (8, 1.0, "", 0)],
    [(12, 0.0, "", 1)],
    [(2, 1.0, "", 0)],
    [(30, 0.9, "", 0), (3, 1.0, "", 0), (4, 0.7, "", 0), (25, 0.0, "F", 0)],
    [(150, 0.0, "H", 0), (1, 0.0, "A", 1), (160, 0.0, "C", 0), (2, 0.0, "A", 1), (90, 0.0, "F", 0),
     (3, 0.0, "A", 1), (2, 0.4, "H", 0), (1, 0.0, "C", 0), (3, 0.2, "F", 0), (4, 0.0, "A", 1)],
]
_LETTER_FLAGS = {"A": ARTICLE, "F": FURNITURE, "T": HEADING, "H": HINT, "C": COMMENT}

Labelled = list[tuple[int, float, str, int]]


def drawn_page(draw: random.Random) -> Labelled:
    """A page of a common layout, drawn by rules.

    Menus are short links, adverts and notices short texts, paragraphs of any length with few links;
    comments come after the article, or not at all. Some pages mark their parts and some do not; without
    marks only the figures tell, and short blocks count as their neighbours do.
    """
    marks = draw.choice(["tags", "classes", "wrapped", "none", "none"])
    page: Labelled = []

    def add(least: int, most: int, links: float, kind: str, main: int, spread: float = 0.0) -> None:
        share = min(1.0, max(0.0, links + draw.uniform(-spread, spread)))
        page.append((draw.randint(least, most), round(share, 2), kind, main))

    named = {"tags": ("F", "H", "A", "C"), "classes": ("H", "H", "A", "C"), "wrapped": ("", "H", "H", "C")}
    menu, advert, article, comments = named.get(marks, ("", "", "", ""))
    bare = article == "A" and draw.random() < 0.2
    for _ in range(0 if bare else draw.randint(2, 8)):
        add(1, 4, 1.0, menu, 0)
    if marks != "none" and draw.random() < 0.7:
        add(3, 30, draw.choice([0.0, 0.4, 1.0]), advert, 0, 0.2)
    # Articles that are marked may be as short as a line.
    body = draw.randint(0 if article == "A" else 2, 12)
    if body < 2 or draw.random() < 0.7:
        add(1, 14, 0.0, article + "T", 1)
    for i in range(body):
        short = draw.random() < 0.25 and i < body - 1
        add(1 if short else 18, 9 if short else 160, draw.choice([0.0, 0.0, 0.05, 0.15]), article, 1)
        if marks in ("tags", "classes") and draw.random() < 0.15:
            add(3, 25, draw.choice([0.0, 0.6]), "AH" if article == "A" else "H", 0, 0.1)
        if article == "A" and draw.random() < 0.3:
            # Inside a marked article lists of links and notes belong to it as well.
            add(1, 40, 0.5, article, 1, 0.5)
    if marks != "none" and draw.random() < 0.4:
        for _ in range(draw.randint(1, 6)):
            add(3, 90, 0.0, comments, 0)
    for _ in range(0 if bare else draw.randint(1, 5)):
        add(1, 9, draw.choice([1.0, 0.8]), menu, 0, 0.1)
    return page


def labelled_blocks(drawn: int = 1_500, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table and of drawn pages."""
    draw = random.Random(seed)
    rows, labels = [], []
    for page in [*LABELLED_PAGES, *(drawn_page(draw) for _ in range(drawn))]:
        words, links, marks, main = zip(*page, strict=True)
        flags = [sum(_LETTER_FLAGS[letter] for letter in mark) for mark in marks]
        blocks, outer, before = [], [0], 0
        for count, share, own in zip(words, links, flags, strict=True):
            element = []
            for flag, held in ((HINT, blocks[-1].hint if blocks else 0), (COMMENT, blocks[-1].comment if blocks else 0)):
                if own & flag and not (held and before & flag):
                    outer.append(0)
                    held = len(outer) - 1
                element.append(held if own & flag else 0)
            blocks.append(Block("", count, share, own, *element))
            before = own
        shares = named_shares(Page(blocks, outer))
        rows.append(block_features(list(words), list(links), flags, *shares))
        labels.extend(main)
    return np.concatenate(rows), np.array(labels)


class DecisionTree:
    """A binary classification tree: splits that lower the Gini impurity most, the first column of
    equally good ones; nodes of fewer than ``least`` rows on a side are not made."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12, least: int = 2) -> None:
        # Node: (column, threshold, left, right), or (-1, label, 0, 0) at a leaf.
        self.nodes: list[tuple[int, float, int, int]] = []
        self.least = least
        self._grow(rows, labels, depth)

    def _split(self, rows: np.ndarray, labels: np.ndarray) -> tuple[float, int, float] | None:
        best = None
        count = np.arange(1, len(labels))
        for column in range(rows.shape[1]):
            order = np.argsort(rows[:, column], kind="stable")
            values, ones = rows[order, column], np.cumsum(labels[order])
            left, right = ones[:-1], ones[-1] - ones[:-1]
            rest = len(labels) - count
            impurity = left * (1 - left / count) + right * (1 - right / rest)
            allowed = (values[1:] > values[:-1]) & (count >= self.least) & (rest >= self.least)
            if allowed.any():
                at = int(np.argmin(np.where(allowed, impurity, np.inf)))
                if best is None or impurity[at] < best[0] - 1e-9:
                    best = (float(impurity[at]), column, float(values[at] + values[at + 1]) / 2)
        return best

    def _grow(self, rows: np.ndarray, labels: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, float(2 * labels.sum() > len(labels)), 0, 0))
        best = None if depth == 0 or labels.min() == labels.max() else self._split(rows, labels)
        if best is None:
            return at
        _, column, threshold = best
        left = rows[:, column] <= threshold
        low = self._grow(rows[left], labels[left], depth - 1)
        high = self._grow(rows[~left], labels[~left], depth - 1)
        self.nodes[at] = (column, threshold, low, high)
        return at

    def predict(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros(len(rows), bool)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            at, own = waiting.pop()
            column, threshold, low, high = self.nodes[at]
            if column < 0:
                found[own] = threshold > 0
                continue
            left = rows[own, column] <= threshold
            waiting += [(low, own[left]), (high, own[~left])]
        return found


def train() -> DecisionTree:
    return DecisionTree(*labelled_blocks())


def main_text(page: Page, tree: DecisionTree) -> str:
    blocks = page.blocks
    if not blocks:
        return ""
    rows = block_features(
        [b.words for b in blocks],
        [b.links for b in blocks],
        [b.flags for b in blocks],
        *named_shares(page),
    )
    kept = tree.predict(rows)
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


# ---- Spark ---------------------------------------------------------------------------------


def extract_main_text(
    pages: DataFrame, column: str = "html", tree: DecisionTree | None = None
) -> DataFrame:
    """Add ``main_text`` and ``n_blocks`` (blocks with text) of every whole page.

    Columns of these names that the pages have already are replaced.
    """
    own = tree or train()
    result = T.StructType(
        [T.StructField("main_text", T.StringType()), T.StructField("n_blocks", T.LongType())]
    )

    @F.pandas_udf(result)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [text_blocks(page) for page in batch]
            yield pd.DataFrame(
                {
                    "main_text": [main_text(page, own) for page in cut],
                    "n_blocks": [len(page.blocks) for page in cut],
                }
            )

    kept = [c for c in pages.columns if c not in result.names]
    name = unused("found", pages.columns)
    found = pages.withColumn(name, extract(F.col(column)))
    return found.select(*kept, f"{name}.*")
