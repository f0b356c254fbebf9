"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape.

A page is read once into blocks of text between block-level tags. A block is described by its words and link density, those
of the blocks before and after it, its kind (heading, paragraph, other) and where it stands: inside the page's article, outside of it, or on a
page that marks none; and whether one of its ancestors is page furniture by tag, role or the name of a container such as comments, adverts or
sidebars, or has a name that says less. The tree is fitted on the small labelled table below; a long block with few links is main text
there in spite of a name of the last kind.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import with_columns
from simloom.llm.learners import Node, fit_tree, predict_tree

SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words of class and id names that mark page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay newsletter subscribe signup login register sidebar side widget widgets related recommended"
    " recommendations trending popular share sharing social comment comments commentlist disqus reply replies respond discussion nav navbar navigation"
    " menu menus breadcrumb breadcrumbs pagination pager toolbar footer masthead skip skiplink topbar tags copyright disclaimer form search".split())
#: Of these, names of containers that hold no main text whatever its shape.
CONTAINER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification"
    " popup modal overlay newsletter subscribe signup login sidebar comment comments commentlist disqus breadcrumb breadcrumbs pagination disclaimer".split())
#: Names of containers when they stand alone or with one of the others: ``related`` and ``related-posts``, not ``related-work``.
LISTING_NAMES, LISTED_NAMES = frozenset("related recommended recommendations trending popular".split()), frozenset("article articles post posts story stories news links reading".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_STRUCTURE = FURNITURE_TAGS | MAIN_TAGS | {"header"}
#: An open element is closed by the start of one of these.
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
             "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_NAME = re.compile(r"[a-z]+")
_ABOUT = re.compile(r"(?<!\S)(?:category|tag|has)-\S*", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Labelled blocks: words, link density, words and link density of the block before, of the block after, place (1 in
#: the article, -1 outside the article, 0 no article marked), furniture (1 by a name that says little, 2 by tag, role, the name of a container
#: or being hidden), and whether the block is main text. These hold for paragraphs and for other blocks but headings.
_SHAPES = (
    (40, 0.0, 35, 0.0, 50, 0.0, 1, 0, 1), (120, 0.05, 9, 0.0, 80, 0.0, 1, 0, 1), (1, 0.0, 60, 0.0, 45, 0.0, 1, 0, 1), (2, 0.0, 1, 0.0, 3, 0.0, 1, 0, 1),
    (8, 0.0, 1, 1.0, 70, 0.0, 1, 0, 1), (10, 0.0, 12, 0.0, 0, 0.0, 1, 0, 1), (25, 0.2, 30, 0.0, 4, 0.0, 1, 0, 1), (5, 0.0, 0, 0.0, 6, 0.0, 1, 0, 1),
    (60, 0.4, 50, 0.1, 40, 0.0, 1, 0, 1), (3, 1.0, 40, 0.0, 52, 0.0, 1, 0, 1), (15, 0.0, 15, 0.0, 15, 0.0, 1, 0, 1), (1, 1.0, 1, 0.0, 20, 0.0, 1, 0, 1),
    (7, 0.0, 3, 0.0, 4, 1.0, 1, 0, 1), (30, 0.0, 2, 1.0, 1, 1.0, 1, 0, 1), (4, 1.0, 4, 1.0, 4, 1.0, 1, 0, 1), (9, 0.6, 90, 0.0, 6, 0.5, 1, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (2, 0.5, 0, 0.0, 0, 0.0, 1, 0, 1), (90, 0.0, 12, 0.3, 11, 0.4, 1, 0, 1), (200, 0.3, 8, 0.0, 2, 1.0, 1, 0, 1),
    (12, 0.0, 6, 1.0, 13, 0.0, 1, 0, 1), (3, 0.0, 5, 0.0, 1, 0.9, 1, 0, 1), (14, 0.3, 14, 0.3, 14, 0.3, 1, 0, 1), (50, 0.9, 10, 0.0, 5, 0.0, 1, 0, 1),
    (5, 0.2, 11, 0.0, 40, 0.4, 1, 0, 1), (38, 0.0, 8, 0.0, 3, 0.3, 1, 0, 1), (1, 1.0, 30, 0.5, 2, 0.0, 1, 0, 1), (17, 0.0, 10, 0.9, 7, 0.8, 1, 0, 1),
    (70, 0.0, 60, 0.0, 2, 0.0, -1, 0, 0), (6, 0.0, 60, 0.0, 70, 0.0, -1, 0, 0), (2, 0.0, 2, 0.0, 2, 0.0, -1, 0, 0), (100, 0.0, 90, 0.0, 80, 0.0, -1, 0, 0),
    (12, 0.2, 0, 0.0, 0, 0.0, -1, 0, 0), (19, 0.0, 14, 0.0, 1, 1.0, -1, 0, 0), (35, 0.1, 40, 0.0, 12, 0.0, -1, 0, 0), (3, 0.0, 7, 1.0, 25, 0.0, -1, 0, 0),
    (6, 0.0, 30, 0.0, 1, 1.0, 1, 2, 0), (40, 0.0, 60, 0.0, 60, 0.0, 1, 2, 0), (3, 1.0, 60, 0.0, 3, 1.0, 1, 2, 0), (80, 0.1, 3, 0.0, 70, 0.0, 1, 2, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 2, 0), (25, 0.0, 2, 0.0, 24, 0.0, 1, 2, 0), (12, 0.0, 1, 0.5, 90, 0.0, 1, 2, 0), (9, 0.3, 9, 0.3, 9, 0.3, 1, 2, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, -1, 2, 0), (12, 0.0, 1, 1.0, 9, 0.0, -1, 2, 0), (14, 0.1, 70, 0.0, 0, 0.0, -1, 2, 0), (60, 0.0, 2, 0.0, 30, 0.0, -1, 2, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, -1, 0, 0), (8, 0.0, 0, 0.0, 1, 1.0, -1, 0, 0), (30, 0.0, 5, 0.0, 12, 0.0, -1, 0, 0), (90, 0.02, 6, 0.0, 3, 1.0, -1, 0, 0),
    (4, 0.0, 40, 0.0, 0, 0.0, -1, 0, 0), (22, 0.6, 2, 1.0, 2, 1.0, -1, 0, 0), (15, 0.0, 60, 0.0, 15, 0.0, -1, 0, 0), (45, 0.0, 45, 0.0, 45, 0.0, -1, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 2, 0), (20, 0.0, 40, 0.0, 30, 0.0, 0, 2, 0), (6, 0.0, 50, 0.0, 0, 0.0, 0, 2, 0), (70, 0.0, 5, 0.0, 60, 0.0, 0, 2, 0),
    (45, 0.0, 50, 0.0, 38, 0.0, 0, 0, 1), (28, 0.1, 7, 0.0, 60, 0.0, 0, 0, 1), (100, 0.02, 2, 1.0, 90, 0.0, 0, 0, 1), (20, 0.0, 90, 0.0, 25, 0.0, 0, 0, 1),
    (35, 0.25, 20, 0.0, 4, 1.0, 0, 0, 1), (18, 0.0, 40, 0.0, 6, 1.0, 0, 0, 1), (55, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (22, 0.05, 12, 0.0, 14, 0.0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1), (3, 0.0, 60, 0.0, 55, 0.0, 0, 0, 1), (9, 0.0, 35, 0.0, 40, 0.0, 0, 0, 1), (12, 0.0, 70, 0.0, 5, 0.0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (5, 0.8, 2, 1.0, 4, 1.0, 0, 0, 0), (25, 0.9, 3, 1.0, 2, 1.0, 0, 0, 0), (8, 1.0, 0, 0.0, 6, 1.0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (7, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0), (5, 0.0, 1, 1.0, 6, 0.5, 0, 0, 0), (3, 0.0, 2, 0.0, 2, 1.0, 0, 0, 0),
    (40, 0.7, 50, 0.0, 3, 1.0, 0, 0, 0), (16, 0.6, 30, 0.0, 30, 0.0, 0, 0, 0), (6, 1.0, 50, 0.0, 45, 0.0, 0, 0, 0), (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0),
    (45, 0.0, 50, 0.0, 60, 0.0, 1, 1, 1), (30, 0.0, 2, 0.0, 70, 0.05, 1, 1, 1), (120, 0.05, 9, 0.0, 80, 0.0, 1, 1, 1), (20, 0.0, 35, 0.0, 40, 0.0, 1, 1, 1),
    (25, 0.1, 60, 0.0, 3, 1.0, 1, 1, 1), (80, 0.0, 1, 0.0, 0, 0.0, 1, 1, 1), (200, 0.2, 40, 0.0, 12, 0.0, 1, 1, 1), (35, 0.0, 6, 0.0, 8, 0.3, 1, 1, 1),
    (6, 0.0, 30, 0.0, 1, 1.0, 1, 1, 0), (2, 0.0, 3, 0.0, 2, 0.0, 1, 1, 0), (5, 0.0, 2, 0.0, 0, 0.0, 1, 1, 0), (13, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0),
    (9, 0.3, 9, 0.3, 9, 0.3, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 1, 0), (10, 0.0, 1, 0.5, 90, 0.0, 1, 1, 0), (40, 0.7, 50, 0.0, 3, 1.0, 1, 1, 0),
    (3, 1.0, 60, 0.0, 3, 1.0, 1, 1, 0), (22, 0.6, 2, 1.0, 2, 1.0, 1, 1, 0), (1, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0), (14, 0.0, 8, 0.0, 70, 0.0, 1, 1, 0),
    (120, 0.02, 90, 0.0, 80, 0.0, 0, 1, 1), (100, 0.0, 60, 0.0, 110, 0.05, 0, 1, 1), (150, 0.1, 4, 1.0, 3, 1.0, 0, 1, 1), (110, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (20, 0.0, 40, 0.0, 30, 0.0, 0, 1, 0), (13, 0.0, 50, 0.0, 60, 0.0, 0, 1, 0), (60, 0.0, 5, 0.0, 60, 0.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0),
    (100, 0.7, 3, 1.0, 4, 1.0, 0, 1, 0), (6, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0), (30, 0.1, 25, 0.1, 40, 0.0, 0, 1, 0), (5, 0.8, 2, 1.0, 4, 1.0, 0, 1, 0),
    (14, 0.1, 70, 0.0, 0, 0.0, -1, 1, 0), (60, 0.0, 2, 0.0, 30, 0.0, -1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 1, 0), (120, 0.0, 60, 0.0, 90, 0.0, -1, 1, 0),
)
#: The same with the kind of block (0 other, 1 paragraph, 2 heading) before the label, where the kind decides: short paragraphs and
#: headings beside text on pages that mark no article, and the same shapes without such a neighbour.
_KINDS = (
    (6, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1, 1), (4, 0.0, 30, 0.0, 0, 0.0, 0, 0, 1, 1), (3, 0.0, 80, 0.05, 2, 1.0, 0, 0, 1, 1), (8, 0.0, 22, 0.0, 3, 0.0, 0, 0, 1, 1),
    (5, 0.0, 45, 0.0, 60, 0.0, 0, 0, 1, 1), (2, 0.0, 40, 0.0, 35, 0.0, 0, 0, 1, 1), (9, 0.0, 6, 0.0, 40, 0.0, 0, 0, 1, 1), (4, 0.0, 2, 1.0, 55, 0.0, 0, 0, 1, 1),
    (6, 1.0, 50, 0.0, 2, 1.0, 0, 0, 1, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0), (5, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1, 0), (4, 0.8, 60, 0.0, 3, 1.0, 0, 0, 1, 0),
    (50, 0.0, 40, 0.0, 1, 1.0, 0, 0, 1, 1), (30, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1, 1), (70, 0.0, 60, 0.0, 2, 1.0, 0, 0, 1, 1), (25, 0.0, 30, 0.0, 2, 1.0, 0, 0, 1, 1),
    (90, 0.0, 4, 0.0, 2, 1.0, 0, 0, 1, 1), (16, 0.0, 55, 0.0, 1, 1.0, 0, 0, 1, 1), (12, 0.0, 3, 0.0, 30, 0.0, 0, 0, 1, 1), (40, 0.1, 5, 0.0, 4, 0.0, 0, 0, 1, 1),
    (2, 0.0, 40, 0.0, 30, 0.0, 1, 1, 2, 1), (1, 0.0, 80, 0.0, 50, 0.0, 1, 1, 2, 1), (6, 0.0, 25, 0.0, 30, 0.0, 1, 1, 2, 1), (3, 0.0, 60, 0.0, 90, 0.0, 1, 1, 2, 1),
    (5, 0.0, 2, 1.0, 60, 0.0, 0, 0, 2, 1), (3, 0.0, 0, 0.0, 40, 0.0, 0, 0, 2, 1), (8, 0.0, 1, 1.0, 25, 0.1, 0, 0, 2, 1), (2, 0.0, 70, 0.0, 50, 0.0, 0, 0, 2, 1),
    (4, 0.0, 30, 0.0, 18, 0.0, 0, 0, 2, 1), (12, 0.0, 3, 1.0, 90, 0.0, 0, 0, 2, 1), (6, 0.0, 4, 1.0, 35, 0.0, 0, 0, 2, 1), (1, 0.0, 55, 0.0, 45, 0.0, 0, 0, 2, 1),
    (2, 0.0, 60, 0.0, 1, 1.0, 0, 0, 2, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 2, 0), (2, 0.0, 40, 0.0, 3, 1.0, 0, 0, 2, 0), (4, 1.0, 1, 1.0, 2, 1.0, 0, 0, 2, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 2, 0), (3, 0.0, 50, 0.0, 0, 0.0, 0, 0, 2, 0), (6, 0.0, 0, 0.0, 60, 0.0, 1, 0, 2, 1), (2, 0.0, 40, 0.0, 1, 1.0, 1, 0, 2, 1),
    (3, 0.0, 45, 0.0, 60, 0.0, 1, 1, 2, 1), (2, 0.0, 30, 0.0, 45, 0.0, 1, 1, 2, 1), (4, 0.0, 70, 0.0, 25, 0.0, 1, 1, 2, 1), (2, 0.0, 60, 0.0, 3, 1.0, 1, 1, 2, 0),
    (3, 0.0, 20, 0.0, 2, 1.0, 1, 1, 2, 0), (5, 0.0, 0, 0.0, 60, 0.0, -1, 0, 2, 0), (3, 0.0, 60, 0.0, 9, 0.0, -1, 0, 2, 0), (6, 0.0, 9, 0.0, 60, 0.0, 1, 2, 2, 0),
    (2, 0.0, 60, 0.0, 60, 0.0, 0, 2, 2, 0), (4, 0.0, 3, 1.0, 50, 0.0, 0, 2, 2, 0), (5, 0.0, 4, 1.0, 2, 0.0, 1, 0, 2, 1), (4, 0.0, 12, 0.0, 30, 0.0, -1, 1, 2, 0),
    (5, 0.0, 40, 0.0, 30, 0.0, 1, 0, 2, 1), (5, 0.0, 40, 0.0, 30, 0.0, 0, 1, 2, 0), (2, 0.0, 3, 1.0, 3, 1.0, 0, 1, 2, 0), (3, 0.0, 60, 0.0, 20, 0.0, 0, 1, 2, 0),
)
LABELLED = (*((*row[:-1], kind, row[-1]) for row in _SHAPES for kind in (0, 1) if (*row[:-1], kind) not in {r[:-1] for r in _KINDS}), *_KINDS)


@lru_cache(maxsize=1)
def tree() -> Node:
    rows = np.array(LABELLED, float)
    return fit_tree(rows[:, :-1], rows[:, -1], depth=8)


@lru_cache(maxsize=100_000)
def _names(value: str) -> frozenset[str]:
    """Words of class and id names, without those that say what a page is about or has elsewhere."""
    return frozenset(_NAME.findall(_HUMP.sub(" ", _ABOUT.sub(" ", value)).lower()))


def _whole_names(value: str) -> frozenset[str]:
    """Class names that are one word: ``related``, not ``related-work``."""
    return frozenset(value.lower().split())


class _Blocks(HTMLParser):
    """Collects (text pieces, words, words in links, kind, in the article, furniture) per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, in the article, furniture, silent
        self.links, self.pieces, self.in_links = 0, [], 0

    def _flush(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            _, main, furniture, _ = self.open[-1] if self.open else ("", False, 0, False)
            tag = next((t for t, *_ in reversed(self.open) if t not in INLINE), "")
            n = text.count(" ") + 1
            self.blocks.append([text, n, min(self.in_links, n) / n, 2 if tag in HEADINGS else int(tag == "p"), main, furniture])
        self.pieces, self.in_links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        _, main, furniture, silent = self.open[-1] if self.open else ("", False, 0, False)
        if not attrs and tag not in _STRUCTURE:
            self.links += tag == "a"
            self.open.append((tag, main, furniture, silent or tag in SILENT))
            return
        given = {k: v or "" for k, v in attrs}
        names = _names(f"{given.get('class', '')} {given.get('id', '')}") if tag not in ("html", "body") else frozenset()
        named = bool(FURNITURE_NAMES & names)
        # Headings and inline tags name what they are about; the first article or main tag is the article whatever it is called.
        contains = tag not in INLINE and tag not in HEADINGS and bool(
            CONTAINER_NAMES & names or LISTING_NAMES & names and (LISTED_NAMES & names or LISTING_NAMES & _whole_names(f"{given.get('class', '')} {given.get('id', '')}")))
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        starts = tag in MAIN_TAGS or given.get("role") == "main" or given.get("itemprop") == "articleBody"
        if starts and not main:
            contains = bool((CONTAINER_NAMES | LISTING_NAMES) & _whole_names(given.get("class", "")))
        own = 2 if tag in FURNITURE_TAGS or given.get("role", "") in FURNITURE_ROLES or hidden or contains else int(named)
        if tag == "header" and not main:
            own = 2
        if starts and (not own or own == 1 and not main):
            # An article inside something that is only named like furniture is an article; inside a nav or aside it is none.
            own, furniture = 0, 2 * any(t in FURNITURE_TAGS for t, *_ in self.open)
            main = main or not furniture
        if tag == "a":
            self.links += 1
        self.open.append((tag, main, max(furniture, own), silent or tag in SILENT))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._flush()
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            if tag in INLINE and any(t not in INLINE for t, *_ in self.open[at:]):
                return  # an inline tag does not close the blocks opened inside it
            self.links -= sum(t == "a" for t, *_ in self.open[at:])
            del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1][3]:
            return
        self.pieces.append(data)
        if self.links:
            self.in_links += len(data.split())

    def finish(self):
        self.close()
        self._flush()


def blocks(html: str | None) -> list[tuple[str, tuple[float, ...]]]:
    """(text, features) of the page's blocks in order. Broken markup is read as far as it goes."""
    page = _Blocks()
    page.feed(html or "")
    page.finish()
    marked = any(main and furniture < 2 for *_, main, furniture in page.blocks)
    out, none = [], (None, 0, 0.0, 0, False, 0)
    around = [none, *page.blocks, none]
    for before, (text, n, links, kind, main, furniture), after in zip(around, page.blocks, around[2:]):
        place = (1 if main else -1) if marked else 0
        out.append((text, (n, links, before[1], before[2], after[1], after[2], place, furniture, kind)))
    return out


def main_text(html: str | None) -> str:
    model = tree()
    return " ".join(text for text, features in blocks(html) if predict_tree(model, features) >= 0.5)


def extract(pages: DataFrame, html: str = "html", result: str = "text") -> DataFrame:
    """The rows of ``pages`` without ``html``, with the page's main text in ``result``.

    White space inside a block becomes one space, blocks are joined by one space in page order. A page without main
    text, with NULL or with empty html gets an empty text. A column of the name of ``result`` gives way to it; other columns
    stay as they are. Rows are handled one by one, so repeated rows get equal results.
    """
    keep = [c for c in pages.columns if c not in (html, result)]
    picked = pages.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(html).cast("string").alias("html"))

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    out = picked.mapInArrow(run, with_columns(picked.schema["row"].dataType, text="string"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("text").alias(result))
