"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks. Each is described by its words, the
share of its words inside links, the same of its neighbours, and the kind of
element around it. The tree is trained, when the operator is built, on the
labelled table below. Pages are independent: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of HTML by what they do to the text around them.
SKIPPED = frozenset("script style noscript template title svg math iframe object textarea select button canvas audio video".split())
#: What an end tag has to follow, or else the rest of the page belongs to them.
RAW = frozenset("script style noscript textarea title".split())
#: Those that a further start tag of their kind ends.
UNNESTED = frozenset("button select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th fieldset details figure dialog menu".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption caption summary legend hr center head option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd".split())
#: Those that any start tag of a block ends.
ENDED_BY_BLOCKS = HEADINGS | {"p"}
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion reviews".split())
BOILER_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget footer header masthead cookie cookies consent gdpr notice alert popup modal overlay share sharing social "
    "related recommended newsletter subscribe subscription signup login search pagination pager toolbar legal copyright disclaimer".split()
)
#: Names that say so only alone or with other words of such elements: "legal" and "legal-notice", not "legal-analysis".
AMBIGUOUS_NAMES = frozenset(
    "legal copyright disclaimer notice alert cookie cookies consent search share sharing social related recommended promotion banner "
    "subscription overlay replies respond discussion reviews".split()
)
COMPANIONS = frozenset(
    "bar bars box boxes block list lists link links wrapper wrap container area section inner outer top bottom left right main site page primary "
    "secondary global button buttons form text item items panel row col icon icons tool tools media post posts article articles story stories news "
    "entry entries info header title body more".split()
)
#: Before such a word a name tells how the page is laid out, not what the element holds: "no-sidebar".
LAYOUT_WORDS = frozenset("no not non without with has have hide hides".split())
CONTENT_NAMES = frozenset("article content post entry story main maincontent articlebody".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())

BOILER, PLAIN, CONTENT = -1, 0, 1


@dataclass
class Block:
    """A run of text between block elements."""

    text: str
    words: int
    link_words: int
    zone: int
    heading: bool
    named: bool = False  # boilerplate by the name of an element around it, and by nothing else

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    open: list[tuple[str, int, bool]] = field(default_factory=list)  # tag, zone, whether a content element lifts it
    links: int = 0
    heading: bool = False
    muted: int = 0  # open spans from the outermost one with a boilerplate name on

    def zone(self) -> int:
        return self.open[-1][1] if self.open else PLAIN

    def add(self, text: str) -> None:
        if text and not self.muted:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.links:
                self.link_parts.append(text)

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                linked = len("".join(self.link_parts).split())
                named = bool(self.open) and self.open[-1][1:] == (BOILER, True)
                self.blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), self.zone(), self.heading, named))
            self.parts, self.link_parts = [], []

    def start(self, tag: str, attributes: str) -> None:
        self.muted = 0
        while self.open and (self.open[-1][0] in ENDED_BY_BLOCKS or tag in ITEMS and self.open[-1][0] in ITEMS):
            self.open.pop()
        self.heading = tag in HEADINGS
        if tag in CONTAINERS or tag in ENDED_BY_BLOCKS or tag in ITEMS:
            self.open.append((tag, *self._zone_of(tag, attributes)))

    def span(self, closing: bool, attributes: str) -> None:
        """A named span takes its own text out of the block; the block goes on behind it."""
        if self.muted:
            self.muted += -1 if closing else 1
        elif not closing and attributes:
            names, _, hidden = _named(attributes)
            self.muted = int(hidden or bool(names & BOILER_NAMES))

    def end(self, tag: str) -> None:
        self.heading, self.muted = False, 0
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def _zone_of(self, tag: str, attributes: str) -> tuple[int, bool]:
        around, liftable = self.open[-1][1:] if self.open else (PLAIN, True)
        names, role, hidden = _named(attributes) if attributes and tag not in ("html", "body") else (frozenset(), "", False)
        if hidden or names & COMMENT_NAMES or tag in BOILER_TAGS or role in BOILER_ROLES:
            return BOILER, False
        if around == BOILER and not (liftable and tag in CONTENT_TAGS and not names & BOILER_NAMES):
            return BOILER, liftable
        if names & BOILER_NAMES or tag == "header" and around != CONTENT:
            return BOILER, tag != "header"
        if tag in CONTENT_TAGS or names & CONTENT_NAMES or role in ("main", "article"):
            return CONTENT, True
        return around, liftable


def _named(attributes: str) -> tuple[frozenset[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    names: set[str] = set()
    role, hidden = "", False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for part in value.split():
                names.update(_telling(part))
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return frozenset(names), role, hidden


def _telling(part: str) -> set[str]:
    """One name of an element and its words, without those that tell nothing about what it holds."""
    words = [x.lower() for x in _NAME_PART.findall(part)]
    if LAYOUT_WORDS.intersection(words[:-1]):
        return set()
    found = {part.lower(), *words}
    if not all(w in BOILER_NAMES or w in COMPANIONS for w in words):
        found -= AMBIGUOUS_NAMES
    return found


def _skipped(source: str, at: int, tag: str, unclosed: set[str]) -> int:
    """Where the page goes on after a start tag of SKIPPED: behind its end tag, or right behind itself if it has none."""
    if tag in unclosed:
        return at
    begin = "(/?)" if tag in UNNESTED else "(/)"
    end = re.compile(rf"<{begin}{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
    if end is None and tag not in RAW:
        unclosed.add(tag)
        return at
    if end is None:
        return len(source)
    return end.end() if end[1] else at


def text_blocks(source: str) -> list[Block]:
    """The page's text blocks in their order. Markup that is not closed or not nested is taken as it comes."""
    page, at, n = _Page(), 0, len(source)
    unclosed: set[str] = set()
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            page.add(source[at:])
            break
        page.add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                at = _skipped(source, at, tag, unclosed)
        elif tag == "br":
            page.add(" ")
        elif tag == "a":
            page.links = 0 if closing else 1
        elif tag == "span":
            page.span(bool(closing), attributes)
        elif tag in BLOCKS:
            page.flush()
            if closing:
                page.end(tag)
            else:
                page.start(tag, attributes)
    page.flush()
    return page.blocks


FEATURES = ("words", "link_density", "zone", "zone_elsewhere", "previous_words", "previous_density", "next_words", "next_density", "heading")


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row per block. ``zone_elsewhere``: the page has a content element and this block is outside it."""
    words = np.array([0, *[b.words for b in blocks], 0], dtype=float)
    density = np.array([0, *[b.link_density for b in blocks], 0], dtype=float)
    zone = np.array([b.zone for b in blocks], dtype=float)
    elsewhere = (zone != CONTENT) & bool((zone == CONTENT).any())
    return np.column_stack(
        [words[1:-1], density[1:-1], zone, elsewhere, words[:-2], density[:-2], words[2:], density[2:], [b.heading for b in blocks]]
    )


# The labelled table. FEATURES in their order, then 1 for main text.
LABELLED = (
    # In menus, footers, sidebars, notices, forms, adverts and comments, whatever they hold.
    (1, 1.0, -1, 0, 0, 0.0, 1, 1.0, 0, 0), (3, 1.0, -1, 1, 2, 1.0, 3, 1.0, 0, 0), (7, 0.0, -1, 1, 1, 1.0, 12, 0.0, 0, 0),
    (12, 0.0, -1, 0, 40, 0.0, 0, 0.0, 0, 0), (60, 0.0, -1, 1, 80, 0.0, 0, 0.0, 0, 0), (150, 0.1, -1, 1, 90, 0.0, 120, 0.0, 0, 0),
    (25, 0.2, -1, 0, 30, 0.0, 5, 1.0, 0, 0), (2, 0.0, -1, 1, 200, 0.0, 30, 0.0, 1, 0), (35, 0.0, -1, 0, 2, 1.0, 60, 0.0, 0, 0),
    (300, 0.0, -1, 0, 0, 0.0, 0, 0.0, 0, 0), (18, 0.5, -1, 1, 20, 0.0, 4, 1.0, 0, 0),
    # In the article, down to a single word.
    (1, 0.0, 1, 0, 40, 0.0, 30, 0.0, 0, 1), (8, 0.0, 1, 0, 10, 0.0, 60, 0.0, 1, 1), (3, 0.0, 1, 0, 6, 0.0, 0, 0.0, 0, 1),
    (2, 1.0, 1, 0, 50, 0.0, 40, 0.0, 0, 1), (15, 0.3, 1, 0, 9, 0.0, 20, 0.1, 0, 1), (60, 0.0, 1, 0, 3, 1.0, 12, 0.0, 0, 1),
    (120, 0.1, 1, 0, 80, 0.0, 95, 0.0, 0, 1), (400, 0.0, 1, 0, 0, 0.0, 0, 0.0, 0, 1), (5, 0.0, 1, 0, 1, 1.0, 2, 1.0, 0, 1),
    (30, 0.6, 1, 0, 25, 0.0, 25, 0.0, 0, 1), (10, 0.9, 1, 0, 7, 1.0, 4, 1.0, 0, 1),
    # Outside the article of a page that has one.
    (4, 1.0, 0, 1, 3, 1.0, 3, 1.0, 0, 0), (9, 0.0, 0, 1, 60, 0.0, 0, 0.0, 0, 0), (40, 0.0, 0, 1, 5, 1.0, 70, 0.0, 0, 0),
    (90, 0.0, 0, 1, 70, 0.0, 50, 0.0, 0, 0), (2, 0.0, 0, 1, 0, 0.0, 30, 0.0, 1, 0), (25, 0.4, 0, 1, 80, 0.0, 80, 0.0, 0, 0),
    # Pages that name no article: link density first.
    (1, 1.0, 0, 0, 0, 0.0, 1, 1.0, 0, 0), (4, 1.0, 0, 0, 3, 1.0, 4, 1.0, 0, 0), (12, 0.8, 0, 0, 6, 1.0, 8, 0.9, 0, 0),
    (30, 0.6, 0, 0, 10, 0.8, 25, 0.5, 0, 0), (45, 0.5, 0, 0, 90, 0.0, 12, 0.7, 0, 0), (20, 0.9, 0, 0, 60, 0.0, 70, 0.0, 0, 0),
    (5, 0.6, 0, 0, 40, 0.0, 3, 1.0, 0, 0), (3, 1.0, 0, 0, 70, 0.0, 80, 0.0, 0, 0), (16, 0.5, 0, 0, 30, 0.1, 5, 0.5, 0, 0),
    # then length,
    (16, 0.0, 0, 0, 3, 1.0, 20, 0.0, 0, 1), (20, 0.0, 0, 0, 5, 0.0, 4, 0.0, 0, 1), (30, 0.1, 0, 0, 40, 0.0, 45, 0.0, 0, 1),
    (70, 0.2, 0, 0, 4, 1.0, 3, 1.0, 0, 1), (110, 0.0, 0, 0, 0, 0.0, 0, 0.0, 0, 1), (250, 0.05, 0, 0, 90, 0.0, 6, 1.0, 0, 1),
    (18, 0.2, 0, 0, 25, 0.0, 6, 0.0, 0, 1), (40, 0.3, 0, 0, 30, 0.0, 50, 0.0, 0, 1), (22, 0.0, 0, 0, 2, 0.0, 8, 0.0, 0, 1),
    # then the neighbours of short ones.
    (3, 0.0, 0, 0, 40, 0.0, 35, 0.0, 0, 1), (8, 0.0, 0, 0, 60, 0.1, 20, 0.0, 0, 1), (1, 0.0, 0, 0, 25, 0.0, 90, 0.0, 0, 1),
    (12, 0.1, 0, 0, 18, 0.0, 22, 0.0, 0, 1), (6, 0.0, 0, 0, 16, 0.0, 16, 0.0, 1, 1), (5, 0.0, 0, 0, 2, 1.0, 60, 0.0, 1, 1),
    (9, 0.0, 0, 0, 0, 0.0, 30, 0.0, 1, 1), (4, 0.0, 0, 0, 6, 0.0, 18, 0.0, 1, 1), (7, 0.0, 0, 0, 3, 1.0, 90, 0.1, 1, 1),
    (6, 0.0, 0, 0, 3, 1.0, 4, 1.0, 0, 0), (9, 0.0, 0, 0, 80, 0.0, 0, 0.0, 0, 0), (2, 0.0, 0, 0, 1, 1.0, 5, 0.0, 0, 0),
    (11, 0.0, 0, 0, 5, 0.0, 7, 0.0, 0, 0), (5, 0.0, 0, 0, 30, 0.0, 4, 1.0, 0, 0), (8, 0.0, 0, 0, 4, 0.0, 60, 0.0, 0, 0),
    (3, 0.0, 0, 0, 0, 0.0, 2, 1.0, 1, 0), (4, 0.0, 0, 0, 50, 0.0, 3, 1.0, 1, 0), (10, 0.2, 0, 0, 9, 0.0, 3, 0.0, 0, 0),
)


Tree = tuple  # (label,) or (feature, limit, tree up to the limit, tree beyond it)


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Tree:
    """A binary tree by Gini impurity; each limit lies midway between two values. Ties take the first feature and limit."""
    share = labels.mean() if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (int(share >= 0.5),)
    best = (1e9, 0, 0.0)
    for feature_at in range(rows.shape[1]):
        values = np.unique(rows[:, feature_at])
        for limit in (values[1:] + values[:-1]) / 2:
            left = rows[:, feature_at] <= limit
            cost = sum(side.sum() * labels[side].mean() * (1 - labels[side].mean()) for side in (left, ~left))
            if cost < best[0] - 1e-12:
                best = (cost, feature_at, float(limit))
    if best[0] == 1e9:
        return (int(share >= 0.5),)
    left = rows[:, best[1]] <= best[2]
    return best[1], best[2], train_tree(rows[left], labels[left], depth - 1), train_tree(rows[~left], labels[~left], depth - 1)


def default_tree() -> Tree:
    table = np.array(LABELLED, dtype=float)
    return train_tree(table[:, :-1], table[:, -1])


def classify(tree: Tree, row: list[float]) -> bool:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree[0])


def main_text(source: str | None, tree: Tree) -> str:
    """The main blocks of one page, joined by line feeds. Null and empty pages have none."""
    blocks = text_blocks(source) if source else []
    if not blocks:
        return ""
    found = _main_blocks(blocks, tree)
    if not found and sum(b.words - b.link_words for b in blocks if b.named) >= WRAPPED_WORDS:
        found = _main_blocks([replace(b, zone=PLAIN) if b.named else b for b in blocks], tree)
    return "\n".join(b.text for b in found)


#: So many words, not in links, are no boilerplate by the name around them alone if the page has no other main text.
WRAPPED_WORDS = 100


def _main_blocks(blocks: list[Block], tree: Tree) -> list[Block]:
    return [b for b, row in zip(blocks, block_features(blocks).tolist(), strict=True) if classify(tree, row)]


def extract(pages: DataFrame, tree: Tree | None = None, source: str = "html") -> DataFrame:
    """``pages`` with ``source`` replaced by ``text``, the page's main text. Repeated rows each stay; other columns too."""
    ship(pages.sparkSession)
    tree = tree or default_tree()
    base = pages.drop("text") if source != "text" else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            names = ["text" if i == at else n for i, n in enumerate(batch.schema.names)]
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = pa.array([main_text(p, tree) for p in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], names=names)

    types = ", ".join(f"`{'text' if f.name == source else f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, types)


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page its main text and the code points of it."""
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
