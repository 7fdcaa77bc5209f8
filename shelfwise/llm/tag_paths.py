"""Main text of web pages: ratios of text and punctuation by tag path choose the nodes that hold content."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import map_slices

# a quote opens a value only after an equals sign; without its end it is a character like others
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

# fixed values: elements of the HTML standard, by how they are read
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form select".split())
# what isn't the article, by element; what may not be, by a word of its class, id or role
OUTSIDE = frozenset("nav header footer aside form button select dialog svg math object video audio canvas menu head".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie "
    "cookies consent dialog disqus footer header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promoted related replies search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)
ARTICLE = frozenset("article main".split())
UNMARKED = frozenset("html body article main".split())
# words that tell that an element with an outside word in its names lays out the page, and isn't that part itself
LAYOUT_WORDS = frozenset("article body content entry has layout main no page post story with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Open(NamedTuple):
    """An open element. `node` and `path` number its nearest block element and the path of that, `mark` the innermost
    element with an outside word that it stands in, `scope` the place of the innermost open element that closing tags
    don't reach beyond; `article` is the outermost article node, -1 outside."""

    name: str = ""
    node: int = 0
    path: int = 0
    mark: int = 0
    scope: int = -1
    article: int = -1
    outside: bool = False
    link: bool = False


@dataclass
class Block:
    """Text between two block borders; `under` is the element it begins in, and each part has the mark of the innermost
    element around it and whether it stands in a link."""

    under: Open
    parts: list[tuple[str, int, bool]] = field(default_factory=list)
    value: str = ""
    links: int = 0


@dataclass
class Page:
    """Blocks in page order; of each node the one around it and its name; of each mark the one around it, and whether
    its names say nothing else (`alone`). The first node and mark stand for the page."""

    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    marks: list[tuple[int, bool]] = field(default_factory=lambda: [(0, False)])


@dataclass(frozen=True)
class Weights:
    """Ratios are smoothed over the blocks within `reach`, and those under an article count `article` times. A path is
    content if its fused ratio reaches `share` of the mean by text. The deepest node with `most` of the text of such
    paths is content with all it holds, but lists with `linked` of their text in links."""

    reach: int = 1
    share: float = 0.25
    article: float = 1.5
    most: float = 0.8
    linked: float = 0.8


def _outside_word(attributes: str) -> bool | None:
    """None if no name in the class, id or role has an outside word; else whether they say nothing of the layout."""
    names = [v.strip("\"'").lower().split() for k, v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role")]
    words = {word for some in names for x in some for word in re.split(r"[^a-z]+", x)}
    return not words & LAYOUT_WORDS if words & OUTSIDE_WORDS else None


def parse(page: str) -> Page:
    """Blocks of text in page order with their nodes and paths; raw text, markup and comments are gone. Linear in the
    page: an element knows its scope, and a name the places where it is open."""
    out = Page()
    root = Open()
    elements = [root]  # by node
    stack: list[Open] = []
    places: dict[str, list[int]] = {}
    paths: dict[tuple[int, str], int] = {}
    current: Block | None = None
    at = 0

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        top = stack[-1] if stack else root
        if current is None:
            current = Block(elements[top.node])
            out.blocks.append(current)
        current.parts.append((raw, top.mark, top.link))

    def close_to(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().name].pop()

    def innermost(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not name:
            continue
        if name not in INLINE:
            current = None
        scope = stack[-1].scope if stack else -1
        if closing:
            place = innermost([name])
            if place >= 0 and (place >= scope or not (name in INLINE or name in ("p", "li"))):
                close_to(place)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        place = innermost(CLOSES.get(name) or ({"p"} if name in CLOSES_P else ()))
        if place > scope:
            close_to(place)
        if name in VOID or m[0].endswith("/>"):
            continue
        above = stack[-1] if stack else root
        outside, mark = above.outside or name in OUTSIDE, above.mark
        # a header inside the article heads the article
        if name == "header" and above.article >= 0 and not above.outside:
            outside = False
        elif name == "main":
            mark = 0
        elif name not in UNMARKED and (alone := _outside_word(m[3])) is not None:
            out.marks.append((mark, alone))
            mark = len(out.marks) - 1
        place = len(stack)
        scope = place if name in SCOPE else above.scope
        places.setdefault(name, []).append(place)
        link = above.link or name == "a"
        if name in INLINE:
            stack.append(Open(name, above.node, above.path, mark, scope, above.article, outside, link))
            continue
        node = len(out.parents)
        path = paths.setdefault((above.path, name), len(paths) + 1)
        article = node if above.article < 0 and name in ARTICLE and not outside else above.article
        opened = Open(name, node, path, mark, scope, article, outside, link)
        out.parents.append(above.node)
        out.names.append(name)
        elements.append(opened)
        stack.append(opened)
    return out


def _smoothed(values: np.ndarray, reach: int) -> np.ndarray:
    """Mean over neighbours, nearer ones counting more."""
    weights = np.array([reach + 1 - abs(i) for i in range(-reach, reach + 1)], float)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, weights / weights.sum(), "valid")


def _up(values: np.ndarray, parents: list[int]) -> np.ndarray:
    """Sums over the nodes below each node and itself; a node stands behind the one around it."""
    values = values.copy()
    for node in range(len(parents) - 1, 0, -1):
        values[parents[node]] += values[node]
    return values


def _levels(inside: list[Block], marks: list[tuple[int, bool]]) -> list[int]:
    """Of each mark: 2 if its names or some around say that it isn't the article, 1 if they speak of the layout too. Of
    the latter, 0 if it holds most of the text."""
    held = np.zeros(len(marks), np.int64)
    for block in inside:
        for raw, mark, _ in block.parts:
            held[mark] += len(raw.strip())
    total = held.sum()
    held = _up(held, [around for around, _ in marks])
    levels = [0] * len(marks)
    for mark, (around, alone) in enumerate(marks[1:], 1):
        own = 2 if alone else int(2 * held[mark] <= total)
        levels[mark] = max(own, levels[around])
    return levels


def _readable(page: Page) -> list[Block]:
    """Blocks outside of what elements and names rule out. Where no prose is left, names rule less out."""
    inside = [b for b in page.blocks if not b.under.outside]
    levels = _levels(inside, page.marks)
    found: list[tuple[int, Block]] = []
    for block in inside:
        level = levels[block.under.mark]
        # what only an inline element marks is left out
        parts = [(raw, link) for raw, mark, link in block.parts if levels[mark] <= level]
        block.value = SPACE.sub(" ", html.unescape("".join(raw for raw, _ in parts))).strip()
        block.links = sum(len(raw.strip()) for raw, link in parts if link)
        if block.value:
            found.append((level, block))

    def prose(block: Block) -> bool:
        some = len(block.value) >= 20 and PUNCTUATION.search(block.value) is not None and block.under.name not in HEADINGS
        return (some or block.under.article >= 0) and 2 * block.links < len(block.value)

    least = min((k for k, b in found if prose(b)), default=min((k for k, _ in found), default=0))
    return [b for k, b in found if k <= least]


def content(page: str | None, weights: Weights = Weights()) -> list[str]:
    """The blocks of the main text. By tag path: characters for each block and punctuation marks for each character,
    smoothed in page order and fused into one ratio, in which an article weighs more. Paths reaching the threshold are
    content. The ratio then goes up the nodes: articles with text of such paths, or else the deepest node with most of
    it, keep their short blocks too, but no lists of links; so do headings before other text of such paths. Names with
    outside words never win while there is unmarked prose, however long they are."""
    tree = parse(page or "")
    found = _readable(tree)
    if not found:
        return []
    nodes = np.array([b.under.node for b in found])
    size = np.array([len(b.value) for b in found], float)
    width = len(tree.parents)
    links = np.array([min(b.links, len(b.value)) for b in found], float)
    text_of = _up(np.bincount(nodes, size, width), tree.parents)
    lists = _up(np.bincount(nodes, links, width), tree.parents) >= weights.linked * text_of
    lists &= _up(np.bincount(nodes, minlength=width), tree.parents) >= 2
    lists[0] = False
    for node in range(1, width):
        lists[node] = (lists[node] and tree.names[node] not in UNMARKED) or lists[tree.parents[node]]
    listed = lists[nodes]
    if listed.all():
        listed[:] = False

    which = np.unique([b.under.path for b in found], return_inverse=True)[1]
    marks = np.array([len(PUNCTUATION.findall(b.value)) for b in found], float)
    text_ratio = (np.bincount(which, size) / np.bincount(which))[which]
    mark_ratio = (np.bincount(which, marks) / np.bincount(which, size))[which]
    fused = _smoothed(text_ratio, weights.reach) * _smoothed(mark_ratio, weights.reach)
    article = np.array([b.under.article for b in found])
    fused *= np.where(article >= 0, weights.article, 1.0)
    by_path = np.bincount(which, fused * size) / np.bincount(which, size)
    usual = ~listed
    threshold = weights.share * (by_path[which] * size)[usual].sum() / size[usual].sum()
    chosen = (by_path[which] >= threshold) & usual

    seeds = np.where(chosen, size, 0.0)
    total = seeds.sum()
    heading = np.array([b.under.name in HEADINGS for b in found])
    places = np.arange(len(found))
    first, last = np.flatnonzero(chosen)[[0, -1]]
    inside = _up(np.bincount(nodes, seeds, width), tree.parents)
    if 2 * seeds[article >= 0].sum() >= total:
        # articles as whole, each with a part of its text on chosen paths
        chosen |= (article >= 0) & (inside[article] > 0) & usual
    else:
        most = int(np.flatnonzero(inside >= weights.most * total)[-1])
        within = np.zeros(width, bool)
        within[most] = True
        for node in range(most + 1, width):
            within[node] = within[tree.parents[node]]
        bare = tree.names[most] in ("", "html", "body")
        chosen |= within[nodes] & usual & (~np.bool_(bare) | ((places >= first) & (places <= last)))
    # headings between chosen blocks belong to them
    chosen |= heading & usual & (places >= first - 1) & (places <= last)
    return [b.value for b, keep in zip(found, chosen, strict=True) if keep]


def extract(pages: DataFrame, html_column: str = "html", weights: Weights = Weights()) -> DataFrame:
    """(row, text): each row as it came and the main text of its whole html, blocks joined by line feeds.

    Null and empty pages, and pages without content, give an empty text. Rows are independent: repeated ones give the
    same, an empty table gives an empty one, other columns stay inside `row` whatever their names, and nothing is
    shuffled. Long and deep pages take time and memory in proportion to their size."""
    rows = pages.select(F.struct("*").alias("row"), F.col(html_column).alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["\n".join(content(x, weights)) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return map_slices(rows, "html", run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
