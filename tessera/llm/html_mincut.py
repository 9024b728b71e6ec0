"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks at block-level tags; inline tags and ``br`` don't cut.
A linear classifier on each block gives the two costs of calling it content or
boilerplate; they are the capacities to source and sink. It takes words, link
density, headings, whether the text ends as a sentence does, elements that say
what they hold (``nav``, ``article``), and names: a class, id or role that consists
of boilerplate words says as much, one that only contains such a word
(``menu-of-the-day``) says little. Neighbours in page order and blocks of the same
parent (DOM proximity) are tied by smoothness edges, which are of the size of the
costs of a short block: titles, bylines and single lines go with what they stand in.
The minimum cut, found by max-flow, labels the blocks; content blocks are joined in
page order.

Scripts, styles, comments, forms' fields and everything in ``head`` have no
blocks. Elements that aren't shown (a ``hidden`` attribute, ``aria-hidden``, an inline
style) are boilerplate, and so is a form, unless it holds half of the page's text or
more: then it wraps the page. Character references are decoded after markup is removed; white space in
a block becomes one space. Unclosed and stray tags are tolerated.

Nulls: a null html is an empty one and gives empty text. Empty pages give empty
text. Repeated rows give equal rows. Very long pages are read whole, in time
linear in their length but for the cut, whose undecided blocks are few. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by role.
RAW = "script style noscript template textarea select iframe object svg canvas audio video head"
BLOCKS = "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
VOID = "area base br col embed hr img input link meta param source track wbr"
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOILERPLATE_TAGS = "nav footer aside menu dialog button"
CONTENT_TAGS = "article main"
#: Words of class, id and role that name a zone.
BOILERPLATE_WORDS = "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup popular privacy promo promoted promotion recommended related reply replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags taboola teaser toolbar topbar warning widget"
CONTENT_WORDS = "article body content entry main post story text"
#: Words that name no content of their own beside a boilerplate word.
NEUTRAL_WORDS = "area bar block bottom box btn button buttons center col column container div external extra first form global group head hidden icon icons id inline inner item items js label large last left line link links list lists mid middle mobile module nd outer page pane panel primary right row secondary section site slot small space sticky text the tile title top unit view wrap wrapper zone"

RAW_SET, BLOCK_SET, VOID_SET = set(RAW.split()), set(BLOCKS.split()), set(VOID.split())
BAD_TAGS, GOOD_TAGS = set(BOILERPLATE_TAGS.split()), set(CONTENT_TAGS.split())
BAD_WORDS, GOOD_WORDS, NEUTRAL = set(BOILERPLATE_WORDS.split()), set(CONTENT_WORDS.split()), set(NEUTRAL_WORDS.split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
WORDS = re.compile(r"[a-z]+")

#: The linear classifier (log odds of content) and the smoothness edges.
BASE, ZONE_BAD, ZONE_GOOD, HINT_BAD, HINT_GOOD = -0.9, -6.0, 2.5, -1.0, 1.0
PER_WORD, MOST_WORDS, LINKS, HEADING, SENTENCE = 0.1, 40, -4.5, 0.5, 0.6
NEXT, SIBLING, STRANGER = 1.2, 1.0, 0.3
ENDS = tuple(".!?…:;\"'”’»)")


@dataclass
class Zone:
    """What the elements around a block say: content, boilerplate, and names that hint at either."""

    good: bool = False
    bad: bool = False
    hint_good: bool = False
    hint_bad: bool = False
    form: int = 0  # the outermost form around the block


@dataclass
class Block:
    text: str
    links: float
    heading: bool
    zone: Zone
    parent: int


@dataclass
class _Open:
    tag: str
    node: int
    zone: Zone


def attributes_of(text: str) -> dict[str, str]:
    """Names, lower-cased, and values of a start tag's attributes; of a repeated name the first."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _unseen(attributes: dict[str, str]) -> bool:
    """An element that isn't shown: by its own attributes, not by words in their values."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(attributes.get("style", "")))


def _zone(tag: str, text: str, outer: Zone, node: int) -> Zone:
    """The zone inside an element; boilerplate stays so inside."""
    inside = outer.good or tag in GOOD_TAGS
    zone = Zone(inside, outer.bad or tag in BAD_TAGS or tag == "header" and not outer.good, outer.hint_good, outer.hint_bad, outer.form or (node if tag == "form" else 0))
    if text and tag not in ("body", "html"):
        attributes = attributes_of(text)
        for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().split():
            words = set(WORDS.findall(name))
            bad, good = words & BAD_WORDS, words & GOOD_WORDS
            if bad and not (good and bad == {"header"}):
                if words <= BAD_WORDS | NEUTRAL | GOOD_WORDS and tag not in GOOD_TAGS and tag != "form":
                    zone.bad = True
                else:
                    zone.hint_bad = True
            elif good:
                zone.hint_good = True
        zone.bad = zone.bad or _unseen(attributes)
    return zone


def _without_forms(blocks: list[Block]) -> list[Block]:
    """Calls blocks in a form boilerplate, but for a form that holds at least half of the page's text outside of boilerplate."""
    held: dict[int, int] = {}
    for b in blocks:
        if not b.zone.bad:
            held[b.zone.form] = held.get(b.zone.form, 0) + len(b.text)
    small = {form for form, n in held.items() if form and 2 * n < sum(held.values())}
    return [replace(b, zone=replace(b.zone, bad=True)) if b.zone.form in small else b for b in blocks] if small else blocks


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [_Open("", 0, Zone())]
    nodes, in_link, link_chars, pos = 1, 0, 0, 0
    parts: list[str] = []

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                out.append(Block(text, min(1.0, link_chars / len(text)), len(top.tag) == 2 and top.tag[0] == "h" and top.tag[1].isdigit(), top.zone, stack[-2].node if len(stack) > 1 else 0))
        link_chars = 0

    def add(piece: str) -> None:
        nonlocal link_chars
        parts.append(piece)
        if in_link:
            link_chars += len(piece)

    end = len(page)
    while pos < end:
        m = TOKEN.search(page, pos)
        if not m:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            if m[0] == "<":
                add("<")
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW_SET:
            if not closing and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(page, pos)
                pos = close.end() if close else (pos if tag == "head" else end)
            continue
        if tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        elif tag == "br":
            add(" ")
        elif tag in BLOCK_SET:
            flush()
            in_link = 0
            if tag in VOID_SET:
                continue
            if closing:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if at:
                    del stack[at:]
                continue
            if tag in CLOSED_BY:
                while len(stack) > 1 and stack[-1].tag in CLOSED_BY[tag]:
                    stack.pop()
            elif stack[-1].tag == "p":
                stack.pop()
            stack.append(_Open(tag, nodes, _zone(tag, m[3], stack[-1].zone, nodes)))
            nodes += 1
    flush()
    return _without_forms(out)


def log_odds(b: Block) -> float:
    words, z = min(MOST_WORDS, b.text.count(" ") + 1), b.zone
    named = ZONE_GOOD * z.good + ZONE_BAD * z.bad + HINT_GOOD * z.hint_good + HINT_BAD * z.hint_bad
    return BASE + PER_WORD * words + named + LINKS * b.links + HEADING * b.heading + SENTENCE * b.text.endswith(ENDS)


def ties_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: neighbours in page order, weak where their parents or zones differ, and each block with the last one of its parent."""
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            ties[i - 1, i] = NEXT if blocks[i - 1].parent == b.parent and blocks[i - 1].zone == b.zone else STRANGER
        if (j := last.get(b.parent)) is not None:
            ties[j, i] = ties.get((j, i), 0.0) + SIBLING
        last[b.parent] = i
    return ties


def minimum_cut(gain: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """True for nodes on the source side of the minimum cut: ``gain`` is the capacity from the source (or, negative, to the sink).

    A node whose terminal capacity is at least the sum of its ties stands on that
    side in some minimum cut; such nodes are fixed first and their ties become
    terminal capacities of their neighbours. Max-flow decides the rest.
    """
    n = len(gain)
    gain, near = list(gain), [dict() for _ in range(n)]
    for (i, j), c in ties.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(gain[i]) >= sum(near[i].values()):
            side[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if side[i] else -c
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        reached = _max_flow(rest, gain, near)
        for i in rest:
            side[i] = i in reached
    return [bool(s) for s in side]


def _max_flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches when no augmenting path is left (shortest paths first)."""
    free = {i: dict(near[i]) for i in rest}
    source = {i: gain[i] for i in rest if gain[i] > 0}
    sink = {i: -gain[i] for i in rest if gain[i] < 0}
    while True:
        came: dict[int, int | None] = {i: None for i, c in source.items() if c > 1e-12}
        queue, found = deque(came), None
        while queue and found is None:
            i = queue.popleft()
            if sink.get(i, 0.0) > 1e-12:
                found = i
                break
            for j, c in free[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if found is None:
            return set(came)
        path = [found]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        flow = min([source[path[0]], sink[found], *(free[a][b] for a, b in zip(path, path[1:]))])
        source[path[0]] -= flow
        sink[found] -= flow
        for a, b in zip(path, path[1:]):
            free[a][b] -= flow
            free[b][a] = free[b].get(a, 0.0) + flow


def extract(page: str | None) -> str:
    blocks = blocks_of(page or "")
    content = minimum_cut([log_odds(b) for b in blocks], ties_of(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, content) if keep)


def moved_by_cut(page: str | None) -> tuple[int, int]:
    """(blocks, labels that the cut gives against the sign of the classifier)."""
    blocks = blocks_of(page or "")
    gains = [log_odds(b) for b in blocks]
    return len(blocks), sum(keep != (g > 0) for keep, g in zip(minimum_cut(gains, ties_of(blocks)), gains))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h) for h in html], dtype=object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
