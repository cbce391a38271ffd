"""Main text of HTML pages by tag-path ratios, in one pass per page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import bound_batches

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math canvas iframe object audio video select option button textarea input form datalist dialog".split())
MARGIN = frozenset("nav footer aside menu".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that mark page furniture as a whole class, id or role value, and as the last word of a compound one.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs captcha comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion replies respond search shoutbox sidebar signup skip sponsor sponsored subscribe subscription topbar".split())
#: The same, unless a word of BODY_WORDS stands beside them.
LOOSE = frozenset("banner dialog header related reply share sharing social tabs toolbar widget widgets".split())
#: Furniture that can hold more text than the article.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
BODY_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
LAYOUT = frozenset("has no with without".split())
#: First words of compound names that say what an article is about or what state it is in.
ABOUT = frozenset("author cat category format is section status tag term topic type".split())
#: Last words of compound names that say that an element is a box for what the first word names.
BOXES = frozenset("area badge banner bar block body box btn button buttons card cell col column container content form frame group heading holder icon inner inside item items label layer link links list lists message module nav outer overlay pane panel region row section slot strip thread title top unit widget wrap wrapper zone".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCT = re.compile(r"[.,;:!?…\"'»«”“()。、，！？；：]")


def _named(name: str) -> int:
    """How surely a class, id or role value marks furniture: 0 not, 1 by a part of a compound name, 2 by all of it
    or as comments."""
    words = [x.lower() for x in _TOKEN.findall(name)]
    if not words or LAYOUT & {*words}:
        return 0
    if len(words) == 1:
        return 2 * (words[0] in FURNITURE or words[0] in LOOSE)
    first, last = words[0], words[-1]
    about = first in ABOUT
    hit = last in FURNITURE and not about or first in FURNITURE and {*words[1:]} <= BOXES | FURNITURE | LOOSE | BODY_WORDS
    if not hit and not BODY_WORDS & {*words}:
        hit = last in LOOSE and not about or first in LOOSE and {*words[1:]} <= BOXES | FURNITURE | LOOSE
    return hit and (2 if COMMENTS & {first, last} or {*words} <= FURNITURE | LOOSE else 1)


def _marks(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool, bool]:
    """How surely an element's attributes mark it as furniture, and whether as hidden and as the place of the main text.
    A compound name doesn't outweigh an element, or another name, that says that the main text is here."""
    furniture, hidden, main = 0, False, tag in ("article", "main")
    for k, v in attrs:
        v = v or ""
        if k in ("class", "id", "role"):
            for name in v.split():
                words = {x.lower() for x in _TOKEN.findall(name)}
                furniture = max(furniture, _named(name))
                main |= bool(words) and words <= BODY_WORDS and k != "role" or (k == "role" and name.lower() in ("main", "article"))
        elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)):
            hidden = True
    if furniture == 1 and main:
        furniture = 0
    return furniture, hidden, main and not furniture


#: Elements that hold parts of a page; a table cell does if its text stands in elements of its own.
SECTIONS = frozenset("html body div section article main center table".split())


#: Elements below this depth don't enter a path, as in browsers; their text does count.
DEEPEST = 512


@dataclass
class _Block:
    path: tuple[str, ...]
    nodes: tuple[int, ...]  # the elements of the path by their number on the page
    heading: bool
    under: tuple[int, ...] = ()  # elements around it whose compound names mark furniture
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Reader(HTMLParser):
    """Blocks of visible text with their tag paths. Inline elements don't enter a path; a block ends where a
    block-level element begins or ends, or at a line break."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Tag; whether its text is dropped; its name in paths; its number; elements down to it named as furniture.
        self.stack: list[tuple[str, bool, str, int, tuple[int, ...]]] = []
        self.count = 0
        self.links = 0
        self.held: Counter[str] = Counter()  # open elements by tag
        self.articles = 0
        self.blocks: list[_Block] = []
        self.open: _Block | None = None

    def _cut(self) -> None:
        if self.open and self.open.text:
            self.blocks.append(self.open)
        self.open = None

    def _pop(self, at: int) -> None:
        gone = self.stack[at:]
        del self.stack[at:]
        self.held.subtract(t[0] for t in gone)
        self.links -= sum(t[0] == "a" for t in gone)
        self.articles -= sum(t[2] in ("article", "main") for t in gone)
        if any(t[0] not in INLINE for t in gone):
            self._cut()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self._cut() if tag == "hr" else self._space()
            return
        if tag in CLOSES_P and self.held["p"]:
            at = len(self.stack) - 1
            while at >= 0 and self.stack[at][0] in INLINE:
                at -= 1
            if at >= 0 and self.stack[at][0] == "p":
                self._pop(at)
        if tag in SELF_CLOSES and any(self.held[x] for x in SELF_CLOSES[tag][0].split()):
            ends, scope = SELF_CLOSES[tag]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in scope:
                    break
                if self.stack[i][0] in ends.split():
                    self._pop(i)
                    break
        furniture, hidden, main = _marks(tag, attrs) if attrs else (0, False, False)
        top = self.stack[-1] if self.stack else ("", False, "", 0, ())
        margin = tag in MARGIN or (tag == "header" and not self.articles)
        page = tag in ("html", "body", "main")
        drop = top[1] or (not page and (tag in HIDDEN or margin or hidden or furniture == 2))
        if tag not in INLINE:
            self._cut()
        self.links += tag == "a"
        self.count += 1
        name = "main" if main and tag not in INLINE and tag not in ("p", "html", "body") else tag
        self.stack.append((tag, drop, name, self.count, (*top[4], self.count) if furniture == 1 and not page else top[4]))
        self.held[tag] += 1
        self.articles += name in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.held[tag]:
            if tag == "p":
                self._cut()
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def _space(self) -> None:
        if self.open:
            self.open.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        if self.open is None:
            if not data.strip():
                return
            around = [x for x in self.stack[:DEEPEST] if x[0] not in INLINE]
            path = tuple(x[2] for x in around)
            self.open = _Block(path, tuple(x[3] for x in around), bool(path) and path[-1] in HEADINGS, self.stack[-1][4] if self.stack else ())
        self.open.parts.append(data)
        if self.links:
            self.open.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...>`` of any kind is skipped, as browsers do; the base class refuses unknown ones."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        super().close()
        self._cut()


def _section(b: _Block) -> tuple[int, ...]:
    """The elements down to the innermost part of the page that a block stands in."""
    at = len(b.path)
    while at and b.path[at - 1] not in SECTIONS and not (b.path[at - 1] in ("td", "th") and at < len(b.path)):
        at -= 1
    return b.nodes[:at]


def _common(sections: set[tuple[int, ...]]) -> tuple[int, ...]:
    lo, hi = min(sections), max(sections)
    n = next((i for i, (x, y) in enumerate(zip(lo, hi, strict=False)) if x != y), min(len(lo), len(hi)))
    return lo[:n]


def _smoothed(names: list[tuple[str, ...]], sums: np.ndarray, smooth: float) -> np.ndarray:
    """``sums`` of all paths, weighted by exp(-smooth (1 - likeness)). The likeness of two paths is the share of the
    longer one that they have in common from the root. In sorted order that is the least of what neighbours between
    them have in common, so a row costs a running minimum, whatever the depth."""
    order = sorted(range(len(names)), key=names.__getitem__)
    paths = [names[i] for i in order]
    common = [next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(paths, paths[1:], strict=False)]
    beside, size, own = np.array(common, dtype=np.float64), np.array([max(len(p), 1) for p in paths], dtype=np.float64), sums[order]
    out = np.zeros_like(sums, dtype=np.float64)
    for i in range(len(paths)):
        same = np.concatenate((np.minimum.accumulate(beside[:i][::-1])[::-1], [size[i]], np.minimum.accumulate(beside[i:])))
        out[order[i]] = np.exp(-smooth * (1 - same / np.maximum(size, size[i]))) @ own
    return out


def _host(path: tuple[str, ...]) -> tuple[str, ...] | None:
    """The path of the outermost article or main element that a path runs through."""
    return next((path[: i + 1] for i, x in enumerate(path) if x in ("article", "main")), None)


def _without_furniture(blocks: list[tuple[_Block, str]]) -> list[tuple[_Block, str]]:
    """Blocks that stand in no element whose compound name marks furniture. A name is wrong about an element that holds
    most of the page's text outside links."""
    held: Counter[int] = Counter()
    for b, t in blocks:
        for e in b.under:
            held[e] += max(0, len(t) - b.linked)
    whole = sum(max(0, len(t) - b.linked) for b, t in blocks)
    return [(b, t) for b, t in blocks if all(2 * held[e] > whole for e in b.under)]


def main_text(html: str | None, smooth: float = 8.0, threshold: float = 0.5, within: float = 0.02, host_share: float = 0.1) -> str:
    """The article of a page; blocks in page order joined by two newlines.

    Text is summed per root-to-leaf tag path: characters outside links per block, and punctuation marks per
    block. Both ratios are smoothed over the paths by the share of the path that they have in common, fused by
    their geometric mean, and paths whose value reaches ``threshold`` times the page's text-weighted mean are
    content; headings beside content paths come with them. Menus, forms, hidden and furniture elements are cut
    before; where a compound name alone speaks for furniture, not if the element is an article, is named as one or
    holds most of the page's text. Elements below the 512th around a block don't count for its path or for what comes
    with it. Everything else below the innermost element around all content comes with it (lists, tables,
    definitions, captions), paths of nothing but links excepted unless an article has them. Where the ``article`` or ``main`` elements of one path hold ``host_share`` of the page's text or more,
    ``within`` times the threshold is enough for the paths below them, and each such element is kept as a whole;
    paths elsewhere are judged as on any page, and what comes with them ends before such an element.
    """
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    blocks = _without_furniture([(b, b.text) for b in reader.blocks])
    if not blocks:
        return ""
    paths: dict[tuple[str, ...], list[float]] = {}
    for b, t in blocks:
        own = max(0, len(t) - b.linked)
        x = paths.setdefault(b.path, [0.0, 0.0, 0.0])
        x[0] += own
        x[1] += len(_PUNCT.findall(t)) if own * 2 >= len(t) else 0
        x[2] += 1
    names = list(paths)
    if len(names) == 1:
        return "\n\n".join(t for _, t in blocks)
    sums = np.array([paths[p] for p in names])
    text, marks, mass = _smoothed(names, sums, smooth).T
    text_ratio, mark_ratio = text / mass, (marks + 0.5 * mass) / mass
    fused = np.sqrt(text_ratio * mark_ratio)
    level = float((fused * sums[:, 0]).sum() / max(sums[:, 0].sum(), 1))
    held: dict[tuple[str, ...] | None, float] = {}
    for p in names:
        held[_host(p)] = held.get(_host(p), 0.0) + paths[p][0]
    hosts = {h for h, own in held.items() if h and own >= host_share * sum(held.values())}
    good = {p for p, v in zip(names, fused, strict=True) if v >= threshold * level * (within if _host(p) in hosts else 1.0) and paths[p][0] > 0}
    parents = {p[:-1] for p in good}
    good |= {p for p in names if p and p[-1] in HEADINGS and p[:-1] in parents and paths[p][0] > 0}
    marked = {b.nodes[: len(_host(b.path))] for b, _ in blocks if b.path in good and _host(b.path) in hosts}
    around = {_section(b) for b, _ in blocks if b.path in good and b.nodes[: len(_host(b.path) or ())] not in marked}
    if around and not any(m[: len(top)] == top for top in [_common(around)] for m in marked):
        around = {_common(around)}
    around = {a for a in around if not any(m[: len(a)] == a for m in marked)} | marked
    tops, stories = {a[-1] if a else 0 for a in around}, {m[-1] for m in marked}
    return "\n\n".join(t for b, t in blocks if b.path in good or (paths[b.path][0] > 0 and not tops.isdisjoint((0, *b.nodes))) or not stories.isdisjoint(b.nodes))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) from the whole html; a null page gives empty text.

    Columns of those names are replaced, others and repeated rows stay. Broken markup is read as browsers do where
    it matters: unclosed paragraphs, list items and inline elements end where the next block begins, declarations of
    any kind are skipped. Very long and very deep pages are read whole. An empty table gives an empty result."""
    bound_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(h if isinstance(h, str) else None) for h in s], dtype=object)

    out = pages.drop("text", "n_chars").withColumn("text", text(F.col(html_col)))
    return out.withColumn("n_chars", F.length("text").cast("long"))
