"""Main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, an element whose text is none of the page's (scripts, styles, parts of forms, what
#: stands in for media), or a tag; the rest is text.
PARTS = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template|svg|iframe|textarea|select|title|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)"
)
NAMES = re.compile(r"""(?is)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HIDDEN = re.compile(r"""(?is)(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head caption option label button".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements whose text is no article text, wherever they stand.
AWAY = frozenset("nav footer aside form button menu dialog label option head fieldset".split())
#: Words in a class, id or role that say the same.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs footer header masthead sidebar aside widget related recommended recommendations "
    "share sharing social cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion pagination pager toolbar "
    "contentinfo complementary search toc tags copyright legal disclaimer skip".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


@dataclass
class Block:
    path: str
    text: str
    linked: int
    chain: tuple[int, ...]  # the open elements, by number
    names: tuple[str, ...]
    away: bool
    named: tuple[int, ...]  # of the open elements, those whose names say away
    inside: bool  # in an article or main element


@dataclass
class Open:
    name: str
    number: int
    away: bool
    named: tuple[int, ...]
    inside: bool


@dataclass
class Page:
    """The open elements and the blocks read so far."""

    stack: list[Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    count: int = 0

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts.clear()
        if text:
            names = tuple(o.name for o in self.stack if o.name in BLOCKS)
            top = self.stack[-1] if self.stack else Open("", 0, False, (), False)
            self.blocks.append(Block("/".join(names), text, self.linked, tuple(o.number for o in self.stack if o.name in BLOCKS), names, top.away, top.named, top.inside))
        self.linked = 0

    def open(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self.flush()
            if any(o.name == "p" for o in self.stack):
                self.close("p", {"article", "section", "div", "td", "th", "body", "blockquote", "li", "main", "form", "aside"})
        if name in CLOSES:
            ends, until = CLOSES[name]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].name in until:
                    break
                if self.stack[k].name in ends:
                    del self.stack[k:]
                    break
        if name == "br" or name == "hr":
            self.parts.append(" ")
        if name in VOID or rest.endswith("/"):
            return
        above = self.stack[-1] if self.stack else None
        inside = bool(above and above.inside) or name in ("article", "main")
        away = bool(above and above.away) or name in AWAY or (name == "header" and not inside)
        self.count += 1
        named = above.named if above else ()
        if not away and rest and name not in ("html", "body", "main"):
            words = {w for m in NAMES.findall(rest) for w in re.split(r"[^a-z]+", "".join(m).lower())}
            away = bool(HIDDEN.search(rest))
            named += (self.count,) if words & AWAY_WORDS else ()
        self.stack.append(Open(name, self.count, away, named, inside))

    def close(self, name: str, until: set[str] | None = None) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                if any(o.name in BLOCKS for o in self.stack[k:]):
                    self.flush()
                del self.stack[k:]
                return
            if until is not None and self.stack[k].name in until:
                return
            if name not in BLOCKS and self.stack[k].name in BLOCKS:
                return  # an end tag of inline markup ends nothing across blocks

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if any(o.name == "a" for o in self.stack):
                self.linked += len(raw.strip())


def blocks(source: str) -> list[Block]:
    """The blocks of text of a page, in order, with their tag paths."""
    page, at = Page(), 0
    for m in PARTS.finditer(source):
        page.text(source[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if name and (m[2] or m[5]):
            page.close(name.lower())
        elif name:
            page.open(name.lower(), m[4] or m[7] or "")
    page.text(source[at:])
    page.flush()
    return page.blocks


def ratios(found: list[Block]) -> dict[str, float]:
    """The fused tag-path ratio of each path: text a node times punctuation a node, smoothed along the page.

    Text under links counts for nothing. A path's ratio is a mean of its own and, with weights of a normal
    curve, of the paths that come before and after it in the page.
    """
    order: list[str] = []
    chars: dict[str, list[float]] = {}
    for b in found:
        if b.path not in chars:
            order.append(b.path)
            chars[b.path] = [0.0, 0.0, 0.0]
        own = max(0, len(b.text) - b.linked)
        for k, x in enumerate((1, own, len(PUNCTUATION.findall(b.text)) * own / max(1, len(b.text)))):
            chars[b.path][k] += x
    raw = {p: math.sqrt((t / n) * (1 + q / n)) for p, (n, t, q) in chars.items()}
    smooth = {}
    for i, p in enumerate(order):
        near = [(math.exp(-((i - j) ** 2) / 2), raw[order[j]]) for j in range(max(0, i - 2), min(len(order), i + 3))]
        smooth[p] = 0.8 * raw[p] + 0.2 * sum(w * x for w, x in near) / sum(w for w, _ in near)
    return smooth


#: What an article or main element adds to the weight of its blocks, times its share of the page's text.
ARTICLE = 9.0
SEMANTIC = frozenset(("article", "main"))


def link_lists(found: list[Block]) -> set[str]:
    """The paths that are lists of links: at least half link text, with less than one mark of punctuation a node."""
    sums: dict[str, list[int]] = {}
    for b in found:
        total = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, x in enumerate((1, len(b.text), b.linked, len(PUNCTUATION.findall(b.text)))):
            total[k] += x
    return {p for p, (n, t, linked, q) in sums.items() if linked >= 0.5 * t and q < n}


def weights(found: list[Block]) -> list[float]:
    """The weight of each block: 1 outside article and main elements, more inside by the share of the text that the greatest of them holds."""
    held: dict[int, int] = {}
    for b in found:
        for e, name in zip(b.chain, b.names):
            if name in SEMANTIC:
                held[e] = held.get(e, 0) + len(b.text)
    total = max(1, sum(len(b.text) for b in found))
    return [1 + ARTICLE * max((held[e] for e in b.chain if e in held), default=0) / total for b in found]


def main_text(source: str | None) -> str:
    """The article's blocks, joined by an empty line.

    Blocks in menus, headers, footers, asides, forms and the like, by element or name, are out (by name only
    where the element doesn't hold most of the page), and so are, outside articles, paths that are lists of links. A block
    counts by its text times its path's ratio, more in an article or main element by that element's share
    of the page. The content stands in the innermost element that holds nearly all of this, or in an article
    or main element that holds half of it with little in others. What is in an article stays whole; elsewhere
    paths of at least a quarter of the heaviest path's ratio, headings and what stands between such blocks.
    """
    if not source:
        return ""
    found = [b for b in blocks(source) if not b.away]
    sizes = [len(b.text) * w for b, w in zip(found, weights(found))]
    held: dict[int, float] = {}
    for b, size in zip(found, sizes):
        for e in b.named:
            held[e] = held.get(e, 0) + size
    # A name such as has-sidebar on what holds most of the page says nothing.
    most = 0.6 * sum(sizes)
    found = [b for b in found if all(held[e] >= most for e in b.named)]
    lists = link_lists(found)
    found = [b for b in found if b.path not in lists or "article" in b.names]
    if not found:
        return ""
    by_path = ratios(found)
    semantic = {e for b in found for e, name in zip(b.chain, b.names) if name in SEMANTIC}
    mass = [max(1, len(b.text) - b.linked) * by_path[b.path] * w for b, w in zip(found, weights(found))]
    by_mass: dict[str, float] = {}
    for b, m in zip(found, mass):
        by_mass[b.path] = by_mass.get(b.path, 0.0) + m
    whole, marked = sum(mass), sum(m for b, m in zip(found, mass) if any(e in semantic for e in b.chain))
    weight: dict[int, float] = {}
    for b, m in zip(found, mass):
        for e in {*(b.chain[:-1] or b.chain), *(e for e in b.chain if e in semantic)}:
            weight[e] = weight.get(e, 0.0) + m
    # Numbers grow inwards.
    holder = max((e for e, w in weight.items() if w >= 0.9 * whole or e in semantic and w >= 0.5 * whole and marked - w < 0.1 * whole), default=None)
    kept = [b for b in found if holder is None or holder in b.chain]
    if not any(e == holder or e < (holder or 0) for b in kept[:1] for e, name in zip(b.chain, b.names) if name == "article"):
        least = 0.25 * by_path[max(by_mass, key=by_mass.get)]
        content = [i for i, b in enumerate(kept) if by_path[b.path] >= least]
        first, last = min(content, default=0), max(content, default=-1)
        kept = [b for i, b in enumerate(kept) if first <= i <= last or b.names[-1:] and b.names[-1] in HEADINGS]
    return "\n\n".join(b.text for b in kept)


def extracted(source: Column | str) -> Column:
    @F.pandas_udf("string")
    def take(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    return take(source)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null and empty pages, and pages without text, give an empty text with 0 characters. A page of any length
    is read whole. Repeated rows come back as often; other columns are not read.
    """
    text = extracted(F.coalesce(F.col(html_column), F.lit("")))
    return pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
