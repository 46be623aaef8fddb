"""Operator 4: main text of web pages by composite text density.

A page is read once by a tolerant tokeniser into its tree of block elements.  Every node gets its
characters per tag, adjusted for characters and tags in links; the densities of a node's children are
summed, the node with the greatest sum is the core, and the least density on the path from it to the body
is the threshold above which other subtrees hold content, too.  A core inside an ``article`` or ``main``
stands for the whole of it, so headings beside the densest part stay.  Densities grow with the tags of a
subtree, so on pages without these elements what lies beside the core stays unless most of it is links.

Never content, whatever their density: scripts, styles, navigation, footers, asides, forms, page headers
(a header inside an article stays), hidden elements, and elements whose role, class or id names a menu, advert,
notice, share bar, sidebar or reader comments.  A class or id counts as a whole or by its first or last part; where
only a part speaks, or for a form, the element stays if it holds most of the page's text.

Time is linear in the page, however deeply it nests.  Pages are independent rows: one map step, no shuffle.  Null or empty html: empty text.  Pages without
elements: their text.  Null identifiers pass through, repeated rows are each extracted.  Empty table:
empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)|/[^>a-zA-Z][^>]*+>)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "noscript")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr picture".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head nav footer aside form button select option optgroup datalist fieldset template object applet svg math canvas audio video map dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tooltip".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidenav "
    "footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended "
    "comment comments commentlist respond replies disqus skip widget widgets".split()
)
_ANYWAY = frozenset(("html", "body", "main"))
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_ENDS |= {t: (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)) for t in ("thead", "tbody", "tfoot")}
_IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
_QUALIFIERS = frozenset("has have no not non with without is".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


def _named(words: list[str], part: bool) -> bool:
    """Whether a class or id is an unwanted name as a whole, or (part) its first or last part is one."""
    for w in words:
        parts = [p for p in _SPLIT.split(w) if p]
        if len(parts) == 1 and parts[0] in _NAMES:
            return True
        if part and len(parts) > 1 and not _QUALIFIERS & set(parts) and (parts[0] in _NAMES or parts[-1] in _NAMES):
            return True
    return False


def _unwanted(tag: str, attributes: str, in_article: bool, most: bool = False) -> bool:
    """most: the element is known to hold most of the page's text."""
    if tag == "form" and most:
        return False
    if tag in _NEVER or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            value = unescape((m[2] or "").strip("\"'")).lower()
            if name == "hidden":
                return tag not in _ANYWAY
            if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return tag not in _ANYWAY
            if name == "role" and value.strip() in _ROLES:
                return tag not in _ANYWAY
            if name in ("class", "id") and tag not in _ANYWAY:
                words = value.split()
                if tag == "article":
                    words = [w for w in words if _SPLIT.split(w)[0] in ("comment", "comments", "ad", "advert", "sponsored", "promo")]
                if _named(words, tag not in _INLINE and not most):
                    return True
    return False


class _All:
    """Holds every place."""

    def __contains__(self, place: int) -> bool:
        return True

    def __len__(self) -> int:
        return 0

    def add(self, place: int) -> None:
        pass


class _Page:
    """Block elements in document order (a subtree is a range), and the blocks of text with their nodes."""

    def __init__(self, html: str):
        most: set[int] | _All = set()  # places of elements that would go, but hold most of the text
        while True:
            self.tags, self.parents, self.ends = ["#page"], [-1], [0]
            self.chars, self.links, self.link_tags = [0], [0], [0]
            self.blocks: list[tuple[int, str]] = []
            more = self._read(html, most)
            if more is None or {"article", "main"} & set(self.tags):
                break
            most.add(more)
            if len(most) > 32:  # nested that deep: every doubtful element may stay
                most = _All()
        self.ends[0] = len(self.tags)

    def _read(self, html: str, most: set[int] | _All) -> int | None:
        """Fills the lists; returns the place of a dropped element that holds most of the text and may stay."""
        stack, open_tags = [0], ["#page"]  # a node is -1 where the subtree is dropped
        depths: dict[str, list[int]] = {}  # where each tag is open, so no search depends on the depth
        pieces: list[str] = []
        link, articles, at, size = 0, 0, 0, len(html)
        seen, doubt, outer = 0, (0, 0, 0), (0, 0)  # characters so far; the greatest doubtful subtree; the open one's place and start
        deep = 0
        tags, parents, ends, chars, links, link_tags = self.tags, self.parents, self.ends, self.chars, self.links, self.link_tags

        def flush() -> None:
            if pieces:
                node = stack[-1]
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text and node >= 0:
                    chars[node] += len(text)
                    self.blocks.append((node, text))

        def close(depth: int) -> None:
            nonlocal articles, doubt, deep
            flush()
            if deep and depth <= deep:
                doubt, deep = max(doubt, (seen - outer[1], outer[0], 1)), 0
            while len(stack) > depth:
                node, tag = stack.pop(), open_tags.pop()
                depths[tag].pop()
                if tag in ("article", "main"):
                    articles -= 1
                if node > 0:
                    ends[node] = len(tags)

        while at < size:
            m = _TOKEN.search(html, at)
            start = m.start() if m else size
            if start > at and open_tags[-1] == "head" and not html[at:start].isspace():
                close(len(open_tags) - 1)
            if start > at:
                seen += len("".join(html[at:start].split()))
            if start > at and stack[-1] >= 0:
                text = html[at:start]
                if "&" in text:
                    text = unescape(text)
                pieces.append(text)
                if link:
                    links[stack[-1]] += len("".join(text.split()))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in _INLINE:
                    if tag == "a":
                        link = 0
                    continue
                if tag == "br":
                    pieces.append(" ")
                elif depths.get(tag):
                    close(depths[tag][-1])
                continue
            if open_tags[-1] == "head" and tag not in _IN_HEAD:
                close(len(open_tags) - 1)
            if tag in _RAW:
                end = _RAW[tag].search(html, at)
                at = end.start() if end else size
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr") and stack[-1] >= 0:
                    pieces.append(" " if tag == "br" else "")
                continue
            dropped = stack[-1] < 0 or _unwanted(tag, m[3], articles > 0, start in most)
            if tag in _INLINE and not (dropped and stack[-1] >= 0 and not depths.get("pre")):
                if tag == "a":
                    link = 1
                    if stack[-1] >= 0:
                        link_tags[stack[-1]] += 1
                continue
            if tag in _INLINE:  # a hidden or unwanted inline element: skip to its end
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else at
                continue
            if tag in ("html", "body") and depths.get(tag):
                continue
            if tag in _CLOSES_P and depths.get("p"):
                close(depths["p"][-1])
                dropped = stack[-1] < 0 or dropped
            if tag in _ENDS:
                own, scope = _ENDS[tag]
                wall = max((depths[t][-1] for t in scope if depths.get(t)), default=0)
                inside = [d[bisect_right(d, wall)] for t in own if (d := depths.get(t)) and d[-1] > wall]
                if inside:
                    close(min(inside))
                if stack[-1] >= 0:
                    dropped = _unwanted(tag, m[3], articles > 0, start in most)
            if tag == "body" and depths.get("head"):
                close(depths["head"][0])
                dropped = False
            flush()
            articles += tag in ("article", "main")
            depths.setdefault(tag, []).append(len(open_tags))
            open_tags.append(tag)
            if dropped:
                if stack[-1] >= 0 and not _unwanted(tag, m[3], articles > 0, True):
                    outer, deep = (start, seen), len(stack)
                stack.append(-1)
            else:
                parents.append(stack[-1] if stack[-1] >= 0 else next(s for s in reversed(stack) if s >= 0))
                stack.append(len(tags))
                tags.append(tag)
                for c in (chars, links, link_tags, ends):
                    c.append(0)
        close(1)
        flush()
        return doubt[1] if doubt[2] and 2 * doubt[0] > seen else None

    def content(self) -> list[str]:
        """The blocks of the chosen subtrees in page order."""
        n = len(self.tags)
        if n == 1 or not self.blocks:
            return [t for _, t in self.blocks]
        chars, links, link_tags, inner = self.chars[:], self.links[:], self.link_tags[:], [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            chars[p] += chars[i]
            links[p] += links[i]
            link_tags[p] += link_tags[i]
            inner[p] += inner[i] + 1
        top = next((i for i, t in enumerate(self.tags) if t == "body"), 0)
        share = links[top] / max(1, chars[top])
        density = [0.0] * n
        for i in range(n):
            c, lc = chars[i], min(links[i], chars[i])
            if c:
                t, lt = max(1, inner[i] + link_tags[i]), max(1, link_tags[i])
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[i] = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / base)
                if not lc and t == lt:  # a leaf without links: the logarithm has nothing to adjust
                    density[i] = max(density[i], c / t)
        total = [0.0] * n
        for i in range(1, n):
            total[self.parents[i]] += density[i]
        core = list(range(n))  # of every subtree, the node of the greatest sum
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            core[p] = max(core[p], core[i], key=lambda j: (total[j], density[j], -j))
        best = max(range(top, n), key=lambda i: (total[i], density[i], -i))
        whole, article, main = list(range(n)), [-1] * n, [-1] * n  # the nearest article, or the outermost main, around every node
        for i in range(1, n):
            p = self.parents[i]
            article[i] = i if self.tags[i] == "article" else article[p]
            main[i] = main[p] if main[p] >= 0 or self.tags[i] != "main" else i
            whole[i] = next((j for j in (article[i], main[i]) if j >= 0), i)
        holds = [False] * n  # a chosen node
        threshold, i = density[best], best
        while i > top:
            i = self.parents[i]
            threshold = min(threshold, density[i])
        chosen = [False] * n
        self._mark(chosen, holds, whole[best])
        i = top + 1
        while i < n:  # other subtrees at least as dense as the path
            if chosen[i]:
                i += 1
            elif density[i] < threshold or not chars[i]:
                i = self.ends[i]
            else:
                if not holds[i]:
                    self._mark(chosen, holds, whole[core[i]])
                i += 1
        if best == top or not {"article", "main"} & set(self.tags):  # no element marks the text: all but what is mostly links
            inside = range(best, self.ends[best]) if best != top else range(0)
            chosen[top] = True
            i = top + 1
            while i < n:
                if i in inside:
                    i = inside.stop
                elif chars[i] and 2 * links[i] > chars[i] and not i < best < self.ends[i]:
                    chosen[i : self.ends[i]] = [False] * (self.ends[i] - i)
                    i = self.ends[i]
                else:
                    chosen[i] = True
                    i += 1
        return [t for node, t in self.blocks if chosen[node]]

    def _mark(self, chosen: list[bool], holds: list[bool], node: int) -> None:
        chosen[node : self.ends[node]] = [True] * (self.ends[node] - node)
        holds[node : self.ends[node]] = [True] * (self.ends[node] - node)
        while node >= 0 and not (holds[node] and chosen[node] is False):
            holds[node] = True
            node = self.parents[node]


def main_text(html: str | None) -> str:
    """Main text of one page: blocks in page order, joined by a line feed."""
    return "\n".join(_Page(html).content()) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("__html")
        texts = [main_text(h) for h in batch.column(i).to_pylist()]
        cols = [c for k, c in enumerate(batch.columns) if k != i]
        names = [n for n in batch.schema.names if n != "__html"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])


def extract_html(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of every page with text and n_chars (code points).

    Raises ValueError if ``keep`` holds one of these names.
    """
    if {"text", "n_chars", "__html"} & set(keep):
        raise ValueError("keep holds a name of the result")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__html")
    return rows.mapInArrow(_extract, schema + "text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
