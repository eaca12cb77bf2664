"""Main text of web pages: containers are scored page by page, hosts agree on tag-class paths, pages are read again by them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

SHARE = 10  # a path with at least one in so many votes of its host is used there, so a host has no more paths than that
NARROW, NARROW_ARTICLE = 0.75, 0.35  # share of the points of a container that a part needs to be taken in its place
# Fixed values of HTML: elements without content, with text that is no markup, that begin and end blocks of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FRAMES = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th li dt dd "
                   "blockquote figure details fieldset center menu dialog address".split())
BLOCKS = FRAMES | frozenset("p h1 h2 h3 h4 h5 h6 pre hr figcaption caption summary legend option".split())
TEXTS = frozenset("p pre h1 h2 h3 h4 h5 h6".split())  # end where another block begins
PARTS = frozenset("body div section article main td blockquote".split())  # what can be the container of the main text
SELF_CLOSING = {k: tuple(v.split()) for k, v in {
    "li": "ul ol menu", "td": "table tr", "th": "table tr", "tr": "table", "dt": "dl", "dd": "dl"}.items()}  # and what stops the search
# What is not the article: by element, by role, and by the first word of a class or an id.
NEVER = frozenset("nav aside button select svg noscript template object audio video canvas datalist map dialog menu head".split())
OUTSIDE = frozenset("header form footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar topbar widget widgets".split())
SITE = frozenset("site page main global top bottom left right primary secondary post entry article user reader google".split())  # words before a hint

_TAG = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,4000}+"|'[^']{0,4000}+'){0,400}+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$|["'])""", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class Container:
    """An element that holds blocks; ``why``: the reason for which it is left out, if any."""

    __slots__ = ("tag", "parent", "name", "why", "text", "links", "headed", "inside", "chosen")

    def __init__(self, tag: str, parent: Container | None, name: str, why: str):
        self.tag, self.parent, self.name, self.why = tag, parent, name, why
        self.text = self.links = 0  # code points of the whole element out of links and in links
        self.headed = tag == "main"  # holds the title or the main element
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.chosen = False

    @property
    def path(self) -> str:
        names, c = [], self
        while c.parent is not None:
            names.append(c.name)
            c = c.parent
        return " ".join(reversed(names))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}


def _hinted(name: str) -> bool:
    """If a class or an id names a part that is not the article."""
    words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    return bool(words) and (words[0] in HINTS or len(words) > 1 and words[0] in SITE and words[1] in HINTS)


def _reason(tag: str, attributes: dict[str, str], inside: bool) -> str:
    if tag in NEVER:
        return "element"
    if tag in OUTSIDE and not (tag == "header" and inside):
        return tag
    if not attributes or tag in ("html", "body", "main"):
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return "element"
    if attributes.get("role", "").lower() in ROLES:
        return "hint"
    return "hint" if any(map(_hinted, [*attributes.get("class", "").split(), attributes.get("id", "")])) else ""


def _general(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes, without what changes from page to page: numbers become #."""
    classes = sorted({_DIGITS.sub("#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def parse(page: str) -> tuple[list[Container], list[tuple[Container, str]]]:
    """Containers, and blocks of text (with the innermost container of each) in the order of the page.

    Elements that are not closed end with the one around them; closing tags without an open element are passed over, and
    so is a tag that the end of the page cuts off.
    """
    root = Container("body", None, "", "")
    containers, blocks, stack, pieces = [root], [], [root], []
    opened: Counter[str] = Counter()
    size, at, link, linked = len(page), 0, False, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append((stack[-1], text))
                links = min(linked, len(text))
                stack[-1].text += len(text) - links
                stack[-1].links += links
        linked = 0

    def close(tag: str, until: tuple[str, ...] = ()) -> None:
        """End the innermost open element of that tag, unless one of ``until`` is around it."""
        if opened[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    flush()
                    opened.subtract(c.tag for c in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in until:
                    break

    while at < size:
        found = _TAG.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            piece = unescape(page[at:begin])
            pieces.append(piece)
            if link:
                linked += len(piece.strip())
        if not found:
            break
        at = found.end()
        end, tag, rest = found[1], found[2], found[3]
        if tag is None:
            end, tag, rest = found[4], found[5], found[6]
            if tag is None:
                continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if end:
            if tag == "a":
                link = False
            else:
                close(tag)
        elif tag in RAW:
            stop = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if stop is None:
                break
            at = stop.start()
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            link = True
        elif tag not in VOID and tag not in ("html", "body"):
            if tag in BLOCKS:
                if stack[-1].tag in TEXTS:
                    close(stack[-1].tag)
                if tag in SELF_CLOSING:
                    close(tag, SELF_CLOSING[tag])
            attributes = _attributes(rest)
            why = _reason(tag, attributes, stack[-1].inside)
            if tag == "h1" and not why:
                stack[-1].headed = True
            # what inline elements hold is text, whatever they are called
            if (tag in FRAMES or why and (tag in BLOCKS or why == "element")) and not rest.endswith("/"):
                flush()
                stack.append(Container(tag, stack[-1], _general(tag, attributes), why))
                containers.append(stack[-1])
                opened[tag] += 1
    flush()
    _add_up(containers)
    return containers, blocks


def _add_up(containers: list[Container]) -> None:
    """Sums of whole elements, without the parts in them that are left out.

    A form or a hinted part around the title and at least half of the text is the frame of the page, not a part of it.
    """
    total = sum(c.text for c in containers)
    for c in reversed(containers):  # parts come behind what is around them
        if c.why in ("form", "hint", "header") and c.headed and 2 * c.text >= total > 0:
            c.why = ""
        if c.parent is not None:
            c.parent.headed |= c.headed
            if not c.why:
                c.parent.text += c.text
                c.parent.links += c.links


def best_container(containers: list[Container]) -> Container:
    """From the page inwards, as long as one part has nearly all points (text less links); an article is not divided."""
    children: dict[int, list[Container]] = {}
    for c in containers:
        if c.parent is not None and not c.why:
            children.setdefault(id(c.parent), []).append(c)

    def points(c: Container) -> int:
        return c.text - c.links

    now = containers[0]
    best = now
    while now.tag != "article":
        parts = children.get(id(now), [])
        if not parts:
            break
        part = max(parts, key=points)
        needed = NARROW_ARTICLE if part.tag in ("article", "main") else NARROW
        if points(part) <= 0 or points(part) < needed * points(best):
            break
        now = part
        if now.tag in PARTS:
            best = now
    return best


def text_on(path: str, containers: list[Container], blocks: list[tuple[Container, str]]) -> str:
    """Blocks in the containers on the path that are in no part left out, joined by line breaks.

    Of several containers, those with more text in links than outside are menus.
    """
    names = path.split()
    depth: dict[int, int] = {}  # of containers on the path or on the way to it
    found = []
    for c in containers:
        above = -1 if c.parent is None else depth.get(id(c.parent))
        c.chosen = False
        if above is not None and not c.why and (above < 0 or above < len(names) and names[above] == c.name):
            depth[id(c)] = above + 1
            if above + 1 == len(names):
                found.append(c)
    for c in found:
        c.chosen = len(found) == 1 or c.links <= c.text
    for c in containers:
        c.chosen = c.chosen or c.parent is not None and c.parent.chosen and not c.why
    return "\n".join(text for c, text in blocks if c.chosen)


def vote(page: str) -> tuple[str | None, int]:
    """Path of the best container of a page, and its points; no path without text."""
    containers, _ = parse(page)
    best = best_container(containers)
    points = best.text - best.links
    return (best.path, points) if points > 0 else (None, 0)


def extract(page: str, paths: list[str] | None) -> str:
    """Text of the containers on the first of the host's paths on which the page has text; without one, of the page's own best."""
    containers, blocks = parse(page)
    for path in paths or ():
        text = text_on(path, containers, blocks)
        if text:
            return text
    return text_on(best_container(containers).path, containers, blocks)


def host(url: Column) -> Column:
    """Host of an address in lower case, null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: int = SHARE) -> DataFrame:
    """``host, paths``: the paths that at least one in ``share`` voting pages of a host prefers, most votes first.

    Votes are counted before they are shuffled; only paths with enough votes, at most ``share``, are listed per host.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [vote(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                ["host", "path", "points"])

    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host IS NOT NULL")
    votes = rows.mapInArrow(run, "host string, path string, points long").where("path IS NOT NULL")
    counted = staged(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("points").alias("points")), "votes")
    totals = counted.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("votes"), -F.col("points"), F.col("path").alias("path"))))
    return (counted.join(totals, "host").where(F.col("votes") * share >= F.col("all_votes"))
            .groupBy("host").agg(F.transform(ranked, lambda s: s["path"]).alias("paths")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: int = SHARE) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Blocks are the texts between tags of block elements; character references are decoded, white space becomes one space,
    empty blocks go. Null and empty pages, and pages without text outside the parts left out, have an empty text. Pages
    without a host are judged by themselves. Repeated rows are returned as often as they come. The table of hosts is
    joined, not collected: it is only broadcast if the planner finds it small, and hot hosts are split by adaptive execution.
    """
    paths = staged(host_paths(pages, url_col, html_col, share), "host-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(x or "", p) for x, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    df = rows.join(paths, "host", "left").select("page_id", "url", "html", "paths")
    return df.mapInArrow(run, f"page_id {df.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
