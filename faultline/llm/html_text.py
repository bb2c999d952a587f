"""Main text of web pages by composite text density.

A page is parsed into a tree of block elements; inline elements count as tags of their block.  What the HTML standard sets
apart from the text (scripts, navigation, asides, page headers and footers, form controls, hidden parts, and the roles that
say the same) is left out.  For every node, with C characters, T tags, LC characters and LT tags of links below it, the
density is C/T, weighted up by C/LC * T/LT and down by the links of node and page.  A class or id that says advert, notice,
comment and the like lowers the densities of its subtree (`PENALTY`, `COMMENT_PENALTY`), and no more than that.

The node whose children's densities have the greatest sum, and which is not mostly links, is the best one; one in an article
or main element goes before others unless its sum is below `OWN` of theirs.  Each node on its path to the body has a
threshold: the least density from the best node up to it.  If the path holds an article or main element, the text is that of
the outermost one, and of others of at least `LIKE` times its threshold.  If not, it is the best node and, at every step of
the path, of the children beside it those that reach the threshold, containers of running paragraphs that reach `LIKE` times
the threshold (`BOX` times, where they begin with a heading of another level than the best node's, as boxes do), text elements next to these, and
what stands between them; a heading ahead of the text belongs to it.  A block that is mostly links, or has such a name, is
left out wherever it is below the threshold.  Without an h1 in the text, the last one ahead of it is its title, unless that
stands in a box apart and either the text begins with a heading or the box is named as the site's head (`SITE`).

Time is in proportion to the page's length, whatever it holds.  Defined results: null and empty pages, and pages without
text outside the parts left out, give the empty text; unclosed and misnested tags are closed as their parents end; a tag
that the page's end cuts off is no text; a quote without its second one is a character like others; repeated rows get equal
values; a page of any length is parsed whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as X

OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Up to the tag's end, a quote that nothing closes, or the page's end.
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORDS = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")
# fixed values: elements of HTML by their role in a page
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER = frozenset("head script style title noscript template nav menu aside footer button select input textarea iframe object embed svg canvas audio video dialog noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = HEADINGS | frozenset("p pre blockquote ul ol dl table figure hr".split())
SCOPE = frozenset("html body table ul ol dl div section article main aside nav td th button blockquote".split())
CONTAINERS = frozenset("article main".split())
# names that lower a block's density, as the first or last part of a class or id, and parts that take the name back
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe share sharing pagination pager toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies response responses".split())
SITE = frozenset("top topbar head header site sitename logo brand branding masthead banner".split())
BACK = frozenset("no not non without has have with free enabled disabled open closed on off is layout page main content".split())
PENALTY, COMMENT_PENALTY = 0.1, 0.02
#: Share of the greatest sum of all that the greatest in an article or main element needs to go before it.
OWN = 0.1
#: Share of the threshold that a second container of running text has at least, and one that begins with another level of heading.
LIKE, BOX = 0.1, 0.5
#: Characters of a paragraph that counts as running text.
LONG = 80


@dataclass
class Node:
    parent: int
    tag: str
    out: bool
    #: what its names make of the densities below it, 1 without any
    factor: float = 1.0
    last: int = 0
    #: characters, and those in links, below it; what a child's names make of its own counts here
    chars: float = 0
    tags: int = 1
    link_chars: float = 0
    link_tags: int = 0
    own_chars: int = 0
    density: float = 0.0
    total: float = 0.0
    children: int = 0
    prose: bool = False
    #: whether a class or id names it as the site's head
    site: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text, characters in links) of each stretch of text, in page order
    stretches: list[tuple[int, str, int]] = field(default_factory=list)


def _named(value: str) -> float:
    """The factor of a class or id."""
    least = 1.0
    for word in value.split():
        parts = [p.lower() for p in WORDS.findall(word)]
        if parts and BACK.isdisjoint(parts):
            ends = {parts[0], parts[-1]}
            least = min(least, COMMENT_PENALTY if ends & COMMENTS else PENALTY if ends & NAMES else 1.0)
    return least


def _site(raw: str) -> bool:
    """Whether a class or id is one of the site's head."""
    return any(m[1].lower() in ("class", "id") and any(p[0].lower() in SITE or p[-1].lower() in SITE for w in (m[2] or m[3] or m[4] or "").split() if (p := WORDS.findall(w))) for m in ATTRIBUTE.finditer(raw))


def _judged(tag: str, raw: str, in_article: bool) -> tuple[bool, float]:
    """Whether an element is left out, and the factor of its names."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True, 1.0
    factor = PENALTY if tag == "form" else 1.0
    if not raw.strip("/ \t\r\n"):
        return False, factor
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if tag not in INLINE and tag not in HEADINGS and tag not in ("html", "body", "main"):
                factor = min(factor, _named(value))
        elif name in ("itemprop", "itemtype"):
            if value.rstrip("/").rpartition("/")[2].lower() == "comment":
                factor = min(factor, COMMENT_PENALTY)
        elif name == "role":
            if value.lower() in ROLES:
                return True, 1.0
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value.lower())):
            return tag not in ("html", "body"), factor
    return False, factor


class _Open:
    """The open elements, each with its block; the last of a name within the innermost scope is found at once."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.count: dict[str, int] = {}
        self.scopes: list[dict[str, list[int]]] = [{}]

    def push(self, tag: str, block: int) -> None:
        self.scopes[-1].setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, block))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in SCOPE:
            self.scopes.append({})

    def pop(self) -> tuple[str, int]:
        tag, block = self.stack.pop()
        self.count[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        self.scopes[-1][tag].pop()
        return tag, block

    def depth_of(self, names: tuple[str, ...]) -> int:
        """Place of the innermost of these within the scope, 0 if none is open."""
        return max((places[-1] for n in names if (places := self.scopes[-1].get(n))), default=0)


def parse(source: str) -> Page:
    """Blocks in the order in which they open, and the stretches of text that are not left out."""
    page = Page([Node(-1, "#page", False)])
    nodes, opened = page.nodes, _Open()
    stack = opened.stack
    links = articles = part_links = 0
    parts: list[str] = []

    def close_text() -> None:
        nonlocal part_links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.stretches.append((stack[-1][1], text, min(part_links, len(text))))
            parts.clear()
        part_links = 0

    def pop() -> str:
        nonlocal links, articles
        tag, block = stack[-1]
        if tag in INLINE and nodes[block].tag != tag + "!":
            links -= tag == "a"
        else:
            close_text()
            nodes[block].last = len(nodes)
            articles -= tag in CONTAINERS
        return opened.pop()[0]

    def pop_to(depth: int) -> None:
        while depth and len(stack) > depth:
            pop()

    at, end = 0, len(source)
    while at < end:
        m = OPENS.search(source, at)
        text = html.unescape(source[at : m.start() if m else end])  # each stretch by itself, as references end with it
        if text and not nodes[stack[-1][1]].out:
            parts.append(text)
            if links:
                part_links += len(text.strip())
        if not m:
            break
        at = m.end()
        if source[at] in "!?":
            for begin, close in (("!--", "-->"), ("![CDATA[", "]]>"), ("", ">")):
                if source.startswith(begin, at):
                    found = source.find(close, at + len(begin))
                    at = found + len(close) if found >= 0 else end
                    break
            continue
        closing = source[at] == "/"
        named = NAME.match(source, at + closing)
        if not named:
            found = source.find(">", at)
            at = found + 1 or end
            continue
        start = at = named.end()
        while (at := INSIDE.match(source, at).end()) < end and source[at] != ">":
            at += 1  # a quote without its second one
        raw, at = source[start:at], at + 1
        if at > end:
            break
        tag = named[0].lower()
        if closing:
            if tag == "br":
                parts.append(" ")
            elif opened.count.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in CLOSES_P:
            pop_to(opened.depth_of(("p",)))
        elif tag in SAME:
            pop_to(opened.depth_of(SAME[tag]))
        block = stack[-1][1]
        out, factor = _judged(tag, raw, articles > 0)
        if tag in INLINE:
            nodes[block].tags += 1
            nodes[block].link_tags += tag == "a"
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID:
                if out and not nodes[block].out:
                    close_text()
                    nodes.append(Node(block, tag + "!", True, 1.0, len(nodes) + 1))
                    opened.push(tag, len(nodes) - 1)
                else:
                    opened.push(tag, block)
                    links += tag == "a"
            continue
        close_text()
        nodes.append(Node(block, tag, nodes[block].out or out, factor, len(nodes) + 1, site=nodes[block].site or tag not in ("html", "body") and _site(raw)))
        if tag in VOID or raw.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            at = source.find(">", found.start()) + 1 or end if found else end
            continue
        articles += tag in CONTAINERS
        opened.push(tag, len(nodes) - 1)
    while len(stack) > 1:
        pop()
    close_text()
    nodes[0].last = len(nodes)
    return page


def measure(page: Page) -> None:
    """Densities and their sums; children come after their parents, so one backward pass adds up."""
    nodes = page.nodes
    for k, text, link in page.stretches:
        n = nodes[k]
        n.chars += len(text)
        n.own_chars += len(text)
        n.link_chars += link
        if len(text) >= LONG and 4 * link <= len(text) and n.tag in TEXT:
            while n.parent >= 0 and not n.prose:  # each node is marked once
                n.prose = True
                n = nodes[n.parent]
    for n in reversed(nodes):
        if n.parent >= 0 and not n.out:
            p = nodes[n.parent]
            p.chars += n.factor * n.chars
            p.tags += n.tags
            p.link_chars += n.factor * n.link_chars
            p.link_tags += n.link_tags
    whole = nodes[0]
    share = whole.link_chars / max(1, whole.chars)
    below = [1.0] * len(nodes)
    for k, n in enumerate(nodes):
        below[k] = n.factor * below[max(0, n.parent)]
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if not n.chars or n.out:
            continue
        ratio = n.chars / max(1, n.link_chars) * n.tags / max(1, n.link_tags)
        n.density = below[k] * n.chars / n.tags * math.log(math.e + ratio) / math.log(math.e + n.chars * n.link_chars / max(1, n.chars - n.link_chars) + share * n.chars)
        n.total += below[k] * n.own_chars if n.children else n.density
        if n.parent >= 0:
            nodes[n.parent].total += n.density
            nodes[n.parent].children += 1


def _linked(n: Node) -> bool:
    return 2 * n.link_chars > n.chars


def choose(page: Page) -> tuple[list[int], list[float]]:
    """The path from the best node up to the body, and of each node on it the least density up to there."""
    nodes = page.nodes
    body = next((k for k, n in enumerate(nodes) if n.tag == "body" and n.chars), 0)
    rank = lambda k: (nodes[k].chars > 0 and not _linked(nodes[k]), nodes[k].total, -k)
    best = max(range(body, nodes[body].last), key=rank)
    held, end = [], 0
    for k, n in enumerate(nodes):
        if n.tag in CONTAINERS and n.factor == 1 and n.chars and not _linked(n):
            end = max(end, n.last)
        if k < end:
            held.append(k)
    own = max(held, key=rank, default=best)
    path = [own if rank(own)[0] and nodes[own].total >= OWN * nodes[best].total else best]
    while path[-1] > body:
        path.append(nodes[path[-1]].parent)
    return path, list(itertools.accumulate((nodes[k].density for k in path), min))


def _kept(page: Page) -> list[bool]:
    """Of each stretch, whether it belongs to the article."""
    nodes, stretches = page.nodes, page.stretches
    path, thresholds = choose(page)
    inside = bytearray(len(nodes))
    weak = lambda n, least: n.density < least and (n.factor < 1 or _linked(n))

    def take(k: int, least: float) -> None:
        """All of a node but the blocks that are left out."""
        at, last = k, nodes[k].last
        while at < last:
            if at != k and at not in up and weak(nodes[at], least):
                at = nodes[at].last
            else:
                inside[at] = 1
                at += 1

    up = frozenset(path)
    scope = max((i for i, k in enumerate(path) if nodes[k].tag in CONTAINERS and (nodes[k].factor == 1 or not i)), default=None)
    if scope is not None:
        k, least = 0, thresholds[scope]
        while k < len(nodes):  # outermost ones only
            n = nodes[k]
            if k == path[scope] or n.tag in CONTAINERS and n.factor == 1 and n.chars and not _linked(n) and n.density >= LIKE * least:
                take(k, least)
                k = n.last
            else:
                k += 1
    else:
        take(path[0], thresholds[0])
        heads = {nodes[k].tag for k, _, _ in stretches if path[0] <= k < nodes[path[0]].last} & HEADINGS
        headed, seen = set(), -1  # nodes whose first text is a heading of a level that the best node has not
        for k, _, _ in stretches:
            at = k
            while at > seen:
                if nodes[k].tag in HEADINGS - heads:
                    headed.add(at)
                at = nodes[at].parent
            seen = max(seen, k)
        kids: dict[int, list[int]] = {k: [] for k in path[1:]}
        for k, n in enumerate(nodes):
            if n.parent in kids:
                kids[n.parent].append(k)
        for here, parent, least in zip(path, path[1:], thresholds, strict=False):
            row = [k for k in kids[parent] if k == here or nodes[k].chars and not weak(nodes[k], least)]
            sure = [k == here or nodes[k].density >= least or (nodes[k].prose and nodes[k].density >= (BOX if k in headed else LIKE) * least) for k in row]
            first, last = sure.index(True), len(sure) - 1 - sure[::-1].index(True)
            while last + 1 < len(row) and nodes[row[last + 1]].tag in TEXT:
                last += 1
            begin = first
            while begin and nodes[row[begin - 1]].tag in TEXT:
                begin -= 1
                first = begin if nodes[row[begin]].tag in HEADINGS else first
            for k in row[first : last + 1]:
                if k != here:
                    take(k, least)
            inside[parent] |= nodes[parent].tag not in ("html", "body", "#page")  # its own words
    kept = [bool(inside[k]) for k, _, _ in stretches]
    if True in kept and not any(x and nodes[k].tag == "h1" for x, (k, _, _) in zip(kept, stretches, strict=True)):
        first = kept.index(True)
        begins = nodes[stretches[first][0]].tag in HEADINGS

        def names_text(i: int) -> bool:
            n = nodes[stretches[i][0]]
            return n.tag == "h1" and 2 * stretches[i][2] <= len(stretches[i][1]) and (n.parent in up or not (begins or n.site))

        title = next((i for i in range(first - 1, -1, -1) if names_text(i)), None)
        if title is not None:
            kept[title] = True
    return kept


def main_text(source: str | None) -> str:
    """The article's text, blocks joined by one space."""
    if not source:
        return ""
    page = parse(source)
    measure(page)
    return " ".join(text for x, (_, text, _) in zip(_kept(page), page.stretches, strict=True) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "html"):
                text = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
