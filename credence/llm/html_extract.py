"""Main text of web pages by consensus of the pages of a host.

First pass: every container of a page is scored by the running text it holds, and the best few are votes
for their generalised path (tags and classes without digits) on the page's host. Spark sums the votes per
host. Second pass: each page is cut at the best voted path it has, or at its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import map_rows
from credence.session import stage

VOTES = 3                    # containers of a page that vote
PATHS = 8                    # paths of a host that are tried in turn before a page's own best container
BROADCAST_BYTES = 32 << 20   # of winning paths; beyond that pages and paths are joined by salted host
SALTS = 32

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var br img wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th summary".split())
DROPPED = frozenset("nav footer aside form script style noscript template head title button select option textarea input iframe object "
                    "svg math canvas dialog menu audio video map".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|xmp|noembed|noframes"
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
                  "option": {"select"}}

# Words in class, id or role that mark what is not the article; whole words between separators.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adslot adsense banner sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination "
    "pager comment comments commentlist disqus replies respond footer masthead toolbar skiplink hidden contentinfo complementary search dialog".split())
HEADERS = frozenset("header headers topbar siteheader".split())
MOST = 0.8                   # of a page's running text; what holds as much is no boilerplate, whatever its class
CONTENT = frozenset("article content main post entry story body text".split())

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|(?P<empty><(?:svg|math)(?=[\s/>])(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S | re.I)
_attribute = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_separator = re.compile(r"[^a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    path: str
    dropped: bool
    bonus: float = 1.0
    marked: bool = False     # by words of class, id or role
    score: float = 0.0


@dataclass(slots=True)
class Block:
    owner: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def boilerplate(tag: str, names: frozenset[str] | set[str], in_article: bool) -> bool:
    if tag in ("html", "body", "main", "#"):
        return False
    if names & HEADERS:
        return not in_article
    return bool(names & BOILERPLATE)


def running(block: Block) -> float:
    """Characters, less three for each that is linked."""
    return max(0.0, sum(map(len, block.parts)) - 3.0 * block.linked)


def drop_marked(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """Drops marked elements with all they hold, and returns the blocks that stay.

    An element stays that is or holds an article element with half of the page's running text, holds a main element,
    or holds ``MOST`` of that text; cards and comments are article elements too. Where no text would be left, none is dropped.
    """
    if not any(x.marked for x in nodes):
        return blocks
    held, whole = [0.0] * len(nodes), [x.tag == "main" and not x.dropped for x in nodes]
    for b in blocks:
        held[b.owner] += running(b) if flat(b) else 0.0
    for i in range(len(nodes) - 1, 0, -1):       # children come after their parents
        held[nodes[i].parent] += held[i]
    for i in range(len(nodes) - 1, 0, -1):
        whole[i] |= nodes[i].tag == "article" and held[i] >= max(1.0, held[0] / 2)
        whole[nodes[i].parent] |= whole[i]
    gone = [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        gone[i] = gone[x.parent] or x.marked and not whole[i] and held[i] < max(1.0, MOST * held[0])
    stay = [b for b in blocks if not gone[b.owner]]
    if any(map(flat, stay)) or not any(map(flat, blocks)):
        for x, out in zip(nodes, gone):
            x.dropped |= out
        return stay
    return blocks


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """Elements and text blocks in page order. Text in elements that are not the article belongs to no block."""
    nodes, blocks = [Node("#", -1, "", False)], [Block(0)]
    stack, inline = [0], []      # open elements; open inline elements, which have no node

    def text(raw: str) -> None:
        if not nodes[stack[-1]].dropped and raw:
            plain = unescape(raw) if "&" in raw else raw
            blocks[-1].parts.append(plain)
            if "a" in inline:
                blocks[-1].linked += len(plain)

    def new_block() -> None:
        if blocks[-1].parts:
            blocks.append(Block(stack[-1]))
        else:
            blocks[-1].owner = stack[-1]

    def close(at: int) -> None:
        del stack[at:]
        inline.clear()
        new_block()

    def nearest(tags: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> int:
        for at in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[at]].tag
            if tag in tags:
                return at
            if tag in limits:
                break
        return 0

    position = 0
    for m in _token.finditer(html):
        if m.start() > position:
            text(html[position:m.start()])
        position = m.end()
        if m["raw"] or m["empty"] or not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                text(" " if tag == "br" else "")
            elif not m["close"]:
                inline.append(tag)
            elif tag in inline:
                del inline[len(inline) - 1 - inline[::-1].index(tag):]
            continue
        if m["close"]:
            if at := nearest({tag}, frozenset()):
                close(at)
            else:
                new_block()
            continue
        if at := nearest({"p"}, {"td", "th", "table", "button", "object", "caption"}):
            close(at)
        if tag in CLOSED_BY_SAME and (at := nearest({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, CLOSED_BY_SAME[tag])):
            close(at)
        if tag in VOID:
            new_block()
            continue
        attrs, names, classes, hidden = m["attrs"], set(), "", False
        if "=" in attrs or "hidden" in attrs:
            for a in _attribute.finditer(attrs):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("class", "id", "role"):
                    words = {w for w in _separator.split(_camel.sub(" ", value).lower()) if w}
                    names |= words
                    if name == "class":
                        classes = ".".join(sorted({_separator.sub("-", c.lower()).strip("-") for c in value.split()} - {""}))
                elif name == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                else:
                    hidden |= name == "hidden" and a.start() > 0 and attrs[a.start() - 1].isspace() or value.lower() == "true"
        parent = nodes[stack[-1]]
        in_article = "article" in parent.path or "main" in parent.path
        dropped = parent.dropped or hidden or tag in DROPPED or tag == "header" and not in_article
        bonus = 1.25 if tag in ("article", "main") or names & CONTENT and tag != "body" else 1.0
        nodes.append(Node(tag, stack[-1], f"{parent.path}>{tag}{'.' + classes if classes else ''}", dropped, bonus, boilerplate(tag, names, in_article)))
        stack.append(len(nodes) - 1)
        inline.clear()
        new_block()
    if position < len(html):
        rest = html[position:]
        cut = rest.rfind("<")
        text(rest if cut < 0 or not re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest[:cut])
    return nodes, drop_marked(nodes, [b for b in blocks if b.parts])


def flat(block: Block) -> str:
    return " ".join("".join(block.parts).split())


def score(nodes: list[Node], blocks: list[Block]) -> None:
    """Running text counts for the container of its paragraph, half for the next one out, and so on."""
    for b in blocks:
        worth = running(b)
        at = b.owner
        if nodes[at].tag in PARAGRAPHS:
            at = nodes[at].parent
        while at >= 0 and worth >= 1:
            nodes[at].score += worth * nodes[at].bonus
            worth, at = worth / 2, nodes[at].parent


def best(nodes: list[Node], n: int) -> list[int]:
    """The ``n`` best containers; of equal ones the outermost, then the first."""
    found = [i for i, x in enumerate(nodes) if x.score > 0 and not x.dropped and x.tag not in PARAGRAPHS]
    return sorted(found, key=lambda i: (-nodes[i].score, nodes[i].path.count(">"), i))[:n]


def text_at(nodes: list[Node], blocks: list[Block], chosen: set[int]) -> str:
    def inside(i: int) -> bool:
        while i >= 0:
            if i in chosen:
                return True
            i = nodes[i].parent
        return False
    return "\n".join(t for b in blocks if inside(b.owner) and (t := flat(b)))


def page_votes(html: str) -> list[tuple[str, int]]:
    """(path, thousandths of the best container's score) of a page's best containers."""
    nodes, blocks = parse(html)
    score(nodes, blocks)
    votes: dict[str, int] = {}
    top = best(nodes, VOTES)
    for i in top:
        votes.setdefault(nodes[i].path, round(1000 * nodes[i].score / nodes[top[0]].score))
    return list(votes.items())


def extract_page(html: str, paths: Iterable[str]) -> str:
    """Text of all containers at the first of ``paths`` that gives any; otherwise of the page's best container."""
    nodes, blocks = parse(html)
    for path in paths:
        chosen = {i for i, x in enumerate(nodes) if x.path == path and not x.dropped}
        if chosen and (found := text_at(nodes, blocks, chosen)):
            return found
    score(nodes, blocks)
    return text_at(nodes, blocks, set(best(nodes, 1)))


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    c = F.col(url) if isinstance(url, str) else url
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Staged (host, paths): the host's most voted paths, best first. Votes are added before they are shuffled."""
    def votes(source: Iterator[dict]) -> Iterable[tuple]:
        for r in source:
            for path, n in page_votes(r["t"] or ""):
                yield r["h"], path, n

    cast = map_rows(pages.select(host_of(url).alias("h"), F.col(html).alias("t")), votes, "host string, path string, n bigint")
    sums = cast.groupBy("host", "path").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))
    first = sums.withColumn("place", place).where(F.col("place") <= PATHS)
    ranked = first.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path")))["path"].alias("paths"))
    return stage(ranked, "host-paths")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars (code points).

    Blocks are in page order with one newline between them, white space inside a block is one space, character
    references are decoded; nothing is cut or capped. Null html gives an empty text, and so does a page with
    none. A null url, or one without ``://``, belongs to the host ``''``. Null and repeated keys are rows of
    their own; an empty table gives no rows; other columns are not read.
    """
    winners = winning_paths(pages, url, html)
    size = winners.agg(F.sum(F.octet_length(F.concat_ws(" ", "host", F.col("paths"))) + 100).alias("b")).first()["b"] or 0
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("t"), host_of(url).alias("host"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:       # a host may hold a large share of the pages: its pages go to many tasks, its paths to each
        salted = winners.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def work(source: Iterator[dict]) -> Iterable[tuple]:
        for r in source:
            found = extract_page(r["t"] or "", r["paths"] or ())
            yield r["k"], r["u"], found, len(found)

    kind = pages.schema[key].dataType.simpleString()
    out = map_rows(joined.select("k", "u", "t", "paths"), work, f"k {kind}, u string, text string, n_chars bigint", batch=512)
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
