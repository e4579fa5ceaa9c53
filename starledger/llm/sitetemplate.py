"""Main text of web pages by removing what a site repeats.

Every page is parsed into an element tree, in time in proportion to its length. A subtree is
known by a hash of its tags and text. Spark counts, for each host, in how many different pages
each subtree stands, where pages with the same text are one page; subtrees that stand in many
pages of a host are its template and are deleted. Within an article a subtree must stand in
half of a host's pages to be template, elsewhere in a tenth, and always in at least
``LEAST_PAGES``; what is template at the one place only is deleted at that place only, so what
articles quote stays.

Counts say nothing about what differs from page to page, nor on a host of few pages. There
the markup itself does: tags that are never text (navigation, footers, asides, forms, scripts,
styles), hidden elements, and the two things that HTML has no tag for, adverts and reader
comments, by a name of their own. If a page marks articles, their text is the text, all of
them in page order; if not, its main part; if it marks neither, all of it but headers, lists of
links and elements named as furniture. What is left is put out block by block.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import clash_free, per_batch, stored

#: Parameters of the template rule.
LEAST_PAGES, SHARE_INSIDE, SHARE_OUTSIDE = 5, 0.5, 0.1
#: Hosts and subtrees that a broadcast may hold; beyond, the pages are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_SUBTREES = 20_000, 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes select canvas audio video".split())
DROPPED = frozenset("head nav footer aside form button dialog menu fieldset label datalist map".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address hr details summary hgroup center dialog menu search".split()
)
#: Start tags that end an open paragraph, and which open elements a start tag ends.
ENDS_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body", "summary"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Whole names (class or id) of adverts and reader comments, wherever they stand.
ADVERTS = frozenset("ad ads advert adverts advertisement adsbygoogle ad-slot ad-banner sponsored".split())
COMMENTS = frozenset("comment comments comment-list commentlist comments-area comment-body comment-respond respond disqus_thread".split())
#: Names, or parts of names, of furniture; they count on pages without article and main part only,
#: and never for an element that holds most of the page's text.
FURNITURE = frozenset("ad ads advert banner sponsor promo sidebar widget menu nav navbar breadcrumb breadcrumbs toc pager pagination footer copyright masthead topbar toolbar cookie cookies consent gdpr notice popup modal newsletter subscribe login share sharing social related recommended trending comments search".split())
HEADERS = frozenset(("header", "site-header", "page-header"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[a-z0-9]+")
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "drop", "main", "furniture", "children", "digest")

    def __init__(self, tag: str, drop: bool = False, main: bool = False, furniture: bool = False):
        self.tag, self.drop, self.main, self.furniture = tag, drop, main, furniture
        self.children: list[Node | str] = []
        self.digest = 0


def _node(tag: str, attributes: str) -> Node:
    node = Node(tag, drop=tag in DROPPED, main=tag == "main", furniture=tag == "header")
    if "=" not in attributes and "hidden" not in attributes:
        return node
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names = value.split()
            node.drop |= not ADVERTS.isdisjoint(names) or not COMMENTS.isdisjoint(names)
            node.furniture |= any(n in FURNITURE or n in HEADERS or not FURNITURE.isdisjoint(PART.findall(n)) for n in names)
        elif name == "role":
            node.main |= value == "main"
            node.furniture |= value == "banner"
            node.drop |= value in ("navigation", "contentinfo", "complementary", "search", "dialog")
        elif name == "itemprop":
            node.main |= value == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            node.drop = True
    if tag == "main":
        node.drop = False
    return node


class _Open:
    """The elements that are open, with the places of each tag and of blocks, so that no end tag is searched for."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], defaultdict(list), [0]

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at ``place`` and all within it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def start(self, tag: str) -> None:
        """Closes what a start tag ends."""
        if tag in ENDS_P and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in ENDS and (place := self.last(ENDS[tag])) > self.last(SCOPE[tag]):
            self.cut(place)

    def end(self, tag: str) -> None:
        """Closes the nearest element of the tag; an inline end tag does not reach across a block."""
        if (places := self.at[tag]) and (tag in BLOCK or places[-1] > self.blocks[-1]):
            self.cut(places[-1])


def parse(html: str) -> Node:
    """The element tree of a page, however broken: text children are decoded strings."""
    root = Node("html")
    held = _Open(root)
    pos, end = 0, len(html)
    while pos < end:
        m = TOKEN.search(html, pos)
        text = html[pos : m.start() if m else end]
        if text:
            held.stack[-1].children.append(htmllib.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if m[0].startswith("<![CDATA["):
            held.stack[-1].children.append(m[0][9:].removesuffix("]]>"))
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag not in RAW:
                held.end(tag)
        elif tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                found = CLOSE[tag].search(html, pos)
                pos = found.end() if found else end
        elif tag == "br" or tag == "wbr":
            held.stack[-1].children.append(" " if tag == "br" else "")
        elif tag not in ("html", "body"):
            held.start(tag)
            node = _node(tag, attributes)
            held.stack[-1].children.append(node)
            if tag not in VOID:
                held.push(node)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first; no recursion, so depth has no limit."""
    out, i = [root], 0
    while i < len(out):
        out.extend(c for c in out[i].children if isinstance(c, Node))
        i += 1
    return out


def _digests(root: Node) -> list[Node]:
    """Sets the digest of every subtree; 0 where it holds no text. Returns all nodes."""
    nodes = _walk(root)
    for node in reversed(nodes):
        parts = []
        for c in node.children:
            if isinstance(c, str):
                if t := " ".join(c.split()):
                    parts.append(t)
            elif c.digest:
                parts.append(f"\x00{c.digest:x}")
        node.digest = xxh64_intdigest(f"{node.tag}\x01{chr(2).join(parts)}") & 0x7FFFFFFFFFFFFFFF if parts else 0
    return nodes


def articles_of(root: Node) -> list[Node]:
    """The outermost articles in page order, or the outermost main parts where there is no article."""
    articles, mains = [], []
    todo = [(root, False)]
    while todo:
        node, in_main = todo.pop()
        if node.drop:
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.main and not in_main:
            mains.append(node)
        todo.extend((c, in_main or node.main) for c in reversed(node.children) if isinstance(c, Node))
    return articles or mains


def _furniture(root: Node) -> set[int]:
    """Elements (by id) that are headers, lists of links or named as furniture, on a page without an article."""
    nodes, sizes = _walk(root), {}
    for node in reversed(nodes):
        text = links = count = 0
        for c in node.children:
            if isinstance(c, str):
                text += len("".join(c.split()))
            elif not c.drop:
                t, n, k = sizes[id(c)]
                text, links, count = text + t, links + n, count + k
        sizes[id(node)] = (text, text, 1) if node.tag == "a" else (text, links, count)
    most = sizes[id(root)][0] / 2
    return {id(n) for n in nodes if n.furniture and sizes[id(n)][0] <= most or sizes[id(n)][2] >= 3 and sizes[id(n)][0] == sizes[id(n)][1]}


def main_text(root: Node, inside: frozenset[int] | set[int] = frozenset(), outside: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the articles, or of the page without one, joined by newlines.

    ``inside`` and ``outside`` are the digests that are template within an article and elsewhere.
    """
    articles = articles_of(root)
    template = inside if articles else outside
    gone = () if articles else _furniture(root)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if t := " ".join("".join(run).split()):
            blocks.append(t)
        run.clear()

    todo: list[Node | str | None] = list(reversed(articles)) or [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop or template and x.digest in template or id(x) in gone:
            flush() if x.tag in BLOCK else None
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return "\n".join(blocks)


def subtrees(html: str | None) -> tuple[int, list[int], list[int]]:
    """(digest of the page's text, subtrees inside its articles, subtrees outside them), each once."""
    root = parse(html or "")
    nodes = _digests(root)
    articles = articles_of(root)
    inner = [n for a in articles for n in _walk(a)]
    within = {id(n) for n in inner}
    inside = {n.digest for n in inner} - {a.digest for a in articles} - {0}
    outside = {n.digest for n in nodes if id(n) not in within} - {0, root.digest}
    return xxh64_intdigest(main_text(root)) & 0x7FFFFFFFFFFFFFFF, sorted(inside), sorted(outside)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return clash_free(pages, "page_id", "url", "html").withColumn("host", F.coalesce(host, F.lit("")))


def templates(pages: DataFrame, least: int = LEAST_PAGES, inside: float = SHARE_INSIDE, outside: float = SHARE_OUTSIDE) -> DataFrame:
    """(host, inside, outside): the digests that are template on a host within articles and elsewhere, as two arrays a host.

    Their length is bounded by the subtrees of a page over the least share. A page counts once
    for all copies of its text, and so does a subtree within a page; pages without html count
    as one empty page.
    """

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        hosts, texts_, digests, places = [], [], [], []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text, within, without = subtrees(html)
            rows = [(0, 0), *((d, 1) for d in within), *((d, 2) for d in without)]
            hosts += [host] * len(rows)
            texts_ += [text] * len(rows)
            digests += [d for d, _ in rows]
            places += [p for _, p in rows]
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts_, pa.int64()), pa.array(digests, pa.int64()), pa.array(places, pa.int8())], names=["host", "page", "digest", "place"])

    found = per_batch(with_host(pages).select("host", "html"), kernel, "host string, page bigint, digest bigint, place tinyint")
    counts = found.distinct().groupBy("host", "digest", "place").count().where(F.col("count") >= least)
    counts = stored(counts, "subtrees")
    totals = counts.where("place = 0").select("host", F.col("count").alias("total"))
    if totals.count() <= BROADCAST_HOSTS:
        totals = F.broadcast(totals)
    share = F.when(F.col("place") == 1, inside).otherwise(outside)
    many = counts.where("place > 0").join(totals, "host").where(F.col("count") >= share * F.col("total"))
    at = lambda place: F.collect_set(F.when(F.col("place") == place, F.col("digest")))
    return many.groupBy("host").agg(at(1).alias("inside"), at(2).alias("outside"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    A null or empty html gives an empty text. Pages without a readable host share the empty
    host. Long pages are parsed whole, in time in proportion to their length. Repeated rows
    give repeated rows, an empty table an empty one; no column but page_id, url and html is
    looked at.
    """
    spark, known = pages.sparkSession, stored(templates(pages), "templates")
    rows = with_host(pages).select(F.col("page_id").cast("bigint"), "url", "html", "host")
    size = known.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("inside") + F.size("outside")), F.lit(0)).alias("subtrees")).first()
    if size.hosts <= BROADCAST_HOSTS and size.subtrees <= BROADCAST_SUBTREES:
        shared = spark.sparkContext.broadcast({r.host: (frozenset(r.inside), frozenset(r.outside)) for r in known.toLocalIterator()})
        return per_batch(rows, lambda b: _extracted(b, shared.value), EXTRACTED)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for host, inside, outside in zip(b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
            if host not in sets:
                sets[host] = frozenset(inside.as_py() or ()), frozenset(outside.as_py() or ())
        return _extracted(b, sets)

    return per_batch(rows.join(known, "host", "left").select("page_id", "url", "html", "host", "inside", "outside"), kernel, EXTRACTED)


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def _extracted(b: pa.RecordBatch, sets: dict[str, tuple[frozenset[int], frozenset[int]]]) -> pa.RecordBatch:
    out = []
    for html, host in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
        root = parse(html or "")
        inside, outside = sets.get(host, (frozenset(), frozenset()))
        if inside or outside:
            _digests(root)
        out.append(main_text(root, inside, outside))
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])
