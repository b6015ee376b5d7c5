"""Main text of web pages by site style trees.

The element trees of all pages of one host are merged: elements with equal paths of
tags and classes are one node.  A node's presentation importance is the entropy of its
children's arrangement over the pages that have it, and its content importance is one
less the mean entropy of its blocks of text: a block that every page repeats tells
nothing.  Both are to the base of the number of pages and `prior` more, so that what few
pages share counts little; they are combined as in site style trees (Yi, Liu and Li,
2003).  Branches whose nodes are all of low importance are noise and go, inside marked
articles and outside.  Pages of equal main text count once, and named noise doesn't.

The tree can't tell a site's menu from its articles on a host of one page, nor adverts
that change from page to page.  So what a site's author names as navigation, advert,
form and so on goes by its name too (a whole class, id or role), unless that branch
holds the page's only article or, where none is marked, most of its text; and where a
page marks its article, what stands outside goes.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import batches as B

PRIOR, LEAST_IMPORTANCE, DECAY = 3.0, 0.2, 0.9
#: Open elements at once; deeper ones are read as if they stood there, as browsers do.
DEPTH = 512
#: Rows of (host, path) that are sent to every task; beyond, pages are dealt out by host.
BROADCAST_ROWS, HOST_SALT = 100_000, 32

#: What follows = is a value in quotes if they are closed; nothing is read twice (the groups give nothing back).
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
#: Only here, and within them, does a slash at a tag's end close the element.
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that never hold main text.
NOISE_TAGS = frozenset("head script style noscript template iframe svg math object embed nav footer aside form button select option datalist input dialog menu canvas audio video map".split())
#: Words of classes, ids and roles that name noise.
NOISE_NAMES = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead banner topbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert alertdialog popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations comments comment commentlist disqus respond reply replies widget pagination pager skip skiplink toolbar search complementary contentinfo".split())
#: Words that name noise as the first part of a name with hyphens (as the last part all of the above do); first parts that say what a page has or lacks; last parts that name what holds text.
NOISE_STARTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr newsletter comment comments disqus sidebar nav navbar footer breadcrumb breadcrumbs related recommended share sharing social popup modal".split())
STATES = frozenset("no not has have with without hide show is".split())
HOLDERS = frozenset("article body content main text page layout".split())
HEADER_NAMES = frozenset("header head sitehead pageheader siteheader".split())
#: An opening tag ends open elements of these kinds, up to the nearest element that may hold it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
HOLDS = frozenset("ul ol dl table tbody thead tr div section article main body td th blockquote".split())


@lru_cache(maxsize=1 << 16)
def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Element:
    tag: str
    path: int
    parent: Element | None
    above: tuple[int, ...]  # paths, from the root to this element
    children: list[str] = field(default_factory=list)
    in_article: bool = False
    noise: bool = False
    says: Opening | None = None
    links: int = 0
    link_chars: int = 0
    chars: int = 0


@dataclass
class Page:
    elements: list[Element]
    blocks: list[tuple[Element, str]]


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): markup.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(text)}


@dataclass(frozen=True)
class Opening:
    """What an opening tag says by itself."""

    key: str
    article: bool
    noise: bool
    named: bool
    header: bool


def _names_noise(name: str) -> bool:
    """A name that is a word for noise, or is put together with one: `main-nav`, `comment-list`; not `has-sidebar` or `share-text`."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    if len(parts) < 2:
        return name in NOISE_NAMES
    return parts[0] not in STATES and (parts[-1] in NOISE_NAMES or parts[0] in NOISE_STARTS and parts[-1] not in HOLDERS)


@lru_cache(maxsize=1 << 14)
def opening(tag: str, written: str) -> Opening:
    attributes = _attributes(written) if written.strip() else {}
    named = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop"))
    names = frozenset(named.lower().split())
    article = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "").lower()))
    header = (tag == "header" or bool(names & HEADER_NAMES)) and not article and tag not in ("h1", "h2", "h3")
    noise = tag in NOISE_TAGS and tag != "form" or tag not in ("html", "body") and hidden
    by_name = tag == "form" or tag not in ("html", "body") and any(map(_names_noise, names))
    return Opening(f"{tag}.{' '.join(sorted(set(attributes.get('class', '').split())))}", article, noise, by_name, header)


def _element(tag: str, written: str, parent: Element | None) -> Element:
    says = opening(tag, written)
    path = _hash(parent.path if parent else 0, says.key)
    out = Element(tag, path, parent, (*(parent.above if parent else ()), path), says=says)
    if parent:
        parent.children.append(says.key)
    return out


def _mark(page: Page) -> Page:
    """Sets what is noise and what stands in an article."""

    def mark(spared: frozenset[int]) -> None:
        for e in page.elements:  # parents come first
            up, says = e.parent, e.says
            within = up is not None and up.in_article
            by_name = says.named or says.header and not within and e.tag not in ("html", "body")
            e.noise = bool(up and up.noise) or says.noise or by_name and id(e) not in spared
            e.in_article = within or says.article and not e.noise

    mark(frozenset())
    if any(e.in_article and not e.noise for e, _ in page.blocks):
        return page
    strict: set[int] = set()
    for e in page.elements:
        if e.says.noise or id(e.parent) in strict:
            strict.add(id(e))
    open_blocks = [(e, len(t)) for e, t in page.blocks if id(e) not in strict]
    chars: dict[int, int] = {}
    articles: set[int] = set()
    for owner, n in open_blocks:
        e, held = owner, False
        while e is not None:
            held = held or e.says.article
            chars[id(e)] = chars.get(id(e), 0) + n
            if held:
                articles.add(id(e))
            e = e.parent
    most = sum(n for _, n in open_blocks) / 2
    spared = articles or {k for k, n in chars.items() if n > most}
    mark(frozenset(spared))
    return page


def parse(text: str) -> Page:
    """The elements of a page and its blocks of text, in order. Markup that is broken off or badly nested is read as far as it goes."""
    root = _element("#page", "", None)
    elements, blocks, stack = [root], [], [root]
    held: list[str] = []
    links = [0, 0]  # characters within links, in the block so far; depth

    def flush() -> None:
        block = " ".join(markup.unescape("".join(held)).split())
        if block:
            owner = next(e for e in reversed(stack) if e.tag not in INLINE)
            blocks.append((owner, block))
            e: Element | None = owner
            while e is not None:
                e.chars += len(block)
                e.link_chars += min(links[0], len(block))
                e = e.parent
        held.clear()
        links[0] = 0

    def add(piece: str) -> None:
        held.append(piece)
        if links[1]:
            links[0] += len(piece.strip())

    def pop(k: int) -> None:
        for e in stack[k:]:
            if e.tag == "a":
                links[1] -= 1
        del stack[k:]

    at = 0
    while True:
        less = text.find("<", at)
        if less < 0:
            add(text[at:])
            break
        if less > at:
            add(text[at:less])
        found = _TAG.match(text, less)
        if found is None:
            if re.match(r"</?[a-zA-Z]", text[less : less + 3]):
                break  # a tag that is broken off: it has no end up to the page's
            add("<")
            at = less + 1
            continue
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        block = tag not in INLINE
        if block:
            flush()
        if found[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k and (block or all(e.tag in INLINE for e in stack[k:])):
                pop(k)
            continue
        if tag == "p" or block and tag not in VOID:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in HOLDS), 0)
            if k and stack[k].tag == "p":
                pop(k)
        for kind in CLOSES.get(tag, ()):
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == kind or stack[i].tag in HOLDS and stack[i].tag not in CLOSES[tag]), 0)
            if k and stack[k].tag == kind:
                pop(k)
        if tag == "br":
            add(" ")
        if tag in VOID or found[3].endswith("/") and (tag in FOREIGN or any(e.tag in FOREIGN for e in stack)):
            continue
        if len(stack) > DEPTH and tag not in RAW:
            pop(len(stack) - 1)
        element = _element(tag, found[3], stack[-1])
        if tag in RAW:
            end = RAW_END[tag].search(text, at)
            at = end.end() if end else len(text)
            continue
        elements.append(element)
        stack.append(element)
        if tag == "a":
            links[1] += 1
            for e in stack:
                e.links += 1
    flush()
    return _mark(Page(elements, blocks))


def main_text(page: Page, low: frozenset[int] = frozenset()) -> str:
    """The blocks that stand in no noise and in no branch of low importance, one a line."""

    def kept(e: Element) -> bool:
        return not e.noise and not any(p in low for p in e.above)

    def menu(e: Element | None) -> bool:
        while e is not None and e.tag not in ("article", "main", "body", "html", "#page"):
            if e.tag in ("ul", "ol", "div", "section", "table") and e.links >= 3 and e.link_chars >= 0.8 * e.chars:
                return True
            e = e.parent
        return False

    inside = [b for b in page.blocks if b[0].in_article and not b[0].noise]
    chosen = [b for b in inside or page.blocks if kept(b[0])]
    return "\n".join(text for e, text in chosen if e.in_article or not menu(e))


def _host(url: str | None) -> str | None:
    found = re.match(r"(?:[a-zA-Z][-+.\w]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else None


def _host_column(url: str):
    host = F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][-+.\w]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def _page_key(page: Page) -> int:
    """Equal for pages whose articles, or whole texts where none is marked, are equal."""
    counted = [b for b in page.blocks if not b[0].noise]
    return _hash("page", *(t for _, t in [b for b in counted if b[0].in_article] or counted))


def describe_nodes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """One row for each node of each page that has a host: its arrangement of children (kind s), and its distinct blocks of text (kind t). Equal pages of a host are one."""
    node = pa.struct([("path", pa.int64()), ("above", pa.list_(pa.int64())), ("kind", pa.string()), ("value", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, nodes = batch["host"].to_pylist(), [], []
            for text in batch["html"].to_pylist():
                page = parse(text or "")
                judged = [e for e in page.elements if not e.noise]
                own = {e.path: e for e in judged}
                styles: dict[int, list[str]] = {}
                for e in judged:
                    styles.setdefault(e.path, []).append(" ".join(k for i, k in enumerate(e.children) if i == 0 or k != e.children[i - 1]))
                rows = [(p, list(own[p].above), "s", _hash(*s)) for p, s in styles.items()]
                rows += [(p, None, "t", h) for p, h in {(e.path, _hash(t)) for e, t in page.blocks if not e.noise}]
                keys.append(_page_key(page))
                nodes.append([dict(zip(("path", "above", "kind", "value"), r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(nodes, pa.list_(node))], names=["host", "page", "nodes"])

    source = pages.select(_host_column(url_col).alias("host"), F.col(html_col).alias("html")).where("host is not null")
    once = source.mapInArrow(apply, "host string, page bigint, nodes array<struct<path: bigint, above: array<bigint>, kind: string, value: bigint>>").groupBy("host", "page").agg(F.min("nodes").alias("nodes"))
    return once.select("host", F.explode("nodes").alias("x")).select("host", "x.*")


def node_importance(nodes: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(host, path, above, pages, importance) of every node of the hosts' style trees."""
    counted = B.checkpoint(nodes.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("above")))
    styles = counted.where("kind = 's'")
    pages = styles.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("styles"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("above").alias("above"))
    base = F.log(F.col("pages") + prior)
    presentation = (base - F.col("s") / F.col("pages")) / base  # entropy log(pages) - s / pages, and what the prior adds
    pages = pages.withColumn("presentation", presentation)
    blocks = B.spread_join(counted.where("kind = 't'"), pages.select("host", "path", "pages"), ["host", "path"], F.col("value"))
    entropy = F.least(F.lit(1.0), F.log("n") / F.log(F.col("pages") + prior))
    own = blocks.groupBy("host", "path").agg(F.sum("n").alias("blocks"), F.sum(F.col("n") * entropy).alias("repeated"))
    below = pages.join(own, ["host", "path"]).select("host", F.explode("above").alias("path"), "blocks", "repeated").groupBy("host", "path").agg(F.sum("blocks").alias("blocks"), F.sum("repeated").alias("repeated"))
    share = F.pow(F.lit(DECAY), F.col("styles"))
    content = 1 - F.col("repeated") / F.col("blocks")
    return pages.join(below, ["host", "path"]).select("host", "path", "above", "pages", ((1 - share) * F.col("presentation") + share * content).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", prior: float = PRIOR, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """id, url, text (empty if there is none) and n_chars of each page.

    A null html is empty.  Pages whose url is null or has no host are trees of their
    own, in which every node counts.  Rows with null or repeated ids are pages like any
    other; equal pages get equal texts.  Pages are read whole, whatever their length, and
    those that are broken off as far as they go.  Other columns are left out, whatever
    their names.  An empty table gives an empty table.
    """
    pages = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    tree = node_importance(describe_nodes(pages, "url", "html"), prior)
    tree = B.checkpoint(tree.withColumn("low", F.col("importance") < least_importance))
    kept = tree.where(~F.col("low")).select("host", F.explode("above").alias("path")).distinct()  # a branch goes only if all of it is low
    low = B.checkpoint(tree.where("low").join(kept, ["host", "path"], "left_anti").groupBy("host").agg(F.collect_set("path").alias("low")))
    page = pages.select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), "html", _host_column("url").alias("host"))
    size = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        joined = page.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALT - 1))))
        joined = page.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(HOST_SALT)).cast("int")).join(salted, ["host", "salt"], "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parse(h or ""), frozenset(x or ())) for h, x in zip(batch["html"].to_pylist(), batch["low"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return joined.select("id", "url", "html", "low").mapInArrow(apply, f"`{id_col}` bigint, url string, text string, n_chars bigint")
