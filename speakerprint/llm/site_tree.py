"""HTML extraction by site style trees.

The pages of one host are merged into a tree of style nodes: a node is a path of elements from the
body down, each named by its tag and its class, id and role. For every node the tree keeps how many
different pages have it, how its content varies over them (entropy of content digests to the base of the page
count), how its presentation varies (entropy of the children's tags) and which part of its text is
links. Importance is content and presentation variety, less the share of links. A branch whose node and all
nodes below are of low importance is removed from every page of the host, but never all the text of a page. Equal pages of a host
(mirrors, repeated rows) count once, and what names set apart counts for no node above it.

Entropy alone cannot see an advert whose text differs on every page, nor that an article is one although
a whole host repeats it; so names weigh as well. Elements that HTML or a word of their class, id or role
names as navigation, notice, advert, form or comments are set apart. Where a page has article or main
elements, only those are read and nothing in them is removed by importance. An element that holds the only articles of a page, or
most of its text outside of links, is not set apart for its name (a page wrapped in a form, a class of the body).

* Of several articles of a page those count that have a quarter of the longest one's text at least (others are teasers); an
  article inside a comment section is none. A main element is read instead of its articles if they hold less than half of its text.
* A word of a class is a whole one, or one made of such words and words of place (``site-nav``, ``left_sidebar``); ``has-``, ``no-``, ``with-``
  and the like in front say nothing of the element.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by two line feeds. A null or empty page has the empty text. Repeated pages are extracted one by one.
Pages with a null URL form one host. Pages are read whole, in time that follows their length, however deep their elements lie. An empty table gives
no rows. Other columns of the input do not reach the result, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import content_key, map_batches, materialised

#: Fixed names of HTML: elements without content, with raw content, that start a block, that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset(
    "head nav footer aside form header script style textarea title iframe noembed noframes xmp template svg button select"
    " option input label dialog menu embed canvas audio video map".split()
)
#: Fixed: words in class, id and role that name a part beside the article, words that such a name may hold besides, and words that turn it.
PART = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus"
    " breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login search share sharing social related recommended comment comments commentlist replies reply disqus respond pagination pager"
    " skiplink contentinfo complementary legal copyright widget widgets header hidden".split()
)
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global local mobile desktop area box bar list section container wrapper wrap inner outer block item items group links link buttons"
    " icons media post posts article entry user reader skip ad header footer form thread google the and fixed sticky slot unit space label 0".split()
)
#: A name with the word header is one of the site's only if it is made of these.
HEADER = frozenset("header site page global main top".split())
TURNED = frozenset("no has with without is not non hide show format type single".split())
COMMENTS = frozenset("comment comments commentlist replies reply disqus respond".split())
#: Elements whose text is never shown as text, whatever they hold.
HIDDEN = frozenset("head script style textarea title iframe noembed noframes xmp template svg button select option input".split())
#: Of the longest article's text, what another one needs to count.
TEASER = 0.25
#: Elements that an opening tag closes, up to the element that holds them. Fixed by HTML's syntax.
CLOSES = {
    **{t: frozenset({"p"}) for t in BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "summary"}},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
HOLDS = frozenset("ul ol dl table article section div main body html aside nav header footer form blockquote td th button select menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Pages of a host that a node needs before its entropy counts, and the importance below which a branch goes.
MIN_PAGES = 8
LOW = 0.2


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _words(named: str) -> Iterator[frozenset[str]]:
    """Words of each class, id or role, if it is made of words that name a part; ``MainMenu`` counts as ``main-menu``."""
    for token in named.split():
        parts = [w for w in re.split(r"[-_:]+", re.sub(r"[0-9]+", "0", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token)).lower()) if w]
        if parts and parts[0] not in TURNED and any(w in PART for w in parts) and all(w in PART or w in BESIDE for w in parts):
            yield frozenset(parts)


class Page:
    """Elements of a page in the order they open, each with its parent, and runs of text in page order.

    Lists by element: ``parent``, ``tag``, ``name`` (of its style), ``key`` (of its path of styles), ``apart`` (set apart by itself) and ``comments``
    (as a comment section). ``runs`` has (element, in a link, text, block).
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.name, self.key, self.apart, self.comments = [-1], [""], [""], [0], [False], [False]
        self.runs: list[tuple[int, bool, str, int]] = []
        self._read(page)

    def _open(self, parent: int, tag: str, attributes: str, in_article: bool) -> int:
        name, apart, comments = tag, tag in APART, False
        if attributes.strip():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMES.finditer(attributes)}
            named = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
            words = [w for w in _words(named) if tag not in ("html", "body", "main")]
            words = [w for w in words if w & PART != {"header"} or not in_article and w <= HEADER]
            if tag == "header" and in_article and not words:
                apart = False
            comments = any(w & COMMENTS for w in words)
            apart = apart or "hidden" in found or found.get("aria-hidden") == "true" or bool(words)
            name = f"{tag}.{re.sub(r'[0-9]+', '0', named)}" if named else tag
            if "main" in found.get("role", "").split() and tag != "article":
                tag = "main"
        elif tag == "header" and in_article:
            apart = False
        self.parent.append(parent)
        self.tag.append(tag)
        self.name.append(name)
        self.key.append(xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), self.key[parent]))
        self.apart.append(apart)
        self.comments.append(comments)
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        # Open elements: tag, number, in a link, in an article; and by tag where they lie in the stack.
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        places: dict[str, list[int]] = {}
        block, at, n = 0, 0, len(page)

        def cut(depth: int) -> None:
            for tag, *_ in stack[depth:]:
                places[tag].pop()
            del stack[depth:]

        while at < n:
            m = TOKEN.match(page, at)
            at = m.end()
            end, tag, attributes, text = m[1], m[2], m[3], m[4]
            if text is not None:
                self.runs.append((stack[-1][1], stack[-1][2], text, block))
            elif tag:
                tag = tag.lower()
                closes = CLOSES.get(tag)
                if closes:
                    floor = max((places[h][-1] for h in HOLDS - closes if places.get(h)), default=0)
                    # The outermost of these above the floor, as places rise within a tag.
                    first = min((at_[bisect_right(at_, floor)] for t in closes if (at_ := places.get(t)) and at_[-1] > floor), default=None)
                    if first is not None:
                        cut(first)
                if tag in BLOCK:
                    block += 1
                elif tag == "br":
                    self.runs.append((stack[-1][1], stack[-1][2], " ", block))
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                    at = page.find(">", close.end()) + 1 or n if close else n
                elif tag not in VOID and not attributes.endswith("/"):
                    _, parent, link, article = stack[-1]
                    i = self._open(parent, tag, attributes, article)
                    places.setdefault(tag, []).append(len(stack))
                    stack.append((tag, i, link or tag == "a", article or tag in ("article", "main")))
            elif end:
                end = end.lower()
                if places.get(end):
                    cut(places[end][-1])
                if end in BLOCK:
                    block += 1

    def down(self, own: list) -> list:
        """For every element whether it or one above it has a flag."""
        out = [own[0]]
        for i in range(1, len(own)):
            out.append(own[i] or out[self.parent[i]])
        return out

    def sizes(self, apart: list[bool]) -> list[int]:
        """Characters of text outside of links in and below each element, without what is set apart (below it, or as a whole)."""
        out = [0] * len(self.tag)
        for i, link, text, _ in self.runs:
            if not link:
                out[i] += len(text.strip())
        for i in range(len(out) - 1, 0, -1):
            if not apart[i]:
                out[self.parent[i]] += out[i]
        return out

    def settle(self) -> None:
        """Names do not set apart what holds the only articles of the page, or most of its text outside of links."""
        articles = [i for i, t in enumerate(self.tag) if t in ("article", "main") and not self.apart[i]]
        hidden = [t in HIDDEN for t in self.tag]
        if articles:
            above = self.down(self.apart)
            whole = self.sizes(hidden)
            if not any(not above[i] and whole[i] for i in articles):
                beside = self.down([c or h for c, h in zip(self.comments, hidden)])
                best = max((i for i in articles if whole[i] and not beside[i]), key=lambda i: whole[i], default=None)
                while best is not None and best > 0:
                    best = self.parent[best]
                    self.apart[best] = False
            return
        # Most of the text: what lies in an element that is only apart by its tag or class, against the rest of the page.
        size = self.sizes([h or (a and c) for h, a, c in zip(hidden, self.apart, self.comments)])
        for i in range(1, len(self.tag)):
            if self.apart[i] and not hidden[i] and not self.comments[i] and self.tag[i] not in ("nav", "menu", "footer", "aside", "dialog", "label") and 2 * size[i] > size[0]:
                self.apart[i] = False

    def region(self, apart: list[bool]) -> list[bool]:
        """For every element whether the article is in it: it, or one above, is a chosen article or main element."""
        size = self.sizes(apart)
        kinds: dict[str, list[int]] = {"article": [], "main": []}
        for kind, chosen in kinds.items():
            inside = self.down([t == kind and not a for t, a in zip(self.tag, apart)])
            chosen += [i for i in range(1, len(self.tag)) if self.tag[i] == kind and not apart[i] and not inside[self.parent[i]] and size[i]]
        most = max((size[i] for i in kinds["article"]), default=0)
        articles = [i for i in kinds["article"] if size[i] >= TEASER * most]
        mains = kinds["main"]
        if mains and 2 * sum(size[i] for i in articles) < sum(size[i] for i in mains):
            articles = mains
        own = [False] * len(self.tag)
        for i in articles or [0]:
            own[i] = True
        return self.down(own)


def read_page(page: str) -> tuple[Page, list[bool], list[bool]]:
    """A page, and for its elements whether they are set apart and whether they lie in the article."""
    read = Page(page)
    read.settle()
    apart = read.down(read.apart)
    return read, apart, read.region(apart)


def blocks_of(found: list[tuple[int, bool, str, int]]) -> str:
    """Text of the runs: one line feed pair between blocks, one space for white space within."""
    out, last = [], None
    for *_, text, block in found:
        if block != last:
            out.append([])
            last = block
        out[-1].append(text)
    return "\n\n".join(t for b in out if (t := " ".join(html.unescape("".join(b)).split())))


def _signed(x: int) -> int:
    return x - (1 << 63)


def node_rows(page: str) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Per style node of a page: node, role, content digest, presentation digest, characters, characters in links.

    The role is 1 for a node of an article, else 0. What is set apart has no node. Digests are made from the
    innermost elements out, each once.
    """
    read, apart, region = read_page(page)
    whole = any(t in ("article", "main") for t in read.tag)
    n = len(read.tag)
    digest, chars, links = [0] * n, [0] * n, [0] * n
    for i, link, text, _ in read.runs:
        text = " ".join(text.split())
        if text and not apart[i]:
            digest[i] = (digest[i] * _BASE + xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))) & _MASK
            chars[i] += len(text)
            links[i] += len(text) if link else 0
    nodes: dict[int, list] = {}
    for i in range(n - 1, 0, -1):
        if apart[i]:
            continue
        up, key = read.parent[i], read.key[i]
        digest[up] = (digest[up] * _BASE + (digest[i] ^ key)) & _MASK
        chars[up] += chars[i]
        links[up] += links[i]
        node = nodes.setdefault(key, [0, 0, 0, 0, 0])
        node[0] |= int(whole and region[i])
        node[1] = (node[1] + (digest[i] * _BASE ^ digest[i] >> 29)) & _MASK
        node[3] += chars[i]
        node[4] += links[i]
        if up:
            parent = nodes.setdefault(read.key[up], [0, 0, 0, 0, 0])
            parent[2] |= 1 << (xxhash.xxh32_intdigest(read.name[i].encode("utf-8", "replace")) % 63)
    for key, (role, content, style, size, linked) in nodes.items():
        yield _signed(key), role, _signed(content), style, size, linked


NODES = "host string, page binary, node bigint, role bigint, content bigint, style bigint, chars bigint, links bigint"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; the whole value where it has none, empty for null."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:/?#]*:?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), url, F.lit("")))


def style_nodes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row per different page of a host and style node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns = [batch.column(c).to_pylist() for c in ("host", "page", "html")]
        rows = [(h, k, *r) for h, k, t in zip(*columns) if t for r in node_rows(t)]
        if not rows:
            return None
        kinds = [pa.string(), pa.binary(), *[pa.int64()] * 6]
        names = ["host", "page", "node", "role", "content", "style", "chars", "links"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    chosen = pages.select(host_of(F.col(url)).alias("host"), content_key(F.col(page)).alias("page"), F.col(page).alias("html"))
    return map_batches(chosen, run, NODES).distinct()


def site_tree(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, node, role, pages, content_entropy, style_entropy, link_share, importance) of every style node.

    Digests are counted first, so that what meets per node is their counts; a host with a third of
    all pages is many (node, digest) groups.
    """
    rows = style_nodes(pages, url, page)
    counted = rows.groupBy("host", "node", "content", "style").agg(
        F.max("role").alias("role"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    contents = counted.groupBy("host", "node", "content").agg(F.max("role").alias("role"), *[F.sum(c).alias(c) for c in ("n", "chars", "links")])
    entropy = F.when(F.sum("n") > 1, 1 - F.sum(F.col("n") * F.log("n")) / F.sum("n") / F.log(F.sum("n"))).otherwise(F.lit(1.0))
    by_content = contents.groupBy("host", "node").agg(
        F.max("role").alias("role"), F.sum("n").alias("pages"), entropy.alias("content_entropy"),
        (F.sum("links") / F.greatest(F.sum("chars"), F.lit(1))).alias("link_share"),
    )
    styles = counted.groupBy("host", "node", "style").agg(F.sum("n").alias("n"))
    by_style = styles.groupBy("host", "node").agg(entropy.alias("style_entropy"))
    importance = F.greatest("content_entropy", "style_entropy") * (1 - F.col("link_share"))
    fixed = F.when((F.col("role") != 0) | (F.col("pages") < MIN_PAGES), F.lit(1.0))
    return by_content.join(by_style, ["host", "node"]).withColumn("importance", fixed.otherwise(importance))


def low_branches(tree: DataFrame, low: float = LOW) -> DataFrame:
    """(host, low): nodes of low importance of each host."""
    return tree.where(F.col("importance") < low).groupBy("host").agg(F.collect_set("node").alias("low"))


def main_text(page: str | None, low: set[int] = frozenset()) -> str:
    """Text of one page without the branches whose nodes are all in ``low``."""
    read, apart, region = read_page(page or "")
    found = [r for r in read.runs if region[r[0]] and not apart[r[0]]]
    if low and not any(t in ("article", "main") for t in read.tag):
        n = len(read.tag)
        whole = [i > 0 and _signed(read.key[i]) in low for i in range(n)]
        for i in range(n - 1, 0, -1):
            if not whole[i] and not apart[i]:
                whole[read.parent[i]] = False
        gone = read.down(whole)
        kept = [r for r in found if not gone[r[0]]]
        found = kept if any(not r[2].isspace() for r in kept) else found
    return blocks_of(found)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", low: float = LOW) -> DataFrame:
    """(page_id, url, text, host) of every page."""
    tree = materialised(site_tree(pages, url, page), "site-tree")
    chosen = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    joined = chosen.join(low_branches(tree, low), "host", "left").select("page_id", "url", "host", "low", "html")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, set(x or ())) for h, x in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "url", "host")], pa.array(texts, pa.string())], names=["page_id", "url", "host", "text"])

    return map_batches(joined, run, "page_id bigint, url string, host string, text string")
