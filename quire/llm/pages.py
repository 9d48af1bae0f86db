"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text in their blocks, less that in links, outside of boilerplate; the best
one's path of tags and generalised classes is the page's vote. Spark counts the votes of each host. Every page is then
extracted again from the container at its host's winning path, or from its own best where it has none there.

Boilerplate by tag or role (menus, footers, asides, forms) always goes, and so does a header, unless it is in an article
or holds a title within the winning container. A class or id only suggests it, for containers and lists alone: by its
last word (`site-footer`), or by another one before a word for a holder (`ad-container`); never by a word before the name
of a subject (`related-work`, `menu-planning`), an ordinary noun after one (`binary-search`), or where a word says that it
describes a layout (`with-sidebar`). An element so marked stays if nearly all of the page's text is in it, so a page
never loses its article to the name of a wrapper. The work is linear in the page, however deep its elements nest.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.joins import by_counted_key
from quire.llm.text import slices, whole
from quire.session import cut

BATCH_ROWS = 500
#: Winning paths of so many bytes in all are broadcast; more meet the pages by shuffle.
MOST_BYTES = 8 << 20

# Elements by their part in a page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes template svg".split())
DROPPED = frozenset("nav footer aside menu dialog button select fieldset head".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header address hgroup details summary center form".split()
) | DROPPED
CONTAINERS = frozenset("body article main section div td center".split())
#: A start tag of the first kind ends open elements of the second, within the nearest of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
BOILERPLATE = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidenav footer masthead topbar header "
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored banner promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations pagination pager toolbar widget widgets search skip".split()
)
#: Words of BOILERPLATE that are ordinary nouns too; after an ordinary word (`binary-search`) they say nothing.
NOUNS = frozenset("menu menus banner promotion consent notice notices notification alert popup social related share sharing search skip login modal header".split())
#: Words for a place on a page, with which NOUNS do say something (`site-search`).
PLACES = frozenset("site page top bottom left right main primary secondary global mobile desktop sticky fixed floating inline mini box quick cookie privacy user account".split())
#: Last words that only say what holds a thing (`ad-container`); after another last word a name is of its content (`related-work`).
HOLDERS = frozenset(
    "container wrapper wrap inner outer box block area list lists item items link links button buttons bar icon icons post posts article articles story stories "
    "section slot slots unit zone region panel group col column left right top bottom form content body text title heading row grid wide tall large small".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
LAYOUT = frozenset("with without has no not is layout".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WEIGHTS = {"article": 1.6, "main": 1.4, "section": 1.0, "div": 1.0, "td": 0.9, "center": 0.9, "body": 0.8, "": 0.8}
GOOD = frozenset("content article post entry story main body text".split())

#: A container without a title gives way to one around it that has one, and at most this share more text.
TITLE_SHARE = 0.15
#: How an element is marked, and how much text may stand outside of it, as a share of its own, if it is to stay.
PLAIN, HINTED, NAMED, TALK, HEAD, CERTAIN = range(6)
#: Elements whose class or id may hint; headings, paragraphs and quotations stay whatever their name.
HINTABLE = CONTAINERS | frozenset("ul ol dl table tbody tr form details header footer".split())
#: Whether an element goes: HELD ones are a header that stays in a winning container, as its title.
STAYS, GOES, HELD = range(3)
OUTSIDE = {HINTED: 1.0, NAMED: 0.2, TALK: 0.0}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A block element: its place in the tree, how it is marked, and what its subtree holds."""

    __slots__ = ("tag", "path", "parent", "mark", "inside", "good", "first", "last", "text", "links", "depth", "dropped", "own", "own_links", "titled")

    def __init__(self, tag, path, parent, mark, good, first):
        self.tag, self.path, self.parent, self.mark, self.good, self.first = tag, path, parent, mark, good, first
        self.last, self.text, self.links, self.own, self.own_links, self.dropped = -1, 0, 0, 0, 0, STAYS
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent) and (parent.inside or parent.tag in ("article", "main"))


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw) if raw and not raw.isspace() else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _named(parts: list[str], good: bool) -> int:
    """What the words of one class or id say."""
    *first, last = parts
    if not LAYOUT.isdisjoint(parts):
        return PLAIN
    held = last in HOLDERS
    if last in COMMENTS or (held and parts[0] in COMMENTS):
        return TALK
    if last in BOILERPLATE:
        clear = last not in NOUNS or not first or not (PLACES | BOILERPLATE | HOLDERS).isdisjoint(first)
        return NAMED if clear else PLAIN
    return HINTED if held and not good and not BOILERPLATE.isdisjoint(first) else PLAIN


def mark_of(tag: str, attrs: dict[str, str], within: Node) -> int:
    """How surely an element is boilerplate."""
    if tag in DROPPED:
        return CERTAIN
    found = NAMED if tag == "form" else PLAIN
    if tag == "header" and not (within.inside or within.tag in ("article", "main")):
        found = HEAD
    if not attrs or tag in ("html", "body", "article", "main"):
        return found
    if ("hidden" in attrs and attrs["hidden"].lower() != "until-found") or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return CERTAIN
    if tag not in HINTABLE:
        return found
    names = [[p.lower() for p in NAME_PARTS.findall(name)] for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split()]
    good = any(len(parts) == 1 and parts[0] in GOOD for parts in names)
    if found == HEAD and any(not PLACES.isdisjoint(parts) for parts in names):
        return CERTAIN
    for parts in names:
        if parts and parts[-1] == "header":
            if found == HEAD and parts[0] in GOOD:
                found = PLAIN
            if tag == "header" or within.tag == "header" or within.inside or parts[0] in GOOD:
                continue  # the head of an article
        found = max(found, _named(parts, good) if parts else PLAIN)
    return found


def parse(page: str) -> tuple[list[tuple[str, Node]], list[Node]]:
    """Blocks of text in page order, each with its element, and all block elements in order of their start tags.

    Elements that are boilerplate for certain have no blocks; of the others it is settled at the end, when all sums are
    known.
    """
    root = Node("", 0, None, PLAIN, False, 0)
    here, nodes, blocks, buffer = root, [root], [], []
    open_at: dict[str, list[int]] = {}  # by tag: the depths of its open elements
    sure = 0  # open elements that are boilerplate for certain
    unended: set[str] = set()
    in_link = at = n_links = 0
    size = len(page)

    def flush():
        nonlocal n_links
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((text, here))
                here.own += len(text)
                here.own_links += min(n_links, len(text))
        n_links = 0

    def add(text: str):
        nonlocal n_links
        if text and not sure:
            text = entities.unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                n_links += len(text)

    def close(depth: int):
        """All open elements from this depth on."""
        nonlocal here, sure
        flush()
        while here.depth >= depth:
            here.last = len(blocks)
            open_at[here.tag].pop()
            sure -= here.mark == CERTAIN
            here = here.parent

    def deepest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < size:
        tag = TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            if name == "a":
                in_link = 0
            elif name in BLOCKS:
                if depth := deepest((name,)):
                    close(depth)
                else:
                    flush()
            continue
        raw = tag[3] if tag[2] else tag[6]
        if name in RAW:
            if raw.rstrip().endswith("/") and name not in ("script", "style", "title", "textarea"):
                continue
            end = None if name in unended else re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:  # a script runs to the end; of others only the start tag goes
                unended.add(name)
                at = size if name in ("script", "style") else at
        elif name == "a":
            in_link = 1
        elif name == "hr":
            flush()
        elif name == "br":
            if buffer:
                buffer.append(" ")
        elif name in BLOCKS:
            flush()
            ends, within = IMPLIED.get(name, ((), ()))
            bound = deepest(within)
            past = [d for t in ends for d in itertools.takewhile(lambda d: d > bound, reversed(open_at.get(t, ())))]  # noqa: B023  a few at most
            if past:
                close(min(past))
            elif name in ENDS_P and here.tag == "p":
                close(here.depth)
            attrs = _attributes(raw)
            path = here.path
            if name in CONTAINERS:
                step = name + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(attrs.get("class", "").split())))
                path = xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), path) >> 1
            good = name in ("div", "section", "td") and any(x.lower() in GOOD for x in NAME_PARTS.findall(attrs.get("class", "") + " " + attrs.get("id", "")))
            here = Node(name, path, here, mark_of(name, attrs, here), good, len(blocks))
            sure += here.mark == CERTAIN
            open_at.setdefault(name, []).append(here.depth)
            nodes.append(here)
    close(1)
    flush()
    root.last = len(blocks)
    return _settled(blocks, nodes)


def _sum_up(nodes: list[Node]) -> None:
    """Text and links of each subtree, without what is dropped; children come before their parents."""
    for node in nodes:
        node.text, node.links = (0, 0) if node.dropped else (node.own, node.own_links)
        node.titled = node.tag == "h1" and node.own > 0 and node.dropped != GOES
    for node in reversed(nodes[1:]):
        node.parent.text += node.text
        node.parent.links += node.links
        node.parent.titled |= node.titled and (not node.dropped or node.parent.good or node.parent.dropped == HELD)


def _settled(blocks: list[tuple[str, Node]], nodes: list[Node]) -> tuple[list[tuple[str, Node]], list[Node]]:
    """Marks become decisions, and the sums leave out what goes."""
    _sum_up(nodes)
    total = nodes[0].text
    for node in nodes[1:]:
        if node.mark == HEAD:
            own = HELD if node.titled and 2 * node.links <= node.text else GOES
        else:
            own = STAYS if node.mark == PLAIN or (node.mark != CERTAIN and node.text and total - node.text <= OUTSIDE[node.mark] * node.text) else GOES
        node.dropped = GOES if GOES in (own, node.parent.dropped) else max(own, node.parent.dropped)
    _sum_up(nodes)
    return blocks, nodes


def net(node: Node) -> int:
    return node.text - 2 * node.links


def best(nodes: list[Node]) -> Node:
    """The container with most text by weight; of those about equal the deepest."""
    top, most = nodes[0], 0.0  # the root, which stands for a missing body
    for node in nodes:
        if node.tag in WEIGHTS and not node.dropped and node.text:
            value = max(net(node), 0.1) * WEIGHTS[node.tag] * (1.2 if node.good else 1.0) * (1 + 0.01 * min(node.depth, 10))
            if value > most:
                top, most = node, value
    up = top.parent
    while up and not up.titled and up.text - top.text <= TITLE_SHARE * top.text:
        up = up.parent
    return up if up and not top.titled and up.titled and up.tag in WEIGHTS and up.text - top.text <= TITLE_SHARE * top.text else top


def text_of(blocks: list[tuple[str, Node]], node: Node) -> str:
    held = node.tag in CONTAINERS and node.tag != "body"
    return "\n\n".join(text for text, own in blocks[node.first : node.last] if not own.dropped or (held and own.dropped == HELD))


def vote(page: str) -> tuple[int, int]:
    """The hashed path of a page's best container and the text it holds."""
    top = best(parse(page)[1])
    return top.path, max(net(top), 0)


def extract(page: str, path: int | None) -> str:
    """The text of the container at the path, the fullest of several; without one, of the page's own best."""
    blocks, nodes = parse(page)
    there = [n for n in nodes if path is not None and n.path == path and n.tag in CONTAINERS and not n.dropped and n.text]
    return text_of(blocks, max(there, key=net) if there else best(nodes))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, BATCH_ROWS):
        found = [vote(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "path": pa.array([f[0] for f in found], pa.int64()), "held": pa.array([f[1] for f in found], pa.int64())})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, BATCH_ROWS):
        found = [extract(page, path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        kept = {n: batch.column(n) for n in ("page_id", "url")}
        yield pa.RecordBatch.from_pydict(kept | {"text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())})


def host_of(url: Column) -> Column:
    """Lower-case host; null and odd addresses share one."""
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, path, pages: the path with most votes (then most text, then by name) and the host's number of pages."""
    cast = pages.select(host_of(F.col(url)).alias("host"), whole(F.col(page)).alias("html")).mapInArrow(_votes, "host string, path long, held long")
    votes = cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("held").alias("held"))
    best_path = F.max_by("path", F.struct(F.when(F.col("held") > 0, F.col("votes")).otherwise(0), "held", "path"))
    return votes.groupBy("host").agg(best_path.alias("path"), F.sum("votes").alias("pages"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty pages have an empty text; repeated rows give repeated results and vote as often; other columns are
    not read; an empty table gives no rows. A page of any length is parsed whole, in memory that follows its length.
    Winning paths, one per host, meet the pages without gathering a host's pages.
    """
    paths = cut(host_paths(pages, url, page))
    own = {n: pages.schema[n].dataType.simpleString() for n in (key, url)}
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), whole(F.col(page)).alias("html"), host_of(F.col(url)).alias("host"))
    small = (paths.agg(F.sum(F.octet_length("host") + 64)).first()[0] or 0) <= MOST_BYTES
    met = (rows.join(F.broadcast(paths), "host") if small else by_counted_key(rows, paths, "host", "pages")).select("page_id", "url", "html", "path")
    return met.mapInArrow(_texts, f"page_id {own[key]}, url {own[url]}, text string, n_chars long")
