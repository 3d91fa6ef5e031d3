"""Main text of web pages by composite text density.

A page becomes a tree of its block elements. Each node's density is its characters per tag, lowered
where much of it stands in links; a node's density sum adds up the densities of its children. The
subtree with the largest sum is the content, widened to an ancestor as long as that ancestor is denser
than the page's body. The smallest density on the path from the body down to it is the threshold: subtrees
beside it that are as dense and mostly unlinked belong to the content too, each by its own largest sum, and
lists of links within it that are thinner are left out. An ``article`` or ``main`` around it is taken alone,
without what stands beside. Parts that are never content (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are recognised by their tag, role, class or id and
taken out of the tree before.

A class or id is only a hint, and it counts as a whole: `sidebar`, `cookie-banner` and `site-footer` are made of
noise and layout words alone, but `related-work` or `notice-period` say something of their own, and then only
take out text that is mostly linked. Neither does `article-header` or `discussion` name noise. `no-sidebar`,
`post-has-comments`, `sidebar-none` and a page builder's `widget` name nothing; main is never taken out for its class, and an element that holds most of the
page's unlinked text is kept unless an article stands elsewhere. Reader comments may be longer than the
article, so they are only kept if they hold main, the page's heading or its only article. If nothing
would be left, classes and ids are disregarded.

Defined results: null, empty or textless html gives an empty string, and an empty table no rows.
Repeated rows and null ids are extracted each. Pages are read whole, however long or deep. Other columns
are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed template".split())
SKIPPED = frozenset("script style noscript iframe xmp noframes noembed template head title nav header footer aside form menu dialog button select textarea input option label fieldset svg math canvas object audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr nobr picture".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table".split())
ENDS_LIKE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense adslot banner banners sponsor sponsored promo promos promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager topbar toolbar masthead header footer sidebar sidebars aside"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond replies share sharing social related recommended widget widgets form".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Noise words that also name parts of an article when its own words stand beside them.
WEAK = frozenset("header footer form notice notices alert aside banner banners".split())
OWN = frozenset("article articles blog content contents entry news page post posts section stories story".split())
LAYOUT = frozenset(
    "all also area bar block body bottom box button buttons col column contact container count cta desktop discussion email extra fixed float floating global"
    " group guest guests holder home icon icons inline inner item items label latest left link links list login lower mail main message messages meta mobile module"
    " more outer panel placeholder popular primary reader readers region right row search secondary see site slot sticky strip text thread threads"
    " title toggle tool tools top tree unit upper user users view visitor wrap wrapper zone".split()
)
CONTAINERS = frozenset("div section center ul ol dl table".split())
ABSENT = frozenset("no non not has have with without hide hides".split())
STATES = frozenset("none off on open closed enabled disabled".split())
BUILDERS = frozenset("elementor siteorigin so sow jet brz".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
#: A name with its value, as browsers read them: a quote only opens a value right after an equals sign.
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())
_PART = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


def attributes_of(text: str) -> list[tuple[str, str]]:
    """The attributes that can tell noise, with their values."""
    return [(name.lower(), "".join(values)) for name, *values in _ATTRIBUTE.findall(text) if name.lower() in _ATTRIBUTES]


class Node:
    __slots__ = ("tag", "parent", "parts", "children", "noise", "names", "link", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, link: bool = False):
        self.tag, self.parent, self.noise, self.link = tag, parent, noise, link
        self.names: list[tuple[str, bool, bool]] = []  # noise words of class and id, if they are all that makes it noise
        self.parts: list[Node | str] = []  # text runs and block children, in page order
        self.children: list[Node] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def is_noise(tag: str, attributes: str) -> bool:
    """Whether the element's tag, role or style takes it out."""
    if tag in SKIPPED:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for name, value in attributes_of(attributes):
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def noise_names(tag: str, attributes: str) -> list[tuple[str, bool, bool]]:
    """The noise words that the class and id name, whether each is a whole class or id, and whether nothing else is named with it."""
    if not attributes or tag in ("body", "html", "main"):
        return []
    values = [value for name, value in attributes_of(attributes) if name in ("class", "id")]
    tokens = [[p.lower() for p in _PART.split(token) if p] for value in values for token in html.unescape(value).split()]
    if not any(p in NOISE for parts in tokens for p in parts):
        return []
    built = any(p in BUILDERS for parts in tokens for p in parts[:2])
    out = []
    for parts in tokens:
        # A maker's short prefix and a number say nothing.
        others = [p for k, p in enumerate(parts) if p not in NOISE and p not in LAYOUT and not p.isdigit() and (k or len(p) > 3)]
        foreign, own = any(p not in OWN for p in others), bool(others)
        for k, p in enumerate(parts):
            absent = not ABSENT.isdisjoint(parts[:k]) or k + 1 < len(parts) and parts[k + 1] in STATES
            if p in NOISE and not absent and not (built and k < 2 and p in ("widget", "widgets")):
                out.append((p, len(parts) == 1, not foreign and not (own and p in WEAK)))
    if tag == "article":  # only a whole class or id speaks against it, or that it is a comment
        return [x for x in out if x[1] or x[2] and x[0] in COMMENTS]
    return [x for x in out if x[2]] if tag in INLINE else out


def parse(page: str) -> Node:
    """The tree of block elements; text inside inline elements belongs to the block around them."""
    root = Node("html", None)
    root.tags = 1
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements; inline ones carry the block around them
    open_: Counter[str] = Counter()  # how many of each tag are on the stack
    links = 0
    at, end = 0, len(page)

    def add(text: str) -> None:
        if text:
            block = stack[-1][1]
            block.parts.append(text)
            n = len("".join(text.split()))
            block.chars += n
            if links:
                block.link_chars += n

    def close(names: Iterable[str], barriers: Iterable[str]) -> None:
        nonlocal links
        if not any(open_[name] for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                gone = Counter(tag for tag, _ in stack[k:])
                links -= gone["a"]
                open_.subtract(gone)
                del stack[k:]
                return
            if stack[k][0] in barriers:
                return

    while at < end:
        match = _TOKEN.search(page, at)
        if match is None:
            add(html.unescape(page[at:]))
            break
        add(html.unescape(page[at : match.start()]))
        at = match.end()
        if not match[2]:
            if match[0].startswith("<![CDATA["):
                add(match[0][9:].removesuffix("]]>"))
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "br" or tag == "p" and not open_["p"]:
                add(" ")
            else:
                close((tag,), () if tag in INLINE else ("td", "th") if tag in CLOSES_P else ())
            continue
        if tag == "html":  # the root stands for it
            continue
        attributes = match[3] or ""
        block = stack[-1][1]
        block.tags += 1
        if tag in RAW:
            closing = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ")
            continue
        if tag in CLOSES_P:
            close(("p",), ("button", "table", "td", "th", "caption", "object"))
        if tag in ENDS_LIKE:
            names, barriers = ENDS_LIKE[tag]
            close(names.split(), barriers)
        block = stack[-1][1]
        firm = is_noise(tag, attributes)
        names = [] if firm else noise_names(tag, attributes)
        noise = firm or bool(names)
        if tag in INLINE and not noise:
            if tag == "a":
                if links:
                    close(("a",), ())
                links += 1
                block.link_tags += 1
            stack.append((tag, stack[-1][1]))
            open_[tag] += 1
        else:
            child = Node(tag, block, noise)
            child.names = names
            block.parts.append(child)
            block.children.append(child)
            stack.append((tag, child))
            open_[tag] += 1
    return root


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def release(nodes: list[Node]) -> None:
    """Keeps elements that only their class or id takes out but that hold the article; see the module's text."""
    if not any(n.names for n in nodes):
        return
    sums: dict[int, tuple[int, int]] = {}  # characters and linked ones
    for node in reversed(nodes):
        below = [sums[id(c)] for c in node.children if not c.noise or c.names]
        chars, linked = sums[id(node)] = node.chars + sum(c for c, _ in below), node.link_chars + sum(c for _, c in below)
        if node.names and 2 * linked < max(chars, 1) and not any(sure for *_, sure in node.names):
            node.names, node.noise = [], False
    comment = {id(n) for n in nodes if any(p in COMMENTS for p, *_ in n.names)}
    plain: dict[int, int] = {}  # unlinked characters outside firm noise and comments
    heads: dict[int, bool] = {}
    articles: dict[int, int] = {}
    for node in reversed(nodes):
        live = [c for c in node.children if not c.noise or c.names]
        plain[id(node)] = node.chars - node.link_chars + sum(plain[id(c)] for c in live if id(c) not in comment)
        heads[id(node)] = node.tag in ("main", "h1") or any(heads[id(c)] for c in live)
        articles[id(node)] = (node.tag == "article" and not node.noise) + sum(articles[id(c)] for c in live)
    marked: set[int] = set()
    elsewhere = 0  # articles and mains that hold text and no class takes out
    above: dict[int, int] = {}  # how many of those each element lies in
    for node in nodes:
        up = node.parent
        if node.noise or up is not None and id(up) in marked:
            marked.add(id(node))
        own = node.tag in ("article", "main") and id(node) not in marked and plain[id(node)] > 0
        elsewhere += own
        above[id(node)] = own + (above[id(up)] if up is not None else 0)
    total = plain[id(nodes[0])]
    single = sum(n.tag == "article" for n in nodes) == 1
    for node in nodes:
        if not node.names:
            continue
        alone = elsewhere == above[id(node)]
        most = 2 * plain[id(node)] > total
        if id(node) in comment:
            kept = heads[id(node)] or articles[id(node)] == 1 == articles[id(nodes[0])]
            kept = kept or node.tag == "article" and plain[id(node)] > total and single
        elif node.tag == "article":
            kept = most or alone and articles[id(nodes[0])] == 0
        else:
            kept = most and alone
        if kept:
            node.noise = False


def weigh(nodes: list[Node]) -> dict[int, list[int]]:
    """Sets each node's composite density and its children's sum, leaves first; returns characters, linked ones, tags and links below each."""
    sums: dict[int, list[int]] = {}
    for node in reversed(nodes):
        c = [node.chars, node.link_chars, node.tags, node.link_tags]
        for child in node.children:
            if not child.noise:
                c = [a + b for a, b in zip(c, sums[id(child)], strict=True)]
        sums[id(node)] = c
    chars, link_chars, *_ = sums[id(nodes[0])]
    ratio = link_chars / max(chars, 1)
    for node in reversed(nodes):
        c, lc, t, lt = sums[id(node)]
        t = max(t, 1)
        links = max(c, 1) / max(lc, 1) * t / max(lt, 1)  # 1 for a node that is all links
        scale = math.log(max(c, 1) / max(c - lc, 1) * lc + ratio * c + math.e)
        node.density = c / t * math.log(1 + links) / math.log(1 + scale)
        live = [x for x in node.children if not x.noise]
        node.total = sum(x.density for x in live) if live else node.density
        if live and node.chars:
            node.total += node.chars / t
    return sums


def leaves_out(body: Node, best: Node, sums: dict[int, list[int]]) -> bool:
    """Whether a flat body holds dense unlinked text beside the child that ``best`` lies in."""
    child = best
    while child.parent is not None and child.parent is not body:
        child = child.parent
    if child.parent is None:
        return False
    chars, link_chars, *_ = sums[id(child)]
    left = body.chars - body.link_chars
    left = left if left >= body.density else 0
    for node in body.children:
        c, lc, *_ = sums[id(node)]
        if node is not child and not node.noise and node.tag in TEXT_BLOCKS and node.density >= body.density and 2 * lc < c:
            left += c - lc
    one = child.tag in TEXT_BLOCKS
    if child.tag == "table":  # one of data, or the page's layout
        one = not any(n.tag in TEXT_BLOCKS or n.tag in ("div", "section") for n in in_order(child)[1:])
    return left > 0 if one else 4 * left > chars - link_chars


def beside(body: Node, best: Node, sums: dict[int, list[int]], threshold: float, nodes: list[Node]) -> list[Node]:
    """``best`` and the subtrees beside it that are as dense as the threshold and mostly unlinked, in page order."""
    top: dict[int, Node] = {}  # of each subtree, the node with the largest sum
    for node in reversed(nodes):
        top[id(node)] = max([node, *(top[id(c)] for c in node.children if not c.noise)], key=lambda n: n.total)
    path: set[int] = set()
    above: Node | None = best
    while (above := above.parent) is not None:
        path.add(id(above))
    out, taken, stack = [], {id(best)}, [body]
    while stack:
        node = stack.pop()
        if id(node) not in path and id(node) != id(best):
            chars, link_chars, *_ = sums[id(node)]
            if node.noise or id(node) not in taken and (node.density < threshold or 2 * link_chars >= chars):
                continue
            taken.add(id(top[id(node)]))
        if id(node) in taken:
            out.append(node)
        else:
            stack.extend(reversed(node.children))
    return out


def thin_lists(chosen: list[Node], sums: dict[int, list[int]], threshold: float) -> set[int]:
    """Containers (and columns of a page laid out as a table) of several links and little else, thinner than the threshold, within what is chosen."""
    out = set()
    for start in chosen:
        chars, link_chars, *_ = sums[id(start)]
        if 5 * link_chars >= 4 * chars:  # the content is a list of links
            continue
        for node in in_order(start)[1:]:
            column = node.tag == "td" and any(c.tag in TEXT_BLOCKS or c.tag == "div" for cell in node.parent.children if cell is not node for c in cell.children)
            if (node.tag in CONTAINERS or column) and not node.noise:
                chars, link_chars, _, links = sums[id(node)]
                if links > 1 and 5 * link_chars >= 4 * chars > 0 and node.density < threshold:
                    out.add(id(node))
    return out


def blocks(node: Node, skipped: set[int]) -> Iterator[str]:
    """Texts of a subtree's blocks in page order, white space made single."""
    run: list[str] = []
    stack: list[Iterator] = [iter(node.parts)]
    while stack:
        part = next(stack[-1], None)
        if isinstance(part, str):
            run.append(part)
            continue
        out = part is not None and (part.noise or id(part) in skipped)
        if not out or part.tag in CLOSES_P:
            text = " ".join("".join(run).split())
            run = []
            if text:
                yield text
        if part is None:
            stack.pop()
        elif not out:
            stack.append(iter(part.parts))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = in_order(root)
    release(nodes)
    text = content(root, nodes)
    if not text and any(n.names for n in nodes):
        for node in nodes:
            node.noise = node.noise and not node.names
        text = content(root, nodes)
    return text


def content(root: Node, nodes: list[Node]) -> str:
    sums = weigh(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    hidden: set[int] = set()
    # The body itself is a candidate if it holds text blocks, not only containers of them.
    flat = body.chars or not body.children or any(n.tag in TEXT_BLOCKS for n in body.children)
    best = body if flat else None
    for node in nodes:  # parents come before their children, so that of equal sums the outer one stays
        if node.noise or node.parent is not None and id(node.parent) in hidden:
            hidden.add(id(node))
        elif best is None and node is not body and node is not root or best is not None and node.total > best.total and node is not root:
            best = node
    best = best or body
    while best.parent is not None and best is not body and best.parent is not body and best.parent.density >= body.density:
        best = best.parent
    above: Node | None = best
    while (above := above.parent) is not None:  # an element that is meant to be the article is taken whole
        if above.tag in ("article", "main"):
            best = above
    if flat and best is not body and best.tag not in ("article", "main") and leaves_out(body, best, sums):
        best = body
    threshold, node = best.density, best
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    chosen = [best] if best is body or best.tag in ("article", "main") else beside(body, best, sums, threshold, nodes)
    skipped = thin_lists(chosen, sums, threshold)
    return " ".join(text for part in chosen for text in blocks(part, skipped))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
