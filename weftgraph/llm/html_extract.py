"""Main text of web pages by scoring the tree of elements.

A page becomes a tree (tags may be left open, as browsers allow). Elements that never hold the article go first: scripts, styles, forms,
navigation, page headers and footers, asides, and those whose class, id or role says advert, menu, sidebar, notice, comments and
the like. Of a name such as no-sidebar or has-comments the last word doesn't count. Elements whose class or id is such a word as a whole stay only if they
hold the main element or three quarters of the page's text; those where it is one part of a name (site-header) stay also if another class or the id says content, or
if they hold half of the text, or an article with a quarter of it. Headings and paragraphs of an article stay if they are named after a region of a page (header, feedback). A form stays if it holds the main element, an article or
three quarters of the text, as some pages are one form. Each paragraph then passes points for its length and commas to its ancestors: all to its parent, half to
the parent above, and to each one above a third of what the one below it got; a container's points shrink by its share of linked text. The best container and
those siblings that look like parts of the article are kept. White space inside a block becomes one space, and blocks join by one space in page order.

Defined cases: a null or empty page, and one without text, give an empty text. Pages that are cut short, or hold one tag in another's place, are read as far
as they go. Of containers with equal points the first in page order is the best. If no container scores, the whole body counts. Very long pages are read whole, at
any depth, in time that grows with their length. Rows that repeat an id are read each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_batches, lean

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|textarea|template|svg|math|iframe|object|select|title|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^<]*\Z", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "legend", "summary"}
_SELF_CLOSING = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_DROPPED = frozenset("head nav footer aside form button menu dialog input label fieldset header".split())
_CONTENT = frozenset("html body article main".split())
_BAD_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox banner sponsor sponsored sponsors promo promos promotion promoted outbrain taboola "
    "sidebar side aside rail widget widgets nav navbar navigation navigate menu menus menubar breadcrumb breadcrumbs crumbs pagination pager "
    "header masthead topbar toolbar footer foot copyright legal colophon "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login register paywall disclaimer "
    "comment comments commentlist respond reply replies disqus discussion feedback reader-comments "
    "share sharing social related recommended recommendations trending popular more-stories skip search searchbox form hidden tags tagcloud byline-links author-bio toc".split()
)
_UNLESS = frozenset("no not non has have with without hide".split())
#: Words for regions of a page, which say nothing about a heading or a paragraph inside an article.
_REGION = frozenset("header masthead side aside rail footer foot legal notice notices alert popular trending discussion feedback form search menu toc".split())
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_GOOD_WORD = frozenset("article content entry post story text main body page".split())
_WHITE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85\xa0  -     　]+")
_PARAGRAPH = frozenset("p pre td blockquote li dd".split())


class Node:
    __slots__ = ("attrs", "children", "commas", "far", "links", "near", "own", "parent", "points", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs, self.children = tag, parent, attrs, []
        self.score, self.size, self.links, self.own, self.commas = 0.0, 0, 0, 0, 0
        #: The element's own points, those of its paragraphs, and what comes up from below those.
        self.points = self.near = self.far = 0.0


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = node = Node("html", None)
    at = 0
    open_: Counter[str] = Counter()

    def opened(tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> Node | None:
        if not any(open_[t] for t in tags):
            return None
        x = node
        while x is not root and x.tag not in within:
            if x.tag in tags:
                return x
            x = x.parent
        return None

    def left(x: Node) -> Node:
        """Ends the element x and those in it; the element around it."""
        nonlocal node
        while node is not x:
            open_[node.tag] -= 1
            node = node.parent
        open_[x.tag] -= 1
        return x.parent

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "p" and opened({"p"}, _BLOCK - {"p"}) is None:
                node.children.append("\n")
                continue
            if tag == "br":
                node.children.append("\n")
                continue
            if open_[tag]:
                x = node
                while x.tag != tag:
                    x = x.parent
                node = left(x)
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                while node is not root:
                    node = left(node)
            if tag != "head":
                continue
        elif tag == "br":
            node.children.append("\n")
            continue
        if tag in _CLOSES_P:
            x = opened({"p"}, _BLOCK - {"p"})
            node = left(x) if x is not None else node
        if tag in _SELF_CLOSING:
            own = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            x = opened(own, _SELF_CLOSING[tag])
            node = left(x) if x is not None else node
        new = Node(tag, node, m["attrs"])
        node.children.append(new)
        if tag not in _VOID and (tag in _BLOCK or not m["attrs"].endswith("/")):
            node = new
            open_[tag] += 1
    if at < len(page):
        node.children.append(html.unescape(page[at:]))
    return root


def _named(node: Node) -> tuple[int, bool, set[str]]:
    """How much the attributes speak against the element (0 to 3: not, by a part of a name, by a whole name, hidden or by its role), whether one of its names is good, and
    the words against it."""
    if not node.attrs or node.attrs.isspace():
        return 0, False, set()
    attrs = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTR.findall(node.attrs)}
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return 3, False, set()
    if attrs.get("role", "").lower() in _BAD_ROLE:
        return 3, False, set()
    bad, good, against = 0, False, set()
    for name in (*attrs.get("class", "").split(), *attrs.get("id", "").split()):
        words = [w.lower() for w in _SPLIT.split(name) if w]
        found = {w for i, w in enumerate(words) if w in _BAD_WORD and not (i and words[i - 1] in _UNLESS)}
        if name.lower() in _BAD_WORD:
            found.add(name.lower())
        if found:
            against |= found
            bad = max(bad, 2 if name.lower() in found or len(found) == len(words) else 1)
        elif any(w in _GOOD_WORD for w in words):
            good = True
    return bad, good, against


def _sizes(root: Node) -> dict[Node, tuple[int, bool, int]]:
    """Of each element: its text without parts that are dropped by their tag (but for forms), whether it holds a main element, and the text of its largest article."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node) and (c.tag not in _DROPPED or c.tag == "form")]
    out = {}
    for x in reversed(order):
        size, has_main, article = 0, x.tag == "main", 0
        for c in x.children:
            if isinstance(c, str):
                size += len(c.strip())
            elif c in out:
                own = out[c]
                size, has_main, article = size + own[0], has_main or own[1], max(article, own[2])
        out[x] = size, has_main, size if x.tag == "article" else article
    return out


def _pruned(root: Node) -> None:
    stack, sizes = [root], None
    while stack:
        x = stack.pop()
        kept = []
        for c in x.children:
            if isinstance(c, str):
                kept.append(c)
                continue
            if c.tag == "form":
                sizes = sizes or _sizes(root)
                total, (size, has_main, article) = sizes[root][0], sizes.get(c, (0, False, 0))
                if has_main or article or size and 4 * size >= 3 * total:
                    c.tag = "div"
            if c.tag in _DROPPED:
                if c.tag == "header" and _holder(c) in ("article", "main"):
                    c.children = _headings(c)
                    c.tag = "div"
                    kept.append(c)
                    stack.append(c)
                continue
            bad, good, against = (0, False, set()) if c.tag in _CONTENT else _named(c)
            if bad == 3:
                continue
            if bad and not (c.tag in _TEXT and against <= _REGION and _within(c)) and not (bad == 1 and good):
                sizes = sizes or _sizes(root)
                total, (size, has_main, article) = sizes[root][0], sizes.get(c, (0, False, 0))
                if not has_main and (not size or 4 * size < 3 * total) and (bad == 2 or not size or 2 * size < total and (not article or 4 * article < total)):
                    continue
            kept.append(c)
            stack.append(c)
        x.children = kept


def _headings(node: Node) -> list[Node]:
    """The headings of a page or article in an element, at any depth."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.tag in ("h1", "h2", "hgroup"):
                out.append(x)
                x.parent = node
            elif x.tag not in _DROPPED and not _named(x)[0]:
                stack += reversed(x.children)
    return out


def _within(node: Node) -> bool:
    """Whether the element is in an article or main element, or one named so."""
    x = node.parent
    while x is not None and x.tag not in ("article", "main") and not (x.tag in ("div", "section") and _named(x)[1]):
        x = x.parent
    return x is not None


def _holder(node: Node) -> str:
    x = node.parent
    while x is not None and x.tag not in ("article", "main", "section", "html"):
        x = x.parent
    return x.tag if x is not None else ""


def _scored(root: Node) -> list[Node]:
    """Gives sizes and scores to the tree; the elements in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    for x in reversed(order):  # what is below comes first
        text = [c for c in x.children if isinstance(c, str)]
        below = [c for c in x.children if isinstance(c, Node)]
        x.own = sum(len(c.strip()) for c in text)
        commas = sum(c.count(",") + c.count("،") + c.count("、") for c in text)
        x.commas = commas + sum(c.commas for c in below)
        x.size = x.own + sum(c.size for c in below)
        x.links = x.size if x.tag == "a" else sum(c.links for c in below)
        x.near = sum(c.points for c in below)
        x.far = sum(c.near / 2 + c.far / 3 for c in below)
        x.score = x.near + x.far
        loose = x.tag in ("div", "section", "article", "main", "html", "body") and x.own >= 25
        if loose or x.tag in _PARAGRAPH and x.size >= 25:
            size, commas = (x.own, commas) if loose else (x.size, x.commas)
            x.points = (1 + min(size / 100, 3) + commas) * (1 - x.links / x.size)
            if loose:
                x.score += x.points
    for x in order:
        if x.score:
            x.score *= 1 - (x.links / x.size if x.size else 0)
            if x.tag in ("article", "main"):
                x.score *= 1.5
            elif _named(x)[1]:
                x.score *= 1.25
    return order


def _blocks(node: Node, out: list[str]) -> None:
    """Text with a line break at the edges of blocks."""
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in _BLOCK:
            stack += ["\n", *reversed(x.children), "\n"]
        else:
            stack += reversed(x.children)


def _main(root: Node) -> list[Node]:
    order = _scored(root)
    best = max(order, key=lambda x: x.score)
    if not best.score:
        return [root]
    while best.parent is not None and best.parent.score >= 0.9 * best.score and best.parent.size <= 1.25 * best.size:
        best = best.parent
    if best.parent is None:
        return [best]
    least, kept = max(10.0, 0.2 * best.score), []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif isinstance(c, Node) and c.size:
            density = c.links / c.size
            paragraph = c.tag in ("p", "pre", "blockquote") and (c.size > 80 and density < 0.25 or density == 0 and c.size > 20)
            heading = c.tag in ("h1", "h2") and density < 0.25
            if c.score >= least or paragraph or heading:
                kept.append(c)
    return kept


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    _pruned(root)
    out: list[str] = []
    for node in _main(root):
        _blocks(node, out)
        out.append("\n")
    return _WHITE.sub(" ", "".join(out)).strip()


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text", size_col: str = "n_chars", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named columns of pages, with the main text and its code points (long)."""
    arrow_batches(pages.sparkSession)
    own = pages.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{html_col}`").alias("__html"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*columns, text_col, size_col])

    kinds = dict(pages.dtypes)
    return own.mapInArrow(lean(each), ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{text_col}` string", f"`{size_col}` long"]))
