"""Main-text extraction by tree scoring.

A page is read into a light tree, in time linear in its length. Parts that are furniture by tag,
role or state are cut. Each remaining block with some text of its own has points for its length
and its commas; they go to the block's parent in full, to the grandparent by half and to the
next ancestor by a third. An ancestor's score is discounted by its share of link text. The best
container is kept whole, and at each level above it those siblings that hold scores or read like
it: an article in several parts, a headline and its lead in a box of their own. Names (class and
id) are a weight: a part is cut by name only if all words of a name tell of furniture
("cookie-notice", not "market-share"), and a name that can also be that of a topic ("search",
"login") doesn't cut text that scores as an article's does.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements by how they are parsed and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
SELECT = frozenset("select option optgroup".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
    th thead tr ul caption""".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

CUT_TAGS = frozenset("head nav footer aside form button fieldset dialog menu search object canvas audio video label select datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tooltip".split())
#: Words of names that tell of furniture, wherever it stands.
STRONG = frozenset(
    """ad ads adbox adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos
    cookie cookies consent gdpr newsletter sidebar nav navbar navigation breadcrumb breadcrumbs masthead topbar
    comment comments commentlist disqus replies toolbar pager pagination taglist""".split()
)
#: Words that do so unless the part reads like an article: they name topics and places of layout, too.
WEAK = frozenset(
    """promotion banner notice notification popup modal overlay subscribe subscription signup signin login widget widgets
    menu footer reply respond share sharing social related recommended recommendations search form skip tags""".split()
)
FURNITURE = STRONG | WEAK
#: Words that may stand beside those in a name.
BESIDE = frozenset(
    """site page main global top bottom left right primary secondary inner outer box bar area wrapper wrap container
    block section list items item buttons button links link icons panel column col row unit slot zone group holder text
    message posts stories articles news article post blog entry story reader readers user the thread js id tree nested
    desktop mobile sticky fixed header menu""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
KEPT_TAGS = frozenset("html body article main".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
COMMAS = re.compile("[,،、，]")
SENTENCES = re.compile("[,،、，.。!?]")
#: From here on a text can be an article's whatever its box is called.
PROSE_CHARS = 140


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    parent: Node | None
    attributes: str = ""
    children: list = field(default_factory=list)
    score: float = 0.0
    text: int = 0
    linked: int = 0
    closed: bool = False
    above: frozenset = frozenset()  # of WATCHED elements around it


WATCHED = frozenset("article main blockquote pre code".split())


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attributes)} if node.attributes.strip() else {}


class Open:
    """The open elements of a page, with the places of each tag, so that no end tag looks through all of them."""

    def __init__(self):
        self.stack = [Node("#root", None)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, place: int, closed: bool = False) -> None:
        """End the element at a place and what is open in it; `closed`: its end tag was there."""
        self.stack[place].closed = closed
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag: inline elements don't end the block they stand in, and a stray one ends nothing."""
        if (found := self.places.get(tag)) and (tag in BLOCK or not self.blocks or self.blocks[-1] < found[-1]):
            self.pop_to(found[-1], True)

    def close_paragraph(self) -> None:
        if (found := self.places.get("p")) and self.blocks[-1] == found[-1]:
            self.pop_to(found[-1])

    def close_within(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """End the outermost of the tags that is open within the innermost element of the scope."""
        least = max((self.places[t][-1] for t in scope if self.places.get(t)), default=0)
        inner = [found[k] for t in tags if (found := self.places.get(t)) and (k := bisect_right(found, least)) < len(found)]
        if inner:
            self.pop_to(min(inner))


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do in the plain cases.

    An element of raw text ends at its end tag or with the page, an empty <svg/> at once, an
    open <select> at the first start tag that can't be in it, and an open <a> at the next one.
    """
    opened, at, size = Open(), 0, len(page)
    ends: dict[str, re.Pattern] = {}
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            opened.stack[-1].children.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            opened.close(tag)
            continue
        if opened.stack[-1].tag in SELECT and tag not in SELECT and tag not in RAW and tag not in ("hr", "b", "i", "span"):
            opened.close("select")
        if tag in BLOCK:
            opened.close_paragraph()
        if tag == "a" and opened.places.get("a") and (not opened.blocks or opened.blocks[-1] < opened.places["a"][-1]):
            opened.pop_to(opened.places["a"][-1])
        if tag in CLOSES:
            opened.close_within(CLOSES[tag], SCOPE.get(tag, ()))
        top = opened.stack[-1]
        node = Node(tag, top, m[3], above=top.above | {top.tag} if top.tag in WATCHED else top.above)
        top.children.append(node)
        empty = m[3].endswith("/")
        if tag in RAW:
            if not (empty and tag == "svg"):
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)
                stop = ends[tag].search(page, at)
                at = stop.end() if stop else size
        elif tag not in VOID and (not empty or tag in BLOCK):
            opened.push(node)
    return opened.stack[0]


def links(node: Node) -> bool:
    """Whether an element is a link: an <a> without href is a place, not a link."""
    return node.tag == "a" and "href" in attributes(node)


def furniture_name(names: str) -> set[str]:
    """The furniture words of class and id names that consist of such words and their companions."""
    found: set[str] = set()
    for name in names.split():
        words = [w.lower() for w in NAME.findall(name) if not w.isdigit()]
        if words and all(w in FURNITURE or w in BESIDE for w in words):
            found.update(w for w in words if w in FURNITURE)
            if "header" in words and all(w in ("header", "site", "page", "global", "main", "top") for w in words):
                found.add("header")
    return found


@dataclass(slots=True)
class Page:
    """What decides whether a part may be cut: articles, headlines and text of each node before cutting."""

    articles: int
    text: int
    of: dict[Node, tuple[int, int, int]]
    marks: dict[Node, int]  # commas and ends of sentences outside links

    def holds_article(self, node: Node, most: bool = True) -> bool:
        """Whether a node holds the page's article or main element, its headline, or most of its text."""
        articles, headlines, text = self.of[node]
        if self.articles:
            return articles > 0
        return headlines > 0 or most and 2 * text > self.text


def surveyed(root: Node) -> Page:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    of: dict[Node, list[int]] = {n: [0, 0, 0, 0] for n in order}
    for node in reversed(order):
        mine = of[node]
        if node.tag in ("article", "main"):
            mine[0] += 1
        elif node.tag == "h1":
            mine[1] += 1
        if node.tag not in RAW and not (node.closed and links(node)):
            own = [c for c in node.children if isinstance(c, str)]
            mine[2] += sum(len(" ".join(c.split())) for c in own)
            mine[3] += sum(len(SENTENCES.findall(c)) for c in own)
        else:
            mine[2] = mine[3] = 0
        if node.parent is not None:
            of[node.parent] = [x + y for x, y in zip(of[node.parent], mine, strict=True)]
    return Page(of[root][0], of[root][2], {n: tuple(x[:3]) for n, x in of.items()}, {n: x[3] for n, x in of.items()})


def prose(node: Node, page: Page) -> bool:
    """Whether a part reads like an article's: a long text outside links, with sentences."""
    _, _, text = page.of[node]
    return text >= PROSE_CHARS and page.marks[node] * 200 >= text


def furniture(node: Node, page: Page) -> bool:
    """Whether a node is no part of the page's article, by its tag, role, state or names."""
    tag = node.tag
    if tag in RAW:
        return True
    if tag in CUT_TAGS:
        if tag == "footer" and "blockquote" in node.above:
            return False
        return tag not in ("form", "fieldset", "label") or not page.holds_article(node)
    found = attributes(node)
    if tag == "header":
        if not node.above.isdisjoint(("article", "main")):
            return False
        return bool(page.articles) or not page.of[node][1] or node.parent is None or node.parent.tag in ("body", "html", "#root")
    if not found or tag in ("html", "body"):
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if tag in KEPT_TAGS:
        return False
    if found.get("role", "").lower() in CUT_ROLES or found.get("itemprop", "") == "comment":
        return not page.holds_article(node)
    if tag not in BLOCK and tag not in ("span", "ins") or tag in HEADINGS or not node.above.isdisjoint(("pre", "code")):
        return False
    words = furniture_name(f"{found.get('class', '')} {found.get('id', '')}")
    if "header" in words and len(words) == 1 and not node.above.isdisjoint(("article", "main")):
        return False
    if not words & STRONG and prose(node, page):
        return False
    return bool(words) and not page.holds_article(node, most=not words & COMMENTS)


def measured(root: Node) -> list[Node]:
    """Cut furniture, count text and link text, and give points; nodes in page order."""
    order: list[Node] = []
    stack, page = [root], surveyed(root)
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not furniture(c, page)]
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    own: dict[Node, list[str]] = {}
    block_of: dict[Node, Node] = {}
    for node in order:
        block = block_of[node] = node if node.tag in BLOCK or node.parent is None else block_of[node.parent]
        for child in node.children:
            if isinstance(child, str):
                node.text += len(" ".join(child.split()))
                own.setdefault(block, []).append(child)
    for node in reversed(order):
        if links(node):
            node.linked = node.text if node.closed else unclosed_link(node)
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    for block, parts in own.items():
        text = " ".join("".join(parts).split())
        if len(text) < 25 or block.tag == "#root":
            continue
        points = 1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3)
        up, share = block.parent, 1
        while up is not None and share <= 3:
            up.score += points / share
            up, share = up.parent, share + 1
    return order


def unclosed_link(node: Node) -> int:
    """The link text of a link without an end tag: it ends at the first block in it."""
    n = 0
    for child in node.children:
        if not isinstance(child, str) and child.tag in BLOCK:
            break
        n += len(" ".join(child.split())) if isinstance(child, str) else child.text
    return n


def density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


@dataclass(slots=True)
class Scores:
    """Final scores of blocks; the best score in each node, and whether a headline is in it."""

    final: dict[Node, float]
    best_in: dict[Node, float]
    headline: dict[Node, bool]


def scored(order: list[Node]) -> Scores:
    base = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0}
    final = {n: (n.score + base.get(n.tag, 0.0)) * (1 - density(n)) for n in order if n.tag in BLOCK and n.score > 0}
    best_in, headline = {}, {}
    for node in reversed(order):
        inner = [c for c in node.children if not isinstance(c, str)]
        best_in[node] = max([final.get(node, 0.0), *[best_in[c] for c in inner]])
        headline[node] = node.tag == "h1" or any(headline[c] for c in inner)
    return Scores(final, best_in, headline)


def containers(root: Node) -> list[Node]:
    """The best container and what belongs to it at its own level and at those above, in page order.

    At the container's level a page without an article element keeps headings and what isn't
    links; further up a part has to score, to be another article, or to hold the headline that
    what is kept so far lacks.
    """
    order = measured(root)
    blocks = [n for n in order if n.tag in BLOCK]
    s = scored(order)
    if not s.final:
        for tag in ("article", "main", "body"):
            if found := [n for n in blocks if n.tag == tag and n.text]:
                return found[:1]
        return [root] if root.text else []
    best = max(s.final, key=lambda n: s.final[n])
    named = best
    while named is not None and named.tag not in ("article", "main"):
        named = named.parent
    least = max(10.0, 0.2 * s.final[best])
    path = named or best
    if path.parent is None or path.tag in ("body", "html"):
        return [path]
    kept, lowest, headline = [path], True, s.headline[path]
    while path.parent is not None and path.tag not in ("body", "html"):
        family = runs(path.parent)
        place = family.index(path)
        before, after = [], []
        for k, other in enumerate(family):
            if other is path or not other.text:
                continue
            linked = density(other)
            alike = s.best_in.get(other, 0.0) >= least and linked < 0.5 or other.tag == "p" and other.text > 80 and linked < 0.25
            alike |= other.tag == "article" and linked < 0.25
            if k < place and not headline and s.headline.get(other, False) and linked < 0.5:
                alike, headline = True, True
            if named is not None:  # the page names its article: a heading may stand right before it
                alike |= other.tag in HEADINGS and k + 1 == place and lowest
            elif lowest and other.tag != "article":
                alike |= other.tag in HEADINGS or linked < 0.5
            if alike:
                (before if k < place else after).append(other)
        kept = before + kept + after
        path, lowest = path.parent, False
    return kept


def runs(parent: Node) -> list[Node]:
    """A node's blocks, and its runs of text and inline elements between them as blocks of their own."""
    found: list[Node] = []
    for child in parent.children:
        if not isinstance(child, str) and (child.tag in BLOCK or child.score > 0):
            found.append(child)
            continue
        if not found or found[-1].tag != "#run":
            found.append(Node("#run", parent))
        run = found[-1]
        run.children.append(child)
        run.text += len(" ".join(child.split())) if isinstance(child, str) else child.text
        run.linked += 0 if isinstance(child, str) else child.linked
    return found


def blocks_of(node: Node) -> list[str]:
    """The texts of a container's blocks, character references decoded, white space single, in page order."""
    found: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(parts).split()):
            found.append(text)
        parts.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            parts.append(html.unescape(item))
        elif item.tag in ("br", "wbr"):
            parts.append(" " if item.tag == "br" else "")
        else:
            if item.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return found


def main_text(page: str | None) -> str:
    """The page's article as blocks joined by one newline; empty if there is none."""
    if not page:
        return ""
    return "\n".join(t for node in containers(parse(page)) for t in blocks_of(node))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text (the main text) and n_chars (its code points) instead of the html column.

    A null page counts as empty; an empty page, and one of furniture alone, has an empty text;
    repeated rows are each read; an empty table gives no rows; columns of pages named text or
    n_chars are replaced. Every row's whole html is read, in the scan, without a shuffle.
    """

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: main_text(x).encode("utf-8", "replace").decode("utf-8"))

    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    texts = pages.select(*kept, run(F.coalesce(html_col, F.lit(""))).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def extract_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
