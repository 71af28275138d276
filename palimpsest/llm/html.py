"""HTML extraction by tree scoring.

A page becomes a tree; each paragraph-like block gives points for its length and its commas to its ancestors (whole to
the parent, half to the next, a third to the one after), and a node's points are discounted by its link density. The
best container is kept, and from it upwards, at each level, those siblings that score like it, others of its kind
(articles, sections), and the headings, paragraphs, lists and figures beside them that are not mostly links; inside an
article or main element all siblings but link lists. An element's name only raises its score. Menus, headers, footers,
asides, notices, adverts, forms, scripts, styles and reader comments are not part of any block; a name that may mean
either (DOUBT) counts as such only for elements with many links or a small share of the page's points. An attribute whose
quote never closes takes the rest of the page with its tag, as in browsers.

Text: character references decoded, white space inside a block made one space, trimmed, blocks in page order joined by
a newline. A null or empty page has an empty text; broken or cut markup closes at the end of the page. Pages are handled
alone (no shuffle), in time linear in their length whatever the nesting; repeated rows give repeated results; a null url stays null.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=(?!\s*[\"'])|[\"'])*+)(?:>|\Z)", re.S)
SPACE = re.compile(r"[\s ]+")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
SKIP = RAW | frozenset("head nav header footer aside form button select option input fieldset menu dialog video audio canvas map".split())
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol dl table figure".split())
ENDS_P = BLOCK | frozenset("nav header footer aside form menu".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
AWAY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|notices?|popups?|modals?|newsletter|subscribe|sidebars?|menus?|nav\w*|breadcrumbs?|header|masthead|footer|comments?|disqus)(?:$|[\s_\d-])", re.I)
DOUBT = re.compile(r"(?:^|[\s_-])(?:alerts?|cta|gdpr|signup|side|widgets?|foot|replies|respond|share|sharing|social|related|recommend\w*|login|search|pagination|pager|toolbar|skip)(?:$|[\s_\d-])", re.I)
KEEP = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body)(?:$|[\s_-])", re.I)
DOUBTED, LINKS, NAMED = 0.25, 0.3, 1.25  # a doubtful element with less than this share of the page's points goes
FIRST, ABOVE = 0.2, 0.4  # share of the best container's points that keeps a sibling, of it and of its ancestors


class Node:
    __slots__ = ("tag", "parent", "children", "away", "doubt", "link", "inside", "named", "points", "full", "length", "linked", "kept")

    def __init__(self, tag: str, parent: Node | None, away: bool, named: bool = False):
        self.tag, self.parent, self.away, self.named = tag, parent, away, named or tag in ("article", "main")
        self.link = tag == "a" or parent is not None and parent.link
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.children: list[Node | str] = []
        self.points = self.full = 0.0
        self.length = self.linked = 0
        self.doubt = self.kept = False

    def density(self) -> float:
        return self.linked / self.length if self.length else 0.0


def parse(page: str) -> list[Node]:
    """The page's tree as its nodes, parents first; what never belongs to the main text is marked away and keeps no text."""
    root = here = Node("#root", None, False)
    nodes, opened = [root], Counter[str]()
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        cut = m.start() if m else size
        if cut > at and not here.away:
            here.children.append(page[at:cut])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if not opened[tag]:
                continue
            node = here
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in ENDS_P:  # an inline end tag does not close a block
                    node = root
                    break
                node = node.parent
            if node is not root:
                while here is not node.parent:
                    opened[here.tag] -= 1
                    here = here.parent
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = ENDS[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in ENDS_P or tag in CLOSES:
            shut = (("p",) if tag in ENDS_P else ()) + CLOSES.get(tag, ())
            node = here if any(opened[t] for t in shut) else root
            while node is not root:
                if node.tag in shut:
                    while here is not node.parent:
                        opened[here.tag] -= 1
                        here = here.parent
                    if tag not in ("tr",):
                        break
                if node.tag in ("ul", "ol", "dl", "table", "div", "article", "section", "body", "blockquote"):
                    break
                node = node.parent
        attributes = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).strip()
        plain = bool(names) and tag not in ("html", "body", "article", "main") and not KEEP.search(names)
        away = here.away or tag in SKIP or "hidden" in attributes or attributes.get("aria-hidden") == "true" or plain and bool(AWAY.search(names))
        if tag == "header" and not here.away and (here.inside or here.named):
            away = plain and bool(AWAY.search(names))  # an article's own header holds its title
        node = Node(tag, here, away, bool(names and tag not in ("html", "body") and KEEP.search(names)))
        node.doubt = plain and bool(DOUBT.search(names))
        if not away or tag not in VOID:
            here.children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            if not away:
                nodes.append(node)
            opened[tag] += 1
            here = node
    return nodes


def lines(node: Node) -> list[tuple[Node, str]]:
    """(block, text) of each run of inline text below node, in page order."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []

    def flush(block: Node) -> None:
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append((block, text))

    stack: list[tuple[Node, Node, int]] = [(node, node, 0)]
    while stack:
        here, block, i = stack.pop()
        if i == len(here.children):
            if here is block:
                flush(block)
            continue
        stack.append((here, block, i + 1))
        child = here.children[i]
        if isinstance(child, str):
            run.append(child)
        elif child.away:
            if child.tag in ENDS_P:
                flush(block)
        elif child.tag in BLOCK:
            flush(block)
            stack.append((child, child, 0))
        elif child.tag == "br":
            run.append(" ")
        else:
            stack.append((child, block, 0))
    return out


LEAVES = frozenset("p pre li h1 h2 h3 h4 h5 h6 td th dd dt".split())


def score(nodes: list[Node], found: list[tuple[Node, str]]) -> None:
    """Points of each container, and of each whole subtree, with lengths and link density."""
    for block, text in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        block.full += points
        node, share = block.parent if block.tag in LEAVES and block.parent else block, 1
        while node is not None and share <= 3:
            node.points += points / share
            node, share = node.parent, share + 1
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.length += own
        node.linked += own if node.link else 0
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.full += node.full
    for node in nodes:
        discount = 1 - min(1.0, node.density())
        node.points *= discount * (NAMED if node.named else 1)
        node.full *= discount


def keep_siblings(best: Node) -> None:
    """Marks what is kept: the best container and, level by level up to the body, the siblings that belong to it."""
    best.kept, here, least = True, best, FIRST
    while here.parent is not None and here.tag not in ("html", "body"):
        parent = here.parent
        beside = [n for n in parent.children if not isinstance(n, str) and not n.away]
        whole = parent.inside or parent.tag in ("article", "main")
        chosen = []
        for n in beside:
            texty = n.density() < 0.5
            alike = n.tag in ("article", "section") and n.tag == here.tag
            chosen.append(n is here or texty and (whole or alike or n.tag in BLOCK and n.full >= least * best.full > 0))
        first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
        while first > 0 and beside[first - 1].tag in BESIDE:  # what leads up to the first of them
            first -= 1
        while last + 1 < len(beside) and beside[last + 1].tag in BESIDE:
            last += 1
        for i, n in enumerate(beside):
            n.kept |= n is not here and (chosen[i] or first <= i <= last and n.tag in BESIDE and n.density() < 0.5)
        if whole and any(isinstance(c, str) and c.strip() for c in parent.children):
            parent.kept = True
        here, least = parent, ABOVE


def main_text(page: str | None) -> str:
    """The best container's blocks and those of its siblings that score like it."""
    if not page:
        return ""
    nodes = parse(page)
    found = lines(nodes[0])
    if not found:
        return ""
    score(nodes, found)
    doubtful = [n for n in nodes if n.doubt and (n.density() >= LINKS or n.full < DOUBTED * nodes[0].full)]
    if doubtful:
        for n in doubtful:
            n.away = True
        for n in nodes:
            n.points = n.full = 0.0
            n.length = n.linked = 0
        found = lines(nodes[0])
        nodes = [n for n in nodes if n.parent is None or not away_with(n)]
        if not found:
            return ""
        score(nodes, found)
    containers = [n for n in nodes if n.tag not in ("#root", "html", "body") and n.points > 0] or [n for n in nodes if n.points > 0] or nodes[:1]
    keep_siblings(max(containers, key=lambda n: n.points))
    for n in nodes[1:]:
        n.kept = n.kept or n.parent.kept
    return "\n".join(text for block, text in found if block.kept)


def away_with(n: Node) -> bool:
    """Whether n or what holds it went away (parents come first, so that each looks one step up)."""
    n.away = n.away or n.parent.away
    return n.away


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars (code points)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows_of(one), "page_id long, url string, text string, n_chars long")
