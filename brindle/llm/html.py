"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of an article.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select textarea iframe object svg "
    "canvas audio video map dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCORED = frozenset("p pre td blockquote li dd".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
#: An element of the first kind ends an open one of the second, up to an element that bounds it.
CLOSES = {
    **{t: (frozenset(["p"]), frozenset("table td th button object".split())) for t in BLOCKS - {"html", "body"}},
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Tags whose start ends list items, definitions or cells whatever stands between.
ITEMS = frozenset("li dt dd tr td th".split())
#: Classes that say what is not there, or what a wrapper holds among other things.
NEGATED = re.compile(r"(?:^|(?<=\s))(?:no|not|non|without|has|with)[-_]\S+", re.IGNORECASE)
#: Words in class, id or role that mark what is not the article: of notices and comments, and of the page's layout.
NOTICES = (
    r"ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|popup|modal|cookies?\w*|consent|gdpr|notice\w*|alert\w*|"
    r"comments?\w*|disqus|respond|replies|reply|newsletter\w*|subscri\w*|signup|login|hidden|dialog"
)
LAYOUT = (
    r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|side\w*|widget\w*|footer\w*|foot|header|masthead|social\w*|share|sharing|"
    r"related\w*|recommend\w*|search\w*|toolbar|skip\w*|contentinfo|complementary|navigation"
)
NOTICE_WORDS, LAYOUT_WORDS = (re.compile(rf"(?:^|[-_\s])(?:{words})(?:$|[-_\s])", re.IGNORECASE) for words in (NOTICES, LAYOUT))
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
#: Never taken for asides, whatever their class says.
TRUSTED = frozenset("html body article main h1".split())
#: An aside of such a share of the page's prose is its frame; with an article or main element in it, the lower share will do.
FRAME, FRAME_WITH_ARTICLE = 0.8, 0.5
SPACE = re.compile(r"\s+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_CHARS = 25
SIBLING_SHARE = 0.2
SIBLING_LINKS = 0.25


class Node:
    __slots__ = ("tag", "parent", "children", "score", "dropped", "aside", "chars", "linked", "raw", "commas", "prose", "holds_article", "scored")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.aside = ""
        self.children: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = self.raw = self.commas = self.prose = 0
        self.holds_article = tag in ("article", "main")
        self.scored = False


class Tree(HTMLParser):
    """A forgiving parser: unclosed and stray tags give a tree without errors.

    Depths of open elements are kept by name, so that no tag is looked for element by element.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None, False)
        self.open = [self.root]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.walls = [0]

    def _depth(self, tags: Iterable[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)

    def _close(self, depth: int) -> None:
        """End the open elements at this depth and below it."""
        while len(self.open) > depth:
            tag = self.open.pop().tag
            self.depths[tag].pop()
            if self.walls[-1] == len(self.open):
                self.walls.pop()

    def _end_implied(self, tag: str) -> None:
        ended, bounds = CLOSES[tag]
        bound, paragraphs = self._depth(bounds), self.depths["p"]
        if tag in ITEMS:
            items = self._depth(ended - {"p"})
            outer = bisect_right(paragraphs, bound)
            if items > bound:
                self._close(items)
            elif outer < len(paragraphs):
                self._close(paragraphs[outer])
        elif paragraphs and paragraphs[-1] > max(bound, self.walls[-1]):
            self._close(paragraphs[-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES:
            self._end_implied(tag)
        at = self.open[-1]
        node = Node(tag, at, at.dropped or tag in DROPPED)
        if not node.dropped and tag not in TRUSTED:
            node.aside = self._aside(tag, attrs)
        at.children.append(node)
        if tag not in VOID:
            self.depths[tag].append(len(self.open))
            if tag in BLOCKS and tag != "p":
                self.walls.append(len(self.open))
            self.open.append(node)

    def _aside(self, tag: str, attrs: list) -> str:
        """What the element's name or attributes take it for: a notice, a part of the layout, or neither."""
        kind = "layout" if tag == "form" or (tag == "header" and not self.depths["article"] and not self.depths["main"]) else ""
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value:
                value = NEGATED.sub("", value)
                if NOTICE_WORDS.search(value):
                    return "notice"
                if LAYOUT_WORDS.search(value):
                    kind = "layout"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and HIDDEN.search(value)):
                return "notice"
        return kind

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "iframe", "script", "canvas"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        depths = self.depths[tag]
        if depths and (tag in BLOCKS or tag in DROPPED or depths[-1] > max(self.walls[-1], self._depth(["p"]))):
            self._close(depths[-1])

    def handle_data(self, data: str) -> None:
        if not self.open[-1].dropped:
            self.open[-1].children.append(data)


def _order(root: Node) -> list[Node]:
    """All kept nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    return out


def _drop_asides(nodes: list[Node]) -> bool:
    """Drop asides, but for those that frame the page: they hold most of the prose, that of notices left out.

    Prose is text outside links in pieces of PARAGRAPH_CHARS or more. A notice is only kept if it holds an article element and
    nearly all prose. Says whether any was dropped.
    """
    linked = {id(n) for n in nodes if n.tag == "a"}
    for node in nodes:
        if node.parent is not None and id(node.parent) in linked:
            linked.add(id(node))
    inside: set[int] = set()
    for node in nodes:
        if node.aside == "notice" or (node.parent is not None and id(node.parent) in inside):
            inside.add(id(node))
    for outside in (True, False):
        # Without any prose outside notices their own counts.
        for node in nodes:
            node.prose = 0
        for node in reversed(nodes):
            if id(node) not in linked and (id(node) not in inside or not outside):
                node.prose += sum(len(c.strip()) for c in node.children if isinstance(c, str) and len(c.strip()) >= PARAGRAPH_CHARS)
            if node.parent is not None:
                node.parent.prose += node.prose
                node.parent.holds_article |= node.holds_article
        if nodes[0].prose:
            break
    total, dropped = nodes[0].prose, False
    for node in nodes:
        if node.aside and total:
            share = node.prose / total
            frame = share >= FRAME and (node.aside == "layout" or node.holds_article)
            node.dropped = not (frame or (node.aside == "layout" and node.holds_article and share >= FRAME_WITH_ARTICLE))
        elif node.aside:
            node.dropped = True
        dropped |= node.dropped
    return dropped


def _measure(nodes: list[Node]) -> None:
    """Characters of text below each node, those within links, and what a paragraph's points count."""
    for node in reversed(nodes):
        texts = [c for c in node.children if isinstance(c, str)]
        node.chars += sum(len(SPACE.sub(" ", c).strip()) for c in texts)
        node.raw += sum(map(len, texts))
        node.commas += sum(c.count(",") + c.count("，") for c in texts)
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            for name in ("chars", "linked", "raw", "commas"):
                setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _score(nodes: list[Node]) -> None:
    """Paragraphs pass points for length and commas to ancestors: all to the parent, half to the next, then thirds and so on."""
    for node in nodes:
        loose = node.tag in ("div", "section", "article", "main", "html") and any(
            isinstance(c, str) and len(c.strip()) >= PARAGRAPH_CHARS for c in node.children
        )
        if not (node.tag in SCORED or loose) or node.chars < PARAGRAPH_CHARS:
            continue
        commas, size = node.commas, node.raw
        if loose:
            own = [c for c in node.children if isinstance(c, str)]
            commas, size = sum(c.count(",") + c.count("，") for c in own), sum(map(len, own))
        points = 1 + commas + min(size // 100, 3)
        above, level = (node if loose else node.parent), 1
        while above is not None and level <= 4:
            above.score += points / level
            above.scored = True
            above, level = above.parent, level + 1


def _blocks(roots: list[Node]) -> list[str]:
    """Text of each block in page order, white space folded; a line break inside a block is white space."""
    out: list[str] = []
    current: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(current)).strip()
        if text:
            out.append(text)
        current.clear()

    for root in roots:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                current.append(x)
            elif x.dropped:
                continue
            elif x.tag in BLOCKS:
                end()
                stack.append(None)
                stack.extend(reversed(x.children))
            else:
                if x.tag == "br":
                    current.append(" ")
                stack.extend(reversed(x.children))
        end()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, one on each line; empty for a page without text.

    Elements that their name, class or role marks as notices or layout are left out unless they frame the page. The container of
    the best score (or the nearest article or main element around it) is kept with those siblings that score a fifth as
    much, or that are headings or paragraphs of prose with few links. Of containers with equal scores the first wins. Time grows
    with the page's length, however its tags are nested.
    """
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = _order(tree.root)
    if _drop_asides(nodes):
        nodes = _order(tree.root)
    _measure(nodes)
    _score(nodes)
    scored = [n for n in nodes if n.scored and (n.tag in CONTAINERS or n.tag == "html")]
    if not scored:
        return "\n".join(_blocks([tree.root]))
    value = {id(n): n.score * (1 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])
    # The whole article rather than one of its parts.
    node = best
    while node.parent is not None:
        node = node.parent
        if node.tag in ("article", "main"):
            best = node
            break
    if best.parent is None:
        return "\n".join(_blocks([best]))
    roots = []
    for sibling in best.parent.children:
        if sibling is best:
            roots.append(best)
        elif isinstance(sibling, Node) and not sibling.dropped and best.tag not in ("article", "main"):
            density = _density(sibling)
            prose = sibling.tag in ("p", "pre", "blockquote", *HEADINGS) and sibling.chars and density < SIBLING_LINKS
            if prose or value.get(id(sibling), 0.0) >= max(SIBLING_SHARE * value.get(id(best), 0.0), 1.0):
                roots.append(sibling)
        elif isinstance(sibling, Node) and sibling.tag == best.tag and value.get(id(sibling), 0.0) >= SIBLING_SHARE * value.get(id(best), 0.0) > 0:
            roots.append(sibling)
    return "\n".join(_blocks(roots))


@F.arrow_udf(T.StringType())
def _extracted(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """pages with one more column: each page's main text (empty for null or empty html; never null).

    Rows, repeated ones too, and all other columns stay; a column called ``into`` (in any case) is an error.
    """
    if into.lower() in map(str.lower, pages.columns):
        raise ValueError(f"column '{into}' exists")
    return pages.withColumn(into, _extracted.asNondeterministic()(F.col(f"`{html_col}`").cast("string")))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
