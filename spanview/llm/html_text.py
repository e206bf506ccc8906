"""Main text of web pages by composite text density of their DOM nodes.

Every node's density is its characters per tag, scaled down as the share of linked text
grows against that of the body. A node's density sum adds up the densities of its
children. The threshold is the smallest density on the path from the body to the node of
the largest density sum. That node, widened to its ancestors while all that stands beside it
reaches the threshold, belongs to the article, and so does every other subtree of the body
that reaches the threshold, with the headings above what is kept. Beside it, short parts that are
not mostly links belong to it as well where it and they stand under one heading in one element. Text and
inline elements between blocks count as a block of their own. A list of links is left out where it
stands outside an article element.

Furniture (menus, adverts, forms, comments) counts no text, is left out, and neither it nor
what is inside it can be the densest part. Elements and roles decide; a class or id only
weighs: what holds most of the page's text, and no article elsewhere does, or what holds the
article itself, is none whatever its name. Names that articles have too (related, search) leave a
part out only where its text is not dense or a third of it is linked.

Cases: null and empty pages, and pages without text, give "". Broken markup closes
elements as browsers do, as far as the text needs it: a new block closes an open
paragraph, an end tag closes all up to its element, and stray end tags are ignored; the
end of the input closes the rest. Ties of density sums go to the outer, then the earlier
node. Nothing is cut off, however long or deeply nested the page, whose time is in proportion
to its size; repeated rows repeat. Other columns pass through, whatever their names; a column
named main_text is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import numbered, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead tr ul br".split()
)
#: An open paragraph ends where one of these starts, and isn't seen from inside one of those.
ENDS_P = BLOCK - frozenset("br td th tr tbody thead tfoot option legend".split())
HIDES_P = frozenset("button td th table article section div main li body".split())
#: Never part of an article.
FURNITURE = frozenset("nav aside footer form script style noscript template iframe button select input textarea dialog menu svg canvas object head title".split())
#: Of these, what may hold the whole page.
WRAPPERS = frozenset(["form"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header figure figcaption time address hr br".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: First or last words of names of furniture, of what is furniture outside articles, and of what may be.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion breadcrumb breadcrumbs nav navbar navigation"
    " menu menus sidebar sidebars aside footer foot cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer copyright popup modal"
    " overlay subscribe newsletter signup login comment comments disqus reply replies respond pagination pager skip skiplink skiplinks".split()
)
HEADER_NAMES = frozenset("header masthead topbar toolbar".split())
WEAK_NAMES = frozenset("banner widget widgets share sharing social related recommend recommended recommendation recommendations search".split())
#: Names that begin so speak of the page's layout.
LAYOUT = frozenset("no not has with without is hide hides show shows".split())
MOST, LINKED = 0.5, 1 / 3
NONE, WEAK, NAMED, DECIDED = range(4)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


#: Places in Node.open of the nearest open paragraph, list item, term, row, cell and option.
P, LI, TERM, ROW, CELL, OPTION = range(6)
_OPENS = {"p": P, "li": LI, "dt": TERM, "dd": TERM, "tr": ROW, "td": CELL, "th": CELL, "option": OPTION}
_HIDES = {"ul": (LI,), "ol": (LI,), "menu": (LI,), "dir": (LI,), "dl": (TERM,), "table": (ROW, CELL), "tr": (CELL,), "select": (OPTION,), "datalist": (OPTION,)}


class Node:
    __slots__ = ("name", "parent", "children", "furniture", "in_article", "inside", "open", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, furniture: int = NONE):
        self.name, self.parent, self.furniture = name, parent, furniture
        self.children: list[Node | str] = []
        self.in_article = name == "article" or parent is not None and parent.in_article
        self.inside = False
        self.open = _open(self, parent)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _open(node: Node, parent: Node | None) -> tuple:
    """What a tag inside node would close."""
    before = parent.open if parent is not None else (None,) * 6
    hidden = _HIDES.get(node.name, ()) + ((P,) if node.name in HIDES_P else ())
    mine = _OPENS.get(node.name)
    if mine is None and not hidden:
        return before
    return tuple(node if i == mine else None if i in hidden else x for i, x in enumerate(before))


def _named(value: str, in_article: bool) -> int:
    """What a class or id says: each of its names by its first and last word."""
    found = NONE
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in LAYOUT and len(words) > 1:
            continue
        ends = {words[0], words[-1]}
        if ends & NAMES or not in_article and ends & HEADER_NAMES:
            return NAMED
        if ends & WEAK_NAMES:
            found = WEAK
    return found


def _is_furniture(name: str, attrs: str, in_article: bool) -> int:
    if name in FURNITURE:
        return NAMED if name in WRAPPERS else DECIDED
    if name == "header" and not in_article:
        return NAMED
    if not attrs or name in ("html", "body", "main", "article"):
        return NONE
    found = NONE
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            found = max(found, _named(value, in_article))
        elif key == "role" and value.strip().lower() in _ROLES or key == "aria-hidden" and value.strip().lower() == "true":
            return DECIDED
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return DECIDED
    return DECIDED if re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs), re.I) else found


def parse(page: str) -> Node:
    """DOM of a page under a node named #root; strings are text with references decoded."""
    root = Node("#root", None)
    at, end, text_from = root, len(page), 0
    pos = 0
    opened: dict[str, int] = {}
    seen: set[str] = set()

    def add_text(raw: str) -> None:
        if raw:
            at.children.append(html.unescape(raw) if "&" in raw else raw)

    def climb(to: Node) -> None:
        nonlocal at
        while at is not to:
            opened[at.name] -= 1
            at = at.parent

    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a bare "<" is text
            pos = lt + 1
            continue
        add_text(page[text_from:lt])
        pos = text_from = m.end()
        if m["cdata"] is not None:
            at.children.append(m["cdata"])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if opened.get(name):
                while at.name != name:
                    climb(at.parent)
                climb(at.parent)
            elif name == "br":
                at.children.append(Node("br", at))
            continue
        if name in ENDS_P and at.open[P] is not None:
            climb(at.open[P].parent)
        ended = at.open[_OPENS[name]] if name in _OPENS and name != "p" else None
        if name == "tr" and ended is None:
            ended = at.open[CELL]
        if ended is not None:
            climb(ended.parent)
        if name in ("body", "html"):
            if name in seen:
                continue
            seen.add(name)
        node = Node(name, at, _is_furniture(name, m["attrs"], at.in_article))
        at.children.append(node)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|$)", re.I).search(page, pos)
            stop = close.start() if close else end
            node.children.append(page[pos:stop])
            pos = text_from = close.end() if close else end
            continue
        at = node
        opened[name] = opened.get(name, 0) + 1
    add_text(page[text_from:])
    return root


def _ordered(top: Node) -> list[Node]:
    """Nodes with each before what it contains; without recursion, as markup may nest deeply."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def _own(n: Node) -> int:
    """Characters of the text right in a node."""
    return sum(len(x) - x.count(" ") for x in n.children if isinstance(x, str) and not x.isspace())


def _weigh(nodes: list[Node]) -> None:
    """Takes back what a name alone says of a node that holds the article or, where no article is elsewhere, most of the text."""
    text, articles = {}, {}
    for n in reversed(nodes):
        at = id(n)
        text[at] = 0 if n.furniture == DECIDED or n.name in RAW else text.get(at, 0) + _own(n)
        articles[at] = max(articles.get(at, 0), text[at] if n.name in ("article", "main") else 0) if text[at] else 0
        if n is not nodes[0] and n.parent is not None:
            up = id(n.parent)
            text[up] = text.get(up, 0) + text[at]
            articles[up] = articles.get(up, 0) + articles[at]
    all_text, all_articles = text[id(nodes[0])], articles[id(nodes[0])]
    for n in nodes:
        if n.furniture in (WEAK, NAMED) and (articles[id(n)] or text[id(n)] > MOST * all_text and not all_articles):
            n.furniture = NONE


def _measure(top: Node) -> list[Node]:
    """Sets inside, chars, tags, density and density sum of all nodes below top; furniture and raw text count nothing above them."""
    nodes = _ordered(top)
    _weigh(nodes)
    linked = set()
    for n in nodes:
        n.inside = n.furniture != NONE or n.name in RAW or n is not top and n.parent is not None and n.parent.inside
        if n.name == "a" or id(n.parent) in linked:
            linked.add(id(n))
    for n in reversed(nodes):
        if n.furniture == DECIDED or n.name in RAW:
            n.chars = n.tags = n.link_chars = n.link_tags = 0
        else:
            own = _own(n)
            n.chars += own
            if id(n) in linked:
                n.link_chars += own
        if n is not top and n.parent is not None and n.furniture == NONE:
            p = n.parent
            p.chars += n.chars
            p.link_chars += n.link_chars
            p.tags += n.tags + 1
            p.link_tags += n.link_tags + (n.name == "a")
    share = top.link_chars / top.chars if top.chars else 0.0
    for n in nodes:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in nodes:
        n.total = sum(x.density for x in n.children if isinstance(x, Node) and x.furniture == NONE) or n.density
    return nodes


def _left_out(n: Node, threshold: float) -> bool:
    """Whether a node is furniture, given what dense text is."""
    return n.furniture >= NAMED or n.furniture == WEAK and (n.density < threshold or n.link_chars > LINKED * n.chars)


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, times a logarithm that falls as links take over the node."""
    if not chars:
        return 0.0
    plain = max(1, chars - link_chars)
    link_chars_, link_tags_ = max(1, link_chars), max(1, link_tags)
    base = math.log(chars / plain * link_chars_ + body_share * chars + math.e)
    ratio = chars / link_chars_ * max(1, tags) / link_tags_
    return chars / max(1, tags) * max(0.0, math.log(max(ratio, 1.0000001)) / math.log(max(base, 1.0000001)) if base > 1 else math.log(max(ratio, 1.0000001)))


def _densest(body: Node, nodes: list[Node]) -> tuple[Node, float]:
    """The node of the largest density sum, and the smallest density from the body to it."""
    top = max((n for n in nodes if not n.inside), key=lambda n: n.total, default=body)
    threshold, n = top.density, top
    while n is not body and n.parent is not None:
        n = n.parent
        threshold = min(threshold, n.density)
    return top, threshold


def _content(body: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the article, in page order, and the threshold."""
    nodes = _measure(body)
    top, threshold = _densest(body, nodes)
    # Headings and parts beside the densest part belong to the article while they reach the threshold themselves.
    while top is not body and (p := top.parent) is not None and p is not body:
        beside = [x for x in p.children if isinstance(x, Node) and x is not top and x.chars and not _left_out(x, threshold) and x.name not in HEADINGS]
        if p.name != "article" and any(x.density < threshold and (x.link_chars > LINKED * x.chars or not _headed(p, top)) for x in beside):
            break
        top = p
    return _kept(body, nodes, top, threshold), threshold


def _headed(n: Node, top: Node) -> bool:
    """Whether n holds a heading right before top or other parts: then these are one article, however short some are."""
    for x in n.children:
        if x is top:
            return False
        if isinstance(x, Node) and x.chars and (_rank(x) if x.name in HEADINGS else 0):
            return True
    return False


def _rank(n: Node) -> int:
    """1 to 6 of a heading; 0 of what else stands with headings."""
    return int(n.name[1]) if n.name[0] == "h" and n.name[1:].isdigit() else 0


def _kept(body: Node, nodes: list[Node], top: Node, threshold: float) -> list[Node]:
    """top and all subtrees beside its path that reach the threshold; a heading where one of them follows before a heading of its rank or above."""
    above, holds = set(), set()
    n = top
    while n is not body and n.parent is not None:
        n = n.parent
        above.add(id(n))
    for n in reversed(nodes):
        if n is not body and (n.name in BLOCK or id(n) in holds):
            holds.add(id(n.parent))
    share = body.link_chars / body.chars if body.chars else 0.0
    found: list[tuple[Node, bool]] = []
    run: list = []

    def end_run() -> None:
        if run:
            block = Node("#run", None)
            block.children = list(run)
            inner = [x for x in run if isinstance(x, Node) and not x.furniture]
            block.chars, block.link_chars = sum((x.chars for x in inner), _own(block)), sum(x.link_chars for x in inner)
            block.tags, block.link_tags = sum(x.tags + 1 for x in inner), sum(x.link_tags + (x.name == "a") for x in inner)
            if block.chars and composite_density(block.chars, block.tags, block.link_chars, block.link_tags, share) >= threshold:
                found.append((block, False))
            run.clear()

    stack: list = [body]
    while stack:
        x = stack.pop()
        if x is None:
            end_run()
        elif x is top:
            end_run()
            found.append((x, False))
        elif isinstance(x, str) or x.name == "br" or id(x) not in above and id(x) not in holds and x.name not in BLOCK and x.name not in HEADINGS:
            run.append(x)
        else:
            end_run()
            if _left_out(x, threshold) or x.name in RAW:
                continue
            if x.name in HEADINGS and id(x) not in above:
                if x.chars:
                    found.append((x, True))
            elif id(x) not in above and x.chars and x.density >= threshold:
                found.append((x, False))
            elif x.name != "a" or id(x) in above:
                stack.append(None)
                stack.extend(reversed(x.children))
    end_run()
    out: list[Node] = []
    above_rank = 7  # headings of lower rank number still have something kept below them
    for x, heading in reversed(found):
        if not heading:
            above_rank = 0
        elif above_rank == 7 or above_rank and _rank(x) >= above_rank:
            continue
        elif r := _rank(x):
            above_rank = r
        out.append(x)
    return out[::-1]


def _is_link_list(n: Node, threshold: float) -> bool:
    """Whether a part outside articles is nothing but links; inside one, such a list is of references, and only names and elements leave it out."""
    return not n.in_article and n.link_tags > 1 and n.density < threshold and n.link_chars > 0.9 * n.chars and n.name in ("ul", "ol", "div", "section", "table")


def _blocks(top: Node, threshold: float) -> list[str]:
    """White-space-normalised text of each block below top, in page order; without furniture and lists of links."""
    out, now = [], []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x is not top and (_left_out(x, threshold) or x.name in RAW or _is_link_list(x, threshold)):
            if x.name in BLOCK:
                flush()
        else:
            if x.name in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """Text of the article of a page; blocks in page order, joined by one space."""
    if not page:
        return ""
    root = parse(page)
    body = next((n for n in _ordered(root) if n.name == "body"), root)
    tops, threshold = _content(body)
    return " ".join(block for top in tops for block in _blocks(top, threshold))


@F.pandas_udf(StringType())
def main_text_of(page: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in page], dtype=object)


def extracted(pages: DataFrame) -> DataFrame:
    """pages with main_text."""
    rows, back = numbered(pages, ("main_text",), main_text=main_text_of(F.col("html")))
    return rows.select(*back, "main_text")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
