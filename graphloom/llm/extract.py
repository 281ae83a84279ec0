"""Main text of HTML pages by tree scoring: paragraphs pass points for their length and commas
to their ancestors, names add or take points, links discount them, and the best container is kept
with those of its siblings that score like it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare

#: A quote opens a value only behind "="; one that never closes is a character like others.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
_TOKENS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that never hold an article's text.
NEVER = frozenset("script style noscript template iframe textarea title head nav footer aside button select option input svg math canvas object embed audio video dialog menu map noframes noembed fieldset datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr"}
#: An element that opens ends an open one of these, up to the nearest of those.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Siblings of the container that belong to it where they aren't mostly links.
PROSE = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
#: Words of class, id and role that name what a page has beside its article.
AWAY = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar"
    " sidebar sidebars aside widget widgets related recommended recommendations"
    " header masthead footer foot contentinfo complementary hidden"
    " cookie cookies consent gdpr notice notices notification notifications popup modal overlay"
    " newsletter subscribe subscription signup login paywall share sharing"
    " comment comments commentlist disqus replies respond searchbox searchform".split()
)
#: Those of them that a paragraph of the article may carry too: it goes only if it isn't running text.
PLACES = frozenset("share sharing header menu menus nav navigation related aside".split())
#: Words that as often name a part of the article: they only take points.
DOUBTFUL = frozenset("legal disclaimer copyright search alert alerts social follow feedback discussion responses reply toc rail promotion register".split())
#: Words that speak for the article where both kinds meet, as in "article no-sidebar".
TOWARDS = frozenset("article articlebody content entry main post story body text".split())
START = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -3.0}


class Node:
    """away: no part of the article; named: only because of a word of AWAY; place: only because of words of
    PLACES; header: the header of an article; site: a link to another page of the site."""

    __slots__ = ("tag", "parent", "children", "points", "away", "named", "place", "header", "score", "size", "linked", "links", "site", "level")

    def __init__(self, tag: str, parent: Node | None, points: float = 0.0, away: bool = False, named: bool = False, place: bool = False, header: bool = False, site: bool = False):
        self.tag, self.parent, self.points, self.away, self.named = tag, parent, points, away or named, named and not away
        self.place, self.header, self.site = place, header or tag == "header", int(site)
        self.children: list[Node | str] = []
        self.score = 0.0
        self.size = self.linked = self.links = 0
        self.level = parent.level + 1 if parent else 0


def _judge(tag: str, attributes: str, inside: bool) -> tuple[float, bool, bool, bool, bool, bool]:
    """(points, away, named, place, header, site) of an element by its tag and attributes; inside: within an
    article or main."""
    points = START.get(tag, 0.0)
    if tag in NEVER or tag == "header" and not inside:
        return points, True, False, False, False, False
    site = tag == "a"
    if not attributes or attributes.isspace():
        return points, False, False, False, False, site
    words: set[str] = set()
    away = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            words.update(_TOKENS.findall(value.lower()))
        elif name == "hidden" or name == "aria-hidden" and "true" in value.lower() or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            away = True
        elif name == "href" and tag == "a":
            site = not re.match(r"[\"']?\s*(?:#|[a-z][a-z0-9+.-]*:|//)", value, re.I)
    points += 25.0 * bool(words & TOWARDS) - 25.0 * bool(words & DOUBTFUL)
    comment = bool(words & {"comment", "comments"})
    if tag in ("html", "body", "main", "article"):
        return points, away, tag == "article" and inside and comment, False, False, site
    named = bool(words & AWAY) and not words & (TOWARDS - {"body", "text", "content"}) or comment or bool(words & {"sidebar", "ad", "ads", "advert", "cookie"})
    of = words & AWAY
    header = named and inside and of == {"header"} and tag in ("div", "section")
    return points, away, named and not header, named and of <= PLACES, header, site


def parse(html: str) -> Node:
    """The tree of a page. Open ends are closed as browsers do for paragraphs, items and cells; what
    is cut off at the end of the page is let go."""
    root = top = Node("#root", None)
    opened: dict[str, int] = {}
    at, end = 0, len(html)
    inside = 0

    def close(node: Node) -> Node:
        nonlocal inside
        opened[node.tag] -= 1
        inside -= node.tag in ("article", "main")
        return node.parent

    while at < end:
        m = _MARKUP.search(html, at)
        if m is None:
            top.children.append(html[at:])
            break
        if m.start() > at:
            top.children.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                top.children.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[0].endswith(">"):  # cut off
            break
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                while top.tag != tag:
                    top = close(top)
                top = close(top)
            elif tag == "p":
                top.children.append(Node("p", top))
            continue
        if tag in CLOSES_P and opened.get("p"):
            node = top
            while node.parent and node.tag != "p" and node.tag not in ("table", "td", "th", "button", "object"):
                node = node.parent
            if node.tag == "p":
                while top is not node:
                    top = close(top)
                top = close(top)
        elif tag in ENDS and any(opened.get(x) for x in ENDS[tag][0]):
            ended, stop = ENDS[tag]
            node, last = top, None
            while node.parent and node.tag not in stop:
                if node.tag in ended:
                    last = node
                node = node.parent
            if last is not None:
                while top is not last:
                    top = close(top)
                top = close(top)
        node = Node(tag, top, *_judge(tag, m[3], inside > 0))
        top.children.append(node)
        if tag in RAW:
            close_at = re.compile(f"</{re.escape(tag)}(?![^\\s/>])[^>]*>?", re.I).search(html, at)
            at = close_at.end() if close_at else end
        elif tag not in VOID:  # browsers take no heed of "/>" here
            top = node
            opened[tag] = opened.get(tag, 0) + 1
            inside += tag in ("article", "main")
    _settle(root)
    return root


_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*\Z")


def _settle(root: Node) -> None:
    """What names and tags leave open, by the text: a paragraph with a name of PLACES stays if it is running
    text, and a form, unless it holds most of the page's running text, goes."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.children if isinstance(x, Node) and (x.named or not x.away))
    prose: dict[int, int] = {}
    for node in reversed(order):
        node.size = sum(len(x.strip()) if isinstance(x, str) else x.size for x in node.children)
        node.linked = node.size if node.tag == "a" else sum(x.linked for x in node.children if isinstance(x, Node))
        if node.tag in ("p", "pre", "blockquote"):
            running = node.size >= 25 and node.linked < 0.25 * node.size
            if node.place and node.size >= 60 and running and _SENTENCE.search(_flat(_text(node))):
                node.away = node.named = False
            prose[id(node)] = node.size if running and not node.away else 0
        else:
            prose[id(node)] = 0 if node.away else sum(prose.get(id(x), 0) for x in node.children if isinstance(x, Node))
    for node in order:
        if node.tag == "form" and 2 * prose[id(node)] <= prose[id(root)]:
            node.away, node.named = True, False


def _text(node: Node) -> str:
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            stack.extend(reversed(x.children))
    return " ".join(parts)


def _flat(text: str) -> str:
    return " ".join(unescape(text).split())


def measure(root: Node) -> list[Node]:
    """Sets size, linked, links and score of every node that isn't away; returns those with points."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.size = node.linked = node.links = 0
        node.site = node.site if node.tag == "a" else 0
        node.score = 0.0
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node) and not x.away)
    scored: dict[int, Node] = {}
    for node in reversed(order):
        own, commas, block = 0, 0, False
        for x in node.children:
            if isinstance(x, str):
                n = len(x.strip())
                own += n
                commas += x.count(",") + x.count("，") + x.count("、")
            elif not x.away:
                node.size += x.size
                node.linked += x.linked
                node.links += x.links
                node.site += x.site
                commas += int(x.score) if x.tag not in BLOCK else 0
                block = block or x.tag in BLOCK
        node.size += own
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        if node.tag not in BLOCK:
            node.score = float(commas)  # handed on to the block around it
            continue
        text = own + sum(x.size for x in node.children if isinstance(x, Node) and not x.away and x.tag not in BLOCK)
        if text >= 25 and node.parent and node.tag not in HEADINGS and (node.tag in ("p", "pre", "blockquote", "dd", "li") or not block or own >= 25):
            points = 1.0 + commas + min(text / 100.0, 3.0)
            up, level = (node if node.tag in ("div", "section", "article", "main", "pre", "blockquote") else node.parent), 0
            while up is not None and up.parent is not None and level < 5:
                if id(up) not in scored:
                    scored[id(up)] = up
                    up.score = 0.0
                up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
    for node in scored.values():
        node.score = (node.score + node.points) * (1.0 - node.linked / max(1, node.size))
    return list(scored.values())


def _characters(node: Node) -> int:
    """Characters of a node's text, whatever it is named."""
    n, stack = 0, [node]
    while stack:
        for x in stack.pop().children:
            if isinstance(x, str):
                n += len(x.strip())
            elif x.named or not x.away:
                stack.append(x)
    return n


def scores(root: Node) -> list[Node]:
    """Scored nodes. A page all of whose text, links aside, stands in elements with a name of AWAY has its
    article in the one with most text: that name then counts for nothing."""
    while not (scored := measure(root)) and root.size == root.linked:
        named, stack = [], [root]
        while stack:
            for x in stack.pop().children:
                if isinstance(x, Node):
                    (named if x.named and x.away else stack).append(x) if x.named or not x.away else None
        largest = max(named, key=_characters, default=None)
        if largest is None or _characters(largest) < 25:
            break
        largest.away = False
    return scored


def containers(root: Node) -> list[Node]:
    """The best container with its like siblings, in page order, and up to the body those of its
    ancestors; a page without a scored one gives its body."""
    scored = scores(root)
    best = max((n for n in scored if n.tag not in ("body", "html")), key=lambda n: (n.score, n.level), default=None)
    if best is None:
        best = max(scored, key=lambda n: n.score, default=None)
    if best is None:
        body = [root]
        for node in body:
            if node.tag == "body":
                return [node]
            body.extend(x for x in node.children if isinstance(x, Node) and not x.away)
        return [root]
    if best.tag in ("body", "html"):
        return [best]
    known = {id(n) for n in scored}

    def belongs(x: Node) -> bool:
        like = id(x) in known and x.score >= max(3.0, 0.2 * best.score)
        return like or x.header or x.tag in PROSE and x.size > 0 and x.linked < 0.25 * x.size

    kept, node = [best], best
    while node is best or node.parent and node.parent.tag not in ("body", "html", "#root"):
        around = [x for x in node.parent.children if isinstance(x, Node) and (x is node or not x.away and belongs(x))]
        at = next(i for i, x in enumerate(around) if x is node)
        kept = around[:at] + kept + around[at + 1 :]
        node = node.parent
    return kept


def main_text(html: str) -> str:
    """The page's main text: blocks in page order, parted by an empty line. A list of short links within the
    site that stands before the first paragraph is a menu; of an article's header its headings and
    paragraphs stay."""
    root = parse(html)
    blocks: list[str] = []
    line: list[str] = []
    prose = False

    def flush() -> None:
        if line and (text := _flat("".join(line))):
            blocks.append(text)
        line.clear()

    for container in containers(root):
        flush()
        stack: list[Node | str | None] = [container]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.away and x is not container or x.tag in NEVER:
                continue
            elif x is not container and not prose and x.tag in ("ul", "ol", "div", "section", "table") and x.links >= 3 and x.linked > 0.5 * x.size and x.site > 0.5 * x.links and x.linked < 30 * x.links:
                continue
            elif x.header:
                flush()
                stack.extend([None, *_headings(x)])
            else:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                    prose = prose or x.tag in ("p", "pre", "blockquote") and x.size - x.linked >= 25
                elif x.tag in ("br", "td", "th", "img"):
                    line.append(" ")
                stack.extend(reversed(x.children))
        flush()
    return "\n\n".join(blocks)


def _headings(header: Node) -> list[Node]:
    """The headings and running text within an article's own header, last first."""
    found, stack = [], [header]
    while stack:
        x = stack.pop()
        if x.tag in HEADINGS or x.tag in ("p", "pre", "blockquote") and x.size >= 25 and x.linked < 0.25 * x.size:
            found.append(x)
        else:
            stack.extend(y for y in reversed(x.children) if isinstance(y, Node) and not y.away)
    return found[::-1]


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """df with the main text of every row's whole html as column `text`, and n_chars, its code points.

    Null, empty and textless pages give an empty text. Broken markup is read as browsers do as far
    as it matters here. Rows that repeat are read each for itself; columns of df with the results'
    names are replaced; an empty df gives an empty result. No shuffle.
    """

    prepare(df)

    @F.arrow_udf("string")
    def extracted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([main_text(x.as_py() or "") for x in column], pa.string())

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (text.lower(), "n_chars")]
    return df.select(*kept, extracted(F.col(f"`{html}`").cast("string")).alias(text)).withColumn("n_chars", F.length(text).cast("bigint"))
