"""Main text of web pages by composite text density.

A page is read into a tree (unclosed and misnested elements end as browsers end them) without the elements
that never hold article text. For every node the density is its characters a tag, adjusted by its links:
C / T * log base ln(C LC / (C - LC) + LCb C / Cb + e) of (C T / (LC LT)), with LC, LT the characters and tags
in links and the subscript b the body's. Each node's sum of child densities is taken; the subtree with the
largest is the centre of the article. The threshold is the least density on the path from the body to it:
ancestors are taken in as long as they are below the body and what else they hold reaches the threshold or is
not mostly links. A page's only article (or main) element is taken whole if it lies around or within
the centre; of several the one with two thirds of their text, or else what holds them all. The text of that
subtree is the result, nothing in it dropped.

Classes, ids and roles mark menus, notices, comments and the like by what they end in (site-nav, sidebar-wrapper,
not related-work); marks and forms are judged after the page is measured, and never take out what wraps the
articles, nor what holds most of its article.

Blocks are separated by block-level elements; white space inside one becomes one blank; blocks are joined by
one newline. Character references are decoded once.

Defined results: null and empty html, and pages with no text outside what is left out, give an empty text;
html without tags is one block; a cut-off page counts to its end; a tag with a stray quote ends at its first >;
stray end tags are ignored, in constant time each; repeated rows are extracted alike; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.session import released

# A tag ends at the first > outside quotes; a quote that would run over another tag is a stray one, and that tag ends at its first >, or before the next <.
PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?:(?P<rest>(?:[^<>\"']|\"(?:[^\"<]|<(?![a-zA-Z/!?]))*+\"|'(?:[^'<]|<(?![a-zA-Z/!?]))*+')*+)>|(?P<odd>[^<>]*+)(?:>|(?=<)|\Z))", re.DOTALL
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-label|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
SPACE = re.compile(r"\s+")

# Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("aside button canvas dialog embed footer form head iframe input map menu nav noembed noframes noscript object script select style svg template textarea title audio video".split())
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption option optgroup legend".split())
# An element that may stay open, the ones that end it, and where the search for it stops.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in class, id or role that mark what is no article; a choice of this module.
MARKS = frozenset(
    """ad ads adv advert alert alertdialog advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo
    complementary cookie cookies dialog disclaimer discussion disqus footer footnav gdpr header hidden masthead menu menubar modal nav navbar navigation newsletter
    notice notices notification pager pagination popup promo promoted promotion recommended related respond reply replies search share sharing
    sidebar sidenav signup skip social sponsor sponsored subscribe tagcloud toolbar topbar widget""".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus respond reply replies".split())
# Words that may follow a mark without changing what the element is: sidebar-wrapper is a sidebar, related-work is none.
HOLDERS = frozenset("area bar block body box button buttons container content form group holder inner item items link links list message outer panel section slot text thread unit widget widgets wrap wrapper".split())
KEEPS = frozenset("article body html main".split())
NEGATES = frozenset("has no with without".split())
# Words before "header" that make it the header of the text, not of the page.
TITLED = frozenset("article chapter content entry post story".split())
# What a class of a narrow screen's "hidden" may become on a wider one: md:block.
SHOWN = re.compile(r"(?:^|\s)[\w-]+:(?:block|contents|flex|grid|inline|inline-block|inline-flex|table|visible)(?:\s|$)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose id is a place to link to.
ANCHORED = frozenset("a blockquote caption dd dt figure h1 h2 h3 h4 h5 h6 li p pre table td th tr".split())
SCOPED = frozenset("ul ol menu dl table tr select li dt dd td th option".split())


class Node:
    """An element; `anchor` is its id if nothing else marks it, `article` is the nearest article or main around it, `block` and `scope` the nearest p or block and list or table part, itself included."""

    __slots__ = ("name", "parent", "parts", "drop", "comments", "anchor", "article", "block", "scope", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, drop: bool | None = False, comments: bool = False, anchor: str | None = None):
        self.name, self.parent, self.parts, self.drop, self.comments, self.anchor = name, parent, [], drop, comments, anchor
        self.article = None if parent is None else parent if parent.name in ("article", "main") else parent.article
        self.block = self if parent is None or name in BLOCK else parent.block
        self.scope = self if parent is None or name in SCOPED else parent.scope
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marks(word: str) -> set[str]:
    """The marks that say what an element of this class is: its last part, but for numbers and names of holders."""
    parts = [p for p in re.split(r"[-_]+", word) if p]
    while len(parts) > 1 and (parts[-1] in HOLDERS and parts[-1] not in MARKS or parts[-1][0].isdigit()):
        parts.pop()
    if parts[-1:] == ["header"] and not TITLED.isdisjoint(parts):
        return set()
    # What an element has, or is without, does not say what it is.
    return MARKS.intersection(parts[-1:]) if not NEGATES.intersection(parts) else set()


def _left_out(name: str, attributes: str, parent: Node) -> tuple[bool | None, bool, str | None]:
    """True or False, or None where a mark or a form may also be a wrapper of the article: see _settle; whether it is marked as comments; and its id if that alone marks it."""
    if name in LEFT_OUT and name != "form":
        return True, False, None
    # A header in an article is the article's, elsewhere the page's.
    inside = parent.name in ("article", "main") or parent.article is not None
    if name == "header":
        titled = any(w.endswith("header") and not TITLED.isdisjoint(re.split(r"[-_]+", w)) for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class" for w in (m[2] or m[3] or m[4] or "").lower().split())
        return not (inside or titled), False, None
    found, by_id, own_id = {"form"} if name == "form" else set(), set(), None
    if not attributes.strip() or name in KEEPS:
        return None if found else False, False, None
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and m.start() and attributes[m.start() - 1].isspace() or key == "aria-hidden" and value == "true":
            return True, False, None
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, None
        if key in ("class", "role"):
            marks = set().union(*map(_marks, value.split())) if value else set()
            found |= marks - {"hidden"} if SHOWN.search(value) else marks
        elif key == "id" and name not in ANCHORED:
            own_id = value
            by_id |= set().union(*map(_marks, value.split())) if value else set()
    anchor = own_id if by_id and not found else None
    found |= by_id
    if inside:
        found.discard("header")
    return None if found else False, not COMMENTS.isdisjoint(found), anchor


def _first_heading(node: Node) -> list[str]:
    """The words of the heading that an element begins with; none if it begins otherwise."""
    while node is not None:
        parts = [p for p in node.parts if not isinstance(p, str) or p.strip()]
        if not parts or isinstance(parts[0], str):
            return []
        if parts[0].name in HEADINGS:
            words, stack = [], [parts[0]]
            while stack:
                part = stack.pop()
                if isinstance(part, str):
                    words += re.findall(r"\w+", unescape(part).lower())
                else:
                    stack += reversed(part.parts)
            return words
        node = parts[0] if parts[0].name in ("div", "header", "hgroup") else None
    return []


def _settle(root: Node) -> None:
    """Leaves out the unsure elements, but not those that wrap the page's articles or, on a page without any, its text, nor those that hold most of their article."""
    order, stack, held = [], [root], {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node) and p.drop is not True]
    for node in reversed(order):
        chars, articles, heads = 0, int(node.name in ("article", "main")), int(node.name == "h1")
        for part in node.parts:
            if isinstance(part, str):
                chars += len("".join(part.split()))
            elif part in held:
                chars, articles, heads = (a + b for a, b in zip((chars, articles, heads), held[part], strict=True))
        held[node] = (0 if node.name == "a" else chars, articles, heads)
    chars, articles, heads = held[root]
    for node in order:
        if node.drop is None:
            own = held[node]
            text = own[0] > 0.8 * chars or heads and own[2] == heads and own[0] > 0.5 * chars
            most = node.article is not None and not node.comments and own[0] > 0.5 * held[node.article][0]
            # An id with the words of the heading that follows is a place to link to, and says nothing more; outside an article it may still be what it says.
            place = node.anchor is not None and node.article is not None and _first_heading(node) == re.findall(r"[^\W_]+", node.anchor)
            node.drop = not (place or most or (own[1] == articles if articles else text))


def tree(html: str) -> Node:
    """The page's nodes; parts of a node are strings and nodes in page order."""
    root = Node("body", None)
    here, at, opened = root, 0, Counter()

    def leave(node: Node, to: Node) -> Node:
        """`to`, an ancestor of `node`; what lies between is open no more."""
        while node is not to:
            opened[node.name] -= 1
            node = node.parent
        return to

    for m in PART.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            here.parts.append(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, attributes = name.lower(), m["rest"] or m["odd"] or ""
        if m["end"]:
            if opened[name]:
                up = here
                while up.name != name:
                    up = up.parent
                here = leave(here, up.parent)
            elif name == "p" or name == "br":
                here.parts.append(Node(name, here))
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and here.block.name == "p":
            here = leave(here, here.block.parent)
        if name in ENDED_BY and any(opened[x] for x in ENDED_BY[name][0]):
            ends, stops = ENDED_BY[name]
            up, to = here.scope, here
            while up is not root and up.name not in stops:
                if up.name in ends:
                    to = up.parent
                up = up.parent.scope
            here = leave(here, to)
        node = Node(name, here, *_left_out(name, attributes, here))
        here.parts.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(html, at)
            if name not in LEFT_OUT:
                node.parts.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            here = node
            opened[name] += 1
    if at < len(html):
        here.parts.append(html[at:])
    _settle(root)
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes that are not left out, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.drop]
    return out


def measure(root: Node) -> list[Node]:
    nodes = _in_order(root)
    for node in reversed(nodes):
        link = node.name == "a"
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.drop:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.name == "a")
        if link:
            node.link_chars = node.chars
    body = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * lc + body * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / math.log(base), 0.0) if base > 1 else c / t
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.drop)
    return nodes


def _upwards(node: Node) -> list[Node]:
    """The node and all it lies in."""
    path = [node]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def _has_title(node: Node) -> bool:
    """Whether an element that stays has an h1 that stays."""
    return any(n.name == "h1" and n.chars for n in _in_order(node))


def centre(root: Node) -> Node:
    nodes = measure(root)
    best = max(nodes, key=lambda n: (n.total, n.density))
    if not best.total:
        return root
    path = _upwards(best)
    for name in ("article", "main"):
        own = [n for n in nodes if n.name == name and n.chars and (n.article is None or n.article.name != name)]
        text = [n.chars - n.link_chars for n in own]
        if len(own) > 1 and 3 * max(text) < 2 * sum(text):
            # Several articles, none with two thirds of their text: the page's text is all of them.
            around = [set(map(id, _upwards(n))) for n in own]
            return next(up for up in _upwards(own[0]) if all(id(up) in a for a in around))
        if own:
            first = own[text.index(max(text))]
            if first in path or best in _upwards(first) or len(own) > 1 or _has_title(first):
                return first
    threshold = min(n.density for n in path)
    for up in path[1:]:
        if up is root:
            others = [p for p in root.parts if isinstance(p, Node) and not p.drop and p is not best and p.chars]
            loose = any(isinstance(p, str) and p.strip() for p in root.parts)
            # Paragraphs straight in the body are an article without an element of its own.
            if best.name in BLOCK and best.name not in ("p", "li") and best.chars >= 0.5 * root.chars and not loose and all(p.density < threshold for p in others):
                return best
            return root if best.name in ("p", "li") or best.name not in BLOCK or (others and all(p.name in ("p", "h1", "h2", "h3") for p in others)) else best
        rest = [p for p in up.parts if isinstance(p, Node) and not p.drop and p is not best]
        if all(not p.chars or p.density >= threshold or p.link_chars * 2 < p.chars for p in rest):
            best = up
        else:
            return best if best.name in BLOCK and best.name not in ("p", "li") else up
    return best


def main_text(html: str | None) -> str:
    """The article's text, a line for each block."""
    if not html:
        return ""
    blocks: list[list[str]] = [[]]
    stack: list = [centre(tree(html))]
    while stack:
        part = stack.pop()
        if part is None:
            blocks.append([])
        elif isinstance(part, str):
            blocks[-1].append(unescape(part))
        elif not part.drop:
            edge = part.name in BLOCK
            if part.name == "br":
                blocks[-1].append(" ")
            if edge:
                blocks.append([])
                stack.append(None)
            stack += reversed(part.parts)
    lines = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text})
        released()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(read, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
