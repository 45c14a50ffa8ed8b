"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from motionlake.llm.common import map_batches

#: Elements without content, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that never hold the article's text.
DROPPED = RAW | frozenset("nav footer aside form button select option head svg object video audio canvas dialog menu menuitem annotation annotation-xml".split())
#: Words of a class or id that tell of what stands around an article.
AROUND = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent notice popup modal overlay sidebar side nav navbar navigation subnav topnav"
    " menu breadcrumb breadcrumbs masthead footer comment comments commentlist disqus replies respond share sharing social related recommend recommended recommendations newsletter"
    " subscribe subscription signup widget widgets toolbar pagination pager".split()
)
#: Words that may stand beside those in a class or id without telling of anything else; with any other word (ad-hoc, side-by-side) it tells nothing.
BESIDE = frozenset(
    "a above all area article articles bar below block bottom box button buttons center col column container content desktop first form full global group header heading icon icons in inner item items js large last"
    " left line link links list main mobile module outer page panel posts primary right row secondary section site slot small stories sticky tertiary text the title top unit web wrap wrapper zone".split()
)
#: Elements that no class or id removes: headings, and what stands within a line.
SPARED = frozenset("h1 h2 h3 h4 h5 h6 a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math".split())
#: A header that isn't the page's; first words by which a class tells of a layout (no-sidebar) and not of a place; and words of comment lists.
OWN_HEADER, LAYOUT, COMMENTS = frozenset("article content title".split()), frozenset("no with has without".split()), frozenset("comment comments commentlist disqus".split())
ROLES_AROUND = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that count as paragraphs when they hold text.
PARAGRAPHS = frozenset("p pre td blockquote dd li div section article main body".split())
#: An open p ends where one of these begins; other elements end an open one of their kind.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot div section article main body td blockquote html".split())
#: Points that an element's kind adds to its score.
BONUS = {"article": 15.0, "main": 8.0, "section": 3.0, "div": 2.0, "blockquote": 1.0, "ul": -3.0, "ol": -3.0, "table": -3.0, "li": -3.0}

_OPEN = re.compile(r"<(?=[A-Za-z!?/])")
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag; nothing is tried twice, so the search is linear.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "score", "size", "linked", "scope", "open", "inside", "holds", "heading")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.items: list[Node | str] = []
        self.score = 0.0
        self.size = self.linked = 0
        #: The nearest element that holds blocks, itself or above; and, in such a one, how many of each tag are open below it up to the next.
        self.open: dict[str, int] | None = {} if parent is None or tag in HOLDS else None
        self.scope: Node = self if self.open is not None else parent.scope
        #: Whether it has been found to hold an article or the main part: then all above has been as well.
        self.holds = False
        self.heading: bool | None = None
        self.inside: bool = tag in ("article", "main") or (parent is not None and parent.inside)


def tags(source: str) -> Iterator[tuple[str, str, str, str]]:
    """``(text before, "/" or nothing, tag, attributes)`` of each tag, with a last one of no tag for the text at the end.

    A comment or declaration is left out. A ``<`` after which no tag ends is text. Where quotes never close,
    tags from there on end at the next ``>``, quoted or not.
    """
    at, begun, end, last, quotes = 0, 0, len(source), source.rfind(">"), True
    held: list[str] = []
    while m := _OPEN.search(source, at):
        i = m.start()
        if source.startswith("<!--", i):
            close = source.find("-->", i + 4)
            held.append(source[begun:i])
            begun = at = close + 3 if close >= 0 else end
            continue
        if i > last:
            break
        name = _NAME.match(source, i + 1)
        if not name:  # a declaration, an instruction, or an end tag without a name
            held.append(source[begun:i])
            begun = at = source.find(">", i) + 1
            continue
        rest = _REST.match(source, name.end()) if quotes else None
        quotes = quotes and rest is not None
        stop = rest.end() if rest else source.find(">", name.end()) + 1
        if not stop:
            break
        tag = name[2].lower()
        yield "".join((*held, source[begun:i])), name[1], tag, source[name.end() : stop - 1]
        held, at = [], stop
        if not name[1] and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            at = (source.find(">", close.end()) + 1 or end) if close else end
        begun = at
    yield "".join((*held, source[begun:])), "", "", ""


def tree(source: str) -> Node:
    """The element tree; end tags that fit nothing are skipped, elements left open end with what holds them.

    Counts of open elements tell at once whether an end tag fits one, so each step up closes an element.
    """
    root = node = Node("html", None)
    opened: dict[str, int] = {}
    articles = 0

    def up() -> None:
        nonlocal node
        opened[node.tag] -= 1
        node.parent.scope.open[node.tag] -= 1
        node = node.parent

    for text, slash, tag, attributes in tags(source):
        if text:
            node.items.append(text)
        if not tag or tag == "html" or tag in RAW:
            continue
        if slash:
            # Inline elements are closed up to the next element that holds blocks; blocks across others.
            if node.tag == tag or node.scope.open.get(tag) or (tag in BLOCKS and opened.get(tag)):
                while node.tag != tag and node.parent:
                    up()
                if node.parent:
                    up()
            continue
        own = ENDS_OWN.get(tag, ())
        ends = {*own, "p"} if tag in ENDS_P else set(own)
        while node.parent and any(node.scope.open.get(t) for t in ends):
            up()
        if own and node.tag in own and node.parent and node.open is not None:
            up()
        child = Node(tag, node, tag in DROPPED or (tag != "body" and _around(tag, attributes, node.inside)))
        node.items.append(child)
        if tag == "main" or tag == "article" and not child.dropped and not articles:
            # What holds the first article, or the main part, is no sidebar, whatever its class says.
            articles += 1
            holder = node
            while holder and not holder.holds and holder.tag not in DROPPED and not holder.inside:
                holder.dropped, holder.holds, holder = False, True, holder.parent
        if tag not in VOID and not attributes.endswith("/"):
            node.scope.open[tag] = node.scope.open.get(tag, 0) + 1
            opened[tag] = opened.get(tag, 0) + 1
            node = child
    return root


def _around(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's class, id, role or hiding tells that it is no part of the article."""
    if not attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "style" and _UNSEEN.search(value):
            return True
        if name == "role" and value.strip().lower() in ROLES_AROUND:
            return True
        if name == "class" or name == "id":
            words = [[p.lower() for p in _PARTS.findall(w)] for w in value.split()]
            if tag in ("article", "main") or (inside and name == "id"):
                # An article's own class says what it is about; ids in it are mostly made from its headings.
                if any(w and w[0] in COMMENTS and BESIDE.issuperset(w[1:]) for w in words) and tag not in SPARED:
                    return True
            elif tag not in SPARED and any(_tells(w, inside) for w in words):
                return True
    return False


def _tells(word: list[str], inside: bool) -> bool:
    """Whether a class or id, in parts, names what stands around an article, and nothing else."""
    if not word or word[0] in LAYOUT:
        return False
    if AROUND.isdisjoint(word):
        return "header" in word and not inside and BESIDE.issuperset(word) and word[0] not in OWN_HEADER
    return all(p in AROUND or p in BESIDE or p.isdigit() for p in word)


def walk(node: Node) -> Iterator[Node]:
    """Kept elements, parents first."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [x for x in reversed(n.items) if isinstance(x, Node) and kept(x)]


def kept(node: Node) -> bool:
    """Whether an element belongs to the text; a header does inside an article, unless most of its text is links."""
    if node.tag == "header" and not node.dropped:
        if node.inside and node.heading is None:
            node.heading = _unlinked(node)
        return bool(node.inside and node.heading)
    return not node.dropped


def _unlinked(node: Node) -> bool:
    """Whether half of an element's text, or more, is in no link; elements within it are looked at once, whatever headers they hold."""
    size = linked = 0
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, link = stack.pop()
        if isinstance(x, str):
            n = len(x.strip())
            size, linked = size + n, linked + n * link
        elif x is node or not (x.dropped or x.tag == "header"):
            stack += [(y, link or x.tag == "a") for y in x.items]
    return 2 * linked <= size


def score(root: Node) -> Node:
    """Give points to ancestors, discount by link density, and return the best container."""
    order = list(walk(root))
    for n in reversed(order):
        own = "".join(x for x in n.items if isinstance(x, str)).strip()
        for x in n.items:
            if isinstance(x, Node) and kept(x):
                n.size += x.size
                n.linked += x.linked
        n.size += len(own)
        if n.tag == "a":
            n.linked = n.size
    points = {id(n): 0.0 for n in order}
    for n in order:
        text = "".join(_inline(n)) if n.tag in PARAGRAPHS else ""
        if not text.strip():
            continue
        p = 1.0 + text.count(",") + min(len(text) / 100, 3.0)
        p *= 1 - (n.linked / n.size if n.size else 0)
        up, share = (n.parent if n.tag in ("p", "pre", "td", "blockquote", "dd", "li") else n), 1.0
        while up and share >= 0.25:
            points[id(up)] += p * share
            up, share = up.parent, share / 2
    best = root
    for n in order:
        n.score = (points[id(n)] + (BONUS.get(n.tag, 0.0) if points[id(n)] else 0.0)) * (1 - (n.linked / n.size if n.size else 0))
        if n.tag in ("div", "section", "article", "main", "body", "td", "blockquote") and n.score > best.score:
            best = n
    # A container that holds too little of the unlinked text around it is a part of the article.
    while best.parent and best.tag not in ("article", "main") and best.size - best.linked < 0.6 * (best.parent.size - best.parent.linked):
        best = best.parent
    return best


def _inline(node: Node) -> Iterator[str]:
    """Text of a block itself: of its strings and inline elements, not of blocks inside."""
    stack = list(reversed(node.items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif x.tag not in BLOCKS and kept(x):
            stack += reversed(x.items)


def blocks(node: Node) -> list[str]:
    """The element's blocks in page order: references decoded, white space made one space, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif x is node or kept(x):
            if x.tag == "br":
                held.append(" ")
            elif x.tag in BLOCKS:
                end()
                stack.append(None)
            stack += reversed(x.items)
    end()
    return out


def main_text(source: str) -> str:
    """The blocks of the best container, of its siblings that score well and of what is between them, joined by line ends."""
    root = tree(source)
    best = score(root)
    if best.tag in ("article", "main", "body", "html") or best.parent is None:
        return "\n".join(blocks(best))
    least = max(10.0, 0.2 * best.score)
    around = [x for x in best.parent.items if isinstance(x, str) or kept(x)]
    good = [k for k, x in enumerate(around) if x is best or _belongs(x, least)]
    # Between chosen siblings short paragraphs, loose strings and inline elements belong to the article as well.
    chosen, held = set(good), Node("div", None)
    for k in range(good[0], good[-1] + 1):
        x = around[k]
        if isinstance(x, str) or (k in chosen) or x.tag not in BLOCKS or x.linked < 0.5 * x.size:
            held.items.append(x)
    return "\n".join(blocks(held))


def _belongs(x: Node | str, least: float) -> bool:
    """Whether a sibling of the best container is chosen for itself."""
    if isinstance(x, str):
        return False
    density = x.linked / x.size if x.size else 0
    return x.score >= least or (x.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and density < 0.25 and (x.size > 80 or x.tag[0] == "h"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the article's text, and ``n_chars``, its code points.

    A page has one article: of several, that of the best score. Headings and what stands within a line are never left
    out for a class; a class or id leaves an element out if all its parts are words of places around an article.
    Null or empty html gives an empty text, and so does a page without text. Whole pages are
    read, whatever their length; repeated rows each give a row; an empty table gives none; other
    columns pass through, but for ones named ``text`` or ``n_chars``, which are replaced.
    """
    pages = pages.drop("text", "n_chars")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) if h else "" for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

        return step

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "text string, n_chars bigint"])
    return map_batches(pages, make, schema)
