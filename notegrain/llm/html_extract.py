"""Main text of HTML pages by composite text density.

The tag stream becomes a tree (implied ends, void and raw-text elements as browsers do).  Every node gets
its composite density: characters per tag, times a logarithm that falls as characters and tags
belong to links, to a base that grows with the page's own share of links.  The node with the largest sum of its
children's densities holds the article; the least density on the path from the body to it is the
threshold above which other nodes count too.  The text is that of the smallest subtree that holds all
of these.  That is so on every page; ``article`` and ``main`` only widen the subtree, to headings and short passages beside the dense ones, and within it
containers whose density is below the threshold and whose text is mostly links go.

Before that, what the page itself declares to be no reading matter goes: by element and role, as HTML defines them, and, as
a minor filter, by a few names of parts that density can't tell from an article since they are prose too: reader comments, adverts, notices, sidebars, headers, footers.

Defined results: null or empty html, and pages without text, give the empty string; html cut off in
a tag loses that tag; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr acronym math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover semantics".split())
#: Blocks that hold reading matter wherever they stand.
READING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: Start tags that end an open element of the second group, if no element of the third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())

# What isn't reading matter.
NOISE_TAGS = frozenset("nav footer aside form button input label legend menu dialog noscript object embed canvas audio video map head fieldset template svg select annotation annotation-xml".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
#: Names of page parts that are prose: no density tells them from an article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar comment comments commentlist disqus respond replies related recommended recommendations share sharing social search login pagination pager toolbar skip toc".split()
)
#: Of these, names of headers, and words that passages have too.
HEADER_WORDS = frozenset("header masthead banner topbar".split())
COMMON_WORDS = HEADER_WORDS | frozenset("related recommended recommendations notice notices promo promotion navigation menu menus consent subscription ad ads sponsored respond share sharing social search login pagination pager toolbar skip toc".split())
#: Words that names of page parts add to these; a name with any other word may be that of a passage.
PART_WORDS = frozenset(
    "list lists box block area section wrapper wrap container inner outer bar main site page post posts article articles entry content link links button buttons btn icon icons top bottom left right primary secondary "
    "global user reader readers thread form title item items col column panel group row slot unit region module policy message text body number count meta header footer story stories news more js wp is has mobile desktop".split()
)
#: Blocks that are dropped by their names alone, wherever they stand.
CONTAINERS = frozenset("div section ul ol dl table header details center dir menu".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "article", "main")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []  # nodes and strings
        self.noise = False
        # the nearest article and main, itself included: looked up often, and pages nest without bound
        self.article = self if tag == "article" else parent.article if parent else None
        self.main = self if tag == "main" else parent.main if parent else None


def tree(page: str) -> Node:
    """The element tree; text stays undecoded in it."""
    root = node = Node("#root", "", None)
    at, raw_end, open_ = 0, len(page), Counter()  # open elements by tag: nothing is looked for that isn't open

    def leave(from_: Node, to: Node) -> None:
        while from_ is not to:
            open_[from_.tag] -= 1
            from_ = from_.parent

    token = _TOKEN.search(page)
    while token:
        begin, end = token.span()
        if begin > at:
            node.children.append(page[at:begin])
        at = end
        close, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if tag and page[end - 1] == ">":
            tag = tag.lower()
            if close:
                if open_[tag] > 0:
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    leave(node, up.parent)
                    node = up.parent
            else:
                if tag in ENDS_P or tag in ENDS:
                    stop, bar = ENDS.get(tag, ({"p"}, frozenset()))
                    stop = stop | {"p"} if tag in ENDS_P else stop
                    up, last = node, None
                    while any(open_[x] > 0 for x in stop) and up is not root and up.tag not in bar and not (tag not in ENDS and up.tag not in INLINE and up.tag not in stop):
                        if up.tag in stop:
                            last = up
                        up = up.parent
                    if last is not None:
                        leave(node, last.parent)
                        node = last.parent
                new = Node(tag, attributes, node)
                node.children.append(new)
                if tag in RAW:  # its content is not markup
                    gone = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|</{re.escape(tag)}\Z", re.I).search(page, end)
                    at = gone.end() if gone else raw_end
                elif tag not in VOID and not (attributes.endswith("/") and (tag in INLINE or tag == "svg")):
                    node = new  # a slash doesn't close an HTML block
                    open_[tag] += 1
        token = _TOKEN.search(page, at)
    if at < len(page):
        node.children.append(page[at:])
    return root


def _facts(attributes: str) -> tuple[list[tuple[str, set[str]]], str, bool]:
    """Words of each class and id, role, and whether it is hidden."""
    names, role, hidden = [], "", False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = (bare or name).lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names.extend((name, set(_WORDS.findall(x))) for x in value.split())
        elif name == "role":
            role = value.strip()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, role, hidden


def _squeezed(text: str) -> int:
    return len(" ".join(entities.unescape(text).split()))


def _measure(node: Node, in_link: bool, order: list[Node]) -> None:
    """Characters, tags and links of every node, children first; iterative, as pages nest without bound."""
    stack = [(node, in_link, False)]
    while stack:
        n, link, done = stack.pop()
        if not done:
            link = link or n.tag == "a"
            stack.append((n, link, True))
            stack.extend((c, link, False) for c in n.children if isinstance(c, Node))
            continue
        chars = tags = link_chars = link_tags = 0
        for c in n.children:
            if isinstance(c, Node):
                if not c.noise:
                    chars, tags, link_chars, link_tags = chars + c.chars, tags + c.tags + 1, link_chars + c.link_chars, link_tags + c.link_tags + (c.tag == "a")
            else:
                k = _squeezed(c)
                chars += k
                link_chars += k if link else 0
        n.chars, n.tags, n.link_chars, n.link_tags = chars, tags, link_chars, link_tags
        order.append(n)


def _mark_noise(root: Node) -> None:
    order: list[Node] = []
    _measure(root, False, order)
    named: dict[int, bool] = {}  # blocks marked by name, role or header tag, and whether as a header
    for n in order:
        if n.tag in NOISE_TAGS:
            n.noise = True
            continue
        if n.tag in ("html", "body", "article", "main", "#root"):
            continue
        names, role, unseen = _facts(n.attributes) if n.attributes else ([], "", False)
        if unseen:
            n.noise = True
        elif n.tag == "header" and n.article is None or role in NOISE_ROLES or any(words & NOISE_WORDS and _says_noise(n, kind, words) for kind, words in names):
            named[id(n)] = n.tag == "header" or role == "banner" or any(words & HEADER_WORDS for _, words in names)
        elif n.tag in ("ul", "ol", "div", "section", "table") and n.link_tags >= 3 and n.link_chars >= 0.8 * max(1, n.chars):
            n.noise = True  # a menu under another name
    articles = [n for n in order if n.tag == "article"]
    replies = [n for n in articles if n.attributes and not _titled(n) and any(words & NOISE_WORDS - COMMON_WORDS and words <= NOISE_WORDS | PART_WORDS - {"has", "is"} for _, words in _facts(n.attributes)[0])]
    if len(replies) < len(articles):  # comments that are articles themselves
        for n in replies:
            n.noise = True
    wraps = _wrappers(order, named) if named else set()
    for n in order:
        if id(n) in named and id(n) not in wraps:
            n.noise = True
            if n.tag == "header" and n.main is not None and _titled(n):  # the header of what the page is about
                n.noise = False


def _says_noise(n: Node, kind: str, words: set[str]) -> bool:
    """Is a block with this class or id no reading matter? A heading always is; in an article, so are paragraphs and passages that aren't mostly links."""
    if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
        return False
    home = n.article or n.main
    if home is not None and n.tag not in CONTAINERS:
        return False
    found = words & NOISE_WORDS
    if found <= HEADER_WORDS and (home is not None or words & {"page", "entry", "post", "article", "content", "story", "title"}) and _titled(n):
        return False
    passage = bool(words - NOISE_WORDS - PART_WORDS)
    if home is not None:
        passage = passage or kind == "id" and found <= COMMON_WORDS and words == found
    else:
        passage = passage and found <= COMMON_WORDS
    return not passage or 3 * n.link_chars >= max(1, n.chars)


def _titled(node: Node) -> bool:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag in ("h1", "h2", "hgroup") and n.chars:
            return True
        stack.extend(c for c in n.children if isinstance(c, Node) and not c.noise)
    return False


def _wrappers(order: list[Node], named: dict[int, bool]) -> set[int]:
    """Named blocks that hold the article itself, by structure alone: its element, or its heading with reading blocks, is in no unnamed place."""
    near: dict[int, int | None] = {}  # the nearest named block about a node, or -1 in noise
    outer: dict[int, int | None] = {}  # and that about a named block
    for n in reversed(order):  # parents first
        above = near[id(n.parent)] if n.parent is not None and id(n.parent) in near else None
        if id(n) in named:
            outer[id(n)] = above
        near[id(n)] = -1 if n.noise or above == -1 else id(n) if id(n) in named else above

    def chain(n: Node) -> list[int] | None:
        found, up = [], near[id(n)]
        while up is not None and up != -1:
            found.append(up)
            up = outer[up]
        return None if up == -1 else found

    around: dict[int, list[int]] = {}
    for n in order:
        if n.tag in ("article", "main", "p", "blockquote", "pre", "h1", "h2", "h3") and n.chars > 2 * n.link_chars and (up := chain(n)) is not None:
            around[id(n)] = up
    kept = [n for n in order if id(n) in around]
    homes, reads, h1 = ([n for n in kept if n.tag in tags] for tags in (("article", "main"), ("p", "blockquote", "pre"), ("h1",)))
    clean = [n for n in homes if not around[id(n)]]
    if any(n.tag == "article" for n in clean):
        return set()
    titled = {id(home) for n in h1 if (home := n.article or n.main)}
    bare = _bare(order[-1], named)
    if homes:
        lost = [n for n in homes if around[id(n)] and (id(n) in titled or not clean or not any(_bare(m, named) for m in clean))]
        best = max(lost, key=lambda n: (id(n) in titled, n.tag == ("article" if id(n) in titled else "main"), n.chars), default=None)
        return set(around[id(best)]) if best is not None else set()
    if any(not around[id(n)] for n in h1):
        return set()
    held = [set(around[id(n)]) for n in reads]
    for n in h1 or ([] if bare else [x for x in kept if x.tag in ("h2", "h3")]):
        about = set(around[id(n)])
        if any(x and x <= about for x in held) and not (any(named[k] for k in about) and not all(held)):
            return about
    return set() if bare or not held else min(held, key=len)


def _bare(top: Node, named: dict[int, bool]) -> bool:
    """Is there text outside links, noise and named blocks?"""
    stack: list = [top]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.strip():
                return True
        elif not n.noise and id(n) not in named and n.tag != "a":
            stack.extend(n.children)
    return False


def _densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(1, body.chars)
    for n in order:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        if not c:
            n.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            n.density = c / t * math.log(max(1.0 + 1e-9, c / max(1, lc) * t / max(1, lt))) / math.log(max(base, 1 + 1e-9)) if base > 1 else c / t * math.log(max(1.0 + 1e-9, c / max(1, lc) * t / max(1, lt)))
        n.total = sum(x.density for x in n.children if isinstance(x, Node) and not x.noise)


def _content(root: Node) -> Node:
    """The smallest subtree that holds all content."""
    body, order = root, []
    _measure(root, False, order)
    for n in order:
        if n.tag == "body" and n.chars:
            body = n
    order = []
    _measure(body, False, order)
    _densities(order, body)
    alive = _alive(body)
    if not alive:
        return body
    best = max(alive, key=lambda n: (n.total, n.density))
    if best.total == 0:
        best = max(alive, key=lambda n: n.chars)
    threshold, up = best.density, best
    while up is not body and up.parent is not None:
        up = up.parent
        threshold = min(threshold, up.density)
    marked = [n for n in alive if n is not body and n.density >= threshold and n.total >= threshold and n.total > 0 and n.tag not in INLINE]
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    place, deepest = {id(n): k for k, n in enumerate(path)}, 0
    for n in marked:  # the lowest common ancestor with each
        up = n
        while id(up) not in place:
            up = up.parent
        deepest = max(deepest, place[id(up)])
    if (home := path[deepest].article or path[deepest].main) is not None:
        deepest = max(deepest, place.get(id(home), deepest))
        # articles beside an article belong to the same text
        while path[deepest].tag == "article" and deepest + 1 < len(path) and any(_article(c) for c in path[deepest + 1].children if c is not path[deepest]):
            deepest += 1
    else:
        # text and reading blocks beside the subtree belong to it
        while deepest + 1 < len(path) and any(_reads(c) for c in path[deepest + 1].children if c is not path[deepest]):
            deepest += 1
    for n in _alive(path[deepest]):  # what is thinner than anything on the way to the article, and mostly links
        if n.tag in CONTAINERS and id(n) not in place and n.density < threshold and 2 * n.link_chars > n.chars:
            n.noise = True
    return path[deepest]


def _alive(top: Node) -> list[Node]:
    """The nodes with text that aren't in noise, in page order."""
    found, stack = [], [top]
    while stack:
        n = stack.pop()
        if n.chars and (not n.noise or n is top):
            found.append(n)
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return found


def _reads(child: Node | str) -> bool:
    if isinstance(child, str):
        return bool(child.strip())
    return child.tag in READING and not child.noise and child.chars > 2 * child.link_chars


def _article(child: Node | str) -> bool:
    return isinstance(child, Node) and child.tag == "article" and not child.noise and child.chars > 2 * child.link_chars


def _text(node: Node) -> str:
    parts: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
        elif not n.noise or n is node:
            block = n.tag not in INLINE
            if block:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(n.children))
    return " ".join("".join(map(entities.unescape, parts)).split())


def main_text(page: str | None) -> str:
    """The article's text: white space squeezed in each block, blocks joined by one space."""
    if not page:
        return ""
    root = tree(page)
    _mark_noise(root)
    return _text(_content(root))


def extract_text(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to keep, text and n_chars (its code points), for every page."""

    names = [f"k{i}" for i in range(len(keep))]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                found = [main_text(x) for x in batch["__html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*names, "text", "n_chars"])

    source = pages.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), F.col(html).alias("__html"))
    kinds = dict(source.dtypes)
    out = source.mapInArrow(T.released(extract), ", ".join(f"{k} {kinds[k]}" for k in names) + ", text string, n_chars bigint")
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "text", "n_chars")
