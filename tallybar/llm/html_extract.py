"""HTML extraction by composite text density.

The page is parsed into a tree, with end tags that may be left out put in; menus, headers, footers, sidebars, adverts,
notices, forms, scripts, styles and reader comments that are marked as such are left out of it. Every node gets its
link-adjusted characters per tag (composite text density) and the sum of its children's densities; the node with the
largest sum is the centre of the text, and the smallest density on the path from it to the body is the threshold. The text
is what the centre's article holds (the nearest <article> or <main> around it, else the body), less the blocks on that
path, or in the centre itself, that are menus by their density: it is below the threshold, and two links or more make up
most of their characters.

A class, an id or a role marks noise if one of its words, as a whole, names noise (`ad`, `cookie-notice`, `site-footer`), not
if noise is a part of another name (`has-sidebar`, `no-ads`). Further <article>s beside the chosen one are teasers and
stay out.

Defined results: null or empty html, and pages without text, give an empty text; unclosed and stray tags are accepted;
repeated rows give repeated results.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from tallybar.llm.common import by_row, columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold article text.
NOISE = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas button select option input textarea dialog menu object embed audio video map math".split()
)
#: Names of menus, sidebars, notices, adverts and reader comments.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice alert"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar pagination pager share sharing social related recommended"
    " comment comments disqus respond replies newsletter subscribe signup login widget widgets complementary contentinfo search skip".split()
)
#: What such a name may be made up with: where it stands, and what kind of box it is.
NEUTRAL_WORDS = frozenset("site main top bottom left right box bar list block section area wrapper container inner outer unit slot link links item items button buttons form panel".split())
#: A site's header, which is noise outside an article only.
HEADER_WORDS = frozenset(("header", "site-header", "main-header", "top-header"))
#: What may stand in a head; anything else ends it.
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
#: A new one of these closes the open ones of the second set, up to the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


#: Stands between blocks.
BREAK = None


class Node:
    """An element. article: whether it lies in an article; paragraph: the open paragraph around it, up to the next block."""

    __slots__ = ("tag", "parent", "items", "article", "paragraph", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.paragraph = self if tag == "p" else None if tag in BLOCK or parent is None else parent.paragraph
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def names_noise(word: str, inside_article: bool) -> bool:
    """Whether a class, id or role is the name of noise: a noise word, or one made up with neutral words."""
    if word in HEADER_WORDS:
        return not inside_article
    parts = {x for x in re.split(r"[-_]+", word) if x}
    return bool(parts & NOISE_WORDS) and parts <= NOISE_WORDS | NEUTRAL_WORDS


def is_noise(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in NOISE or (tag == "header" and not inside_article):
        return True
    if not attributes:
        return False
    held = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in held or held.get("aria-hidden") == "true" or _UNSEEN.search(held.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(names_noise(word, inside_article) for name in ("class", "id", "role") for word in held.get(name, "").split())


def parse(page: str) -> Node:
    """The tree without comments and noise; items of a node are text and nodes in page order."""
    root = Node("html", None)
    open_tags: Counter[str] = Counter()
    here, at = root, 0

    def close(top: Node) -> Node:
        """End an open element and all that is open in it."""
        node = here
        while node is not top.parent:
            open_tags[node.tag] -= 1
            node = node.parent
        return node

    while at < len(page):
        m = _TOKEN.search(page, at)
        if (m.start() if m else len(page)) > at:
            here.items.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if open_tags["head"] and (tag == "head" if closing else tag not in HEAD_TAGS):
            node = here
            while node.tag != "head":
                node = node.parent
            here = close(node)
            if closing:
                continue
        if tag in ("html", "body"):
            continue
        if closing:
            if open_tags[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = close(node)
            continue
        top = here.paragraph if tag in BLOCK else None  # a block ends an open paragraph and what is open in it
        if tag in CLOSES and any(open_tags[x] for x in CLOSES[tag][0]):
            ends, stops = CLOSES[tag]
            node = here
            while node is not None and node.tag not in stops:
                top = node if node.tag in ends else top
                node = node.parent
        if top is not None:
            here = close(top)
        child = Node(tag, here)
        if tag in VOID or not is_noise(tag, attributes, here.article):
            here.items.append(child)  # noise is parsed like the rest, but hangs on no one
        if tag not in VOID and not attributes.endswith("/"):
            here = child
            open_tags[tag] += 1
    return root


def order(root: Node) -> list[Node]:
    """Nodes, parents first; deep trees need no recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in node.items if isinstance(x, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Characters, tags and densities of every node."""
    nodes = order(root)
    for node in reversed(nodes):
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        children = [x for x in node.items if isinstance(x, Node)]
        node.chars = own + sum(x.chars for x in children)
        node.tags = len(children) + sum(x.tags for x in children)
        node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in children)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in children)
    all_chars, all_links = max(root.chars, 1), root.link_chars
    for node in reversed(nodes):
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, all_links / all_chars)
        node.total = sum(x.density for x in node.items if isinstance(x, Node))
    return nodes


def composite(chars: int, tags: int, link_chars: int, link_tags: int, link_share: float) -> float:
    """Characters per tag, by a logarithm whose base grows with the share of linked characters."""
    if chars == 0:
        return 0.0
    tags, link_chars, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    free = max(chars - link_chars, 1)
    base = math.log(chars / free * link_chars + link_share * chars + math.e)
    inner = chars / link_chars * (tags / link_tags)
    return chars / tags * max(math.log(max(inner, 1.0) + 1e-9) / max(math.log(base + 1e-9), 0.1), 0.0) if inner > 1 else 0.0


def is_menu(x: Node | str, threshold: float) -> bool:
    """Whether a block is a menu by its density and links."""
    return not isinstance(x, str) and x.tag in BLOCK and x.tag not in HEADING and x.link_tags > 1 and 2 * x.link_chars > x.chars and x.density < threshold


def select(root: Node) -> list[Node | str | None]:
    """The text's parts in page order: those of the article around the node with the largest density sum, without menus."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    around = next((i for i, x in enumerate(path) if x.tag in ("article", "main")), len(path) - 1)
    parts: list[Node | str | None] = [x for x in best.items if not is_menu(x, threshold)]
    if best.tag in BLOCK:
        parts = [BREAK, *parts, BREAK]
    for node, parent in zip(path[:around], path[1 : around + 1], strict=True):
        at = next(i for i, x in enumerate(parent.items) if x is node)
        before, after = ([x for x in some if not is_menu(x, threshold)] for some in (parent.items[:at], parent.items[at + 1 :]))
        parts = [*before, *parts, *after]
        if parent.tag in BLOCK:
            parts = [BREAK, *parts, BREAK]
    return parts


def blocks(parts: list[Node | str | None]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(html_lib.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [*reversed(parts)]
    while todo:
        x = todo.pop()
        if x is BREAK:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in BLOCK:
            end()
            todo += [BREAK, *reversed(x.items)]
        elif x.tag in VOID:
            run.append(" ")
        else:
            todo += reversed(x.items)
    end()
    return out


def extract_text(page: str | None) -> str:
    return "\n\n".join(blocks(select(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    rows = columns(pages, page_id="long", url="string", html="string")
    return by_row(rows, lambda found: {"text": [extract_text(p) for p in found]}, "page_id long, url string, text string", ("page_id", "url"))
