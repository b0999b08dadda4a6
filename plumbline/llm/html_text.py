"""Main text of web pages by composite text density.

Each element knows its characters, tags, link characters and link tags.  Its density is
characters per tag, adjusted by a logarithm whose base and argument weigh linked text; the
density sum of an element adds the densities of its children.  Menus, headers, footers,
asides, forms, scripts and what is named like an advert, notice or comment are left out
first; a name counts if one word of a class, id or role is such and the others only
say what kind of part it is or where it stands (``comment-list``, ``sidebar-left``), and never takes
most of the unlinked text unless another article stays.  The element of the largest density sum is the article; the lowest density on
its path to the body is the threshold at which blocks beside the path belong to it too.  If the element lies in an
``article`` or ``main`` element, that whole element is taken.

Blocks are what block elements separate; a <br> is white space.  Defined results: a null
or empty page, or one without text, gives an empty text; broken markup is read as far as
it goes (an unclosed tag is closed by its parent, a stray end tag is passed over).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.arrow import blocks, named

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+)|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")

# Elements of HTML by how they are read.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript iframe template button select option input textarea menu dialog head title svg math object embed canvas audio video map noembed noframes".split())
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select div section article main body td th blockquote".split())

#: Words of which the class, id and role names of parts are made that are not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs combx comment comments commentlist complementary consent contentinfo "
    "cookie cookies dialog disclaimer disqus footer gdpr header hidden login masthead menu menus modal nav navbar navigation navigationbar newsletter notice notices "
    "outbrain pager pagination paywall popup privacy promo promos promoted recommended related remark remarks reply replies responses search share sharing shoutbox "
    "sidebar sidebars sidenav signup skip skyscraper social sponsor sponsored sponsors subscribe subscription taboola toc toolbar topbar widget widgets".split()
)
#: Words beside them that only tell the kind, the place or the owner of a part.
PLAIN_WORDS = frozenset(
    "area aside bar block body bottom box card center col column container content count div feed foot form global group head heading holder inner item items "
    "layer left line link links list main meta outer page panel post posts primary reader right row secondary section site slot small story stories thread title top "
    "unit user users view wrap wrapper zone".split()
)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    left_out: bool = False
    named: bool = False
    children: list[Node | str] = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


def named_like_other(words: list[str]) -> bool:
    """Whether one word names a part that is not the article and the others say nothing else."""
    lower = [w.lower() for w in words]
    return any(w in NOT_ARTICLE for w in lower) and all(w in NOT_ARTICLE or w in PLAIN_WORDS for w in lower)


def is_left_out(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element goes for what it is, and whether it is named like a part that goes."""
    if tag in LEFT_OUT:
        return True, False
    if not attributes or tag in ("body", "html", "article", "main") and "omment" not in attributes:
        return False, False
    gone = named_so = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            named_so |= any(named_like_other(NAME_WORD.findall(token)) for token in value.split())
        gone |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return gone, named_so


def leave_out_named(nodes: list[Node]) -> None:
    """Named elements go, but not with most of the unlinked text unless an article stays outside."""
    if not any(n.named for n in nodes):
        return
    place = {id(n): k for k, n in enumerate(nodes)}
    up = [place[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    gone, linked = [n.left_out for n in nodes], [n.tag == "a" for n in nodes]
    for k, p in enumerate(up):
        if p >= 0:
            gone[k], linked[k] = gone[k] or gone[p], linked[k] or linked[p]
    text = [0 if gone[k] or linked[k] else sum(len(c.strip()) for c in n.children if isinstance(c, str)) for k, n in enumerate(nodes)]
    # An article counts by itself: one inside another does not stand beside it.
    articles = [int(n.tag == "article" and not gone[k]) for k, n in enumerate(nodes)]
    around = [0] * len(nodes)
    for k, p in enumerate(up):
        around[k] = around[p] + articles[p] if p >= 0 else 0
    for k in range(len(nodes) - 1, 0, -1):
        text[up[k]] += text[k]
        articles[up[k]] += articles[k]
    for k, n in enumerate(nodes):
        if n.named and (2 * text[k] <= text[0] or around[k] or articles[k] < articles[0]):
            n.left_out = True


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree and all its nodes, parents first."""
    root = Node("html", None)
    nodes, here = [root], root
    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None or tag is None:
            if text is not None or m[0] == "<":
                here.children.append(html.unescape(text or "<"))
            continue
        tag = tag.lower()
        if closing:
            node = here
            while node is not None and node.tag != tag:
                node = None if node.tag in ("article", "td") and tag in INLINE else node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in ("html", "body") and here.tag != "head":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE and tag not in VOID:  # a block ends an open paragraph
            node = here
            while node.tag in INLINE and node.parent is not None:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            node = here
            while node.parent is not None and (node.tag not in HOLDS or node.tag in CLOSES[tag]):
                if node.tag in CLOSES[tag]:
                    here = node.parent
                    if tag != "tr":
                        break
                node = node.parent
        node = Node(tag, here, *is_left_out(tag, attributes))
        here.children.append(node)
        nodes.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            here = node
    return root, nodes


def score(nodes: list[Node]) -> None:
    """Counts, densities and density sums of what is not left out; children come after their parents in ``nodes``."""
    leave_out_named(nodes)
    for node in nodes:
        node.left_out = node.left_out or node.parent is not None and node.parent.left_out
    kept = [n for n in nodes if not n.left_out]
    for node in reversed(kept):
        node.chars += sum(len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = kept[0] if kept else None
    for node in kept:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = log(c / max(1, c - node.link_chars) * node.link_chars + body.link_chars / max(1, body.chars) * c + e)
            node.density = c / t * log(max(1.0, c / lc * t / lt) + 1e-9) / log(base + 1e-9) if base > 1.001 else c / t * log(max(1.0, c / lc * t / lt) + e)
    for node in kept:
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.left_out)


def article(nodes: list[Node]) -> list[Node]:
    """The elements whose text is the article, in page order."""
    kept = [n for n in nodes if not n.left_out and n.chars]
    if not kept:
        return []
    best = max(kept, key=lambda n: (n.total, n.density))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for wanted in ("article", "main"):
        if whole := [n for n in path if n.tag == wanted]:
            return [whole[-1]]
    if best.tag in INLINE or best.tag == "p":
        best = path[1] if len(path) > 1 else best
    threshold = min(n.density for n in path)
    chosen = {id(best)}
    for below, node in zip(path, path[1:], strict=False):
        for x in node.children:
            if isinstance(x, Node) and x is not below and not x.left_out and x.chars and x.density >= threshold and 2 * x.link_chars < x.chars:
                chosen.add(id(x))
    return [n for n in nodes if id(n) in chosen]


def text_blocks(top: Node) -> Iterator[str]:
    """Texts between the edges of block elements."""
    run: list[str] = []
    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:  # the edge of a block
            yield "".join(run)
            run = []
        elif isinstance(x, str):
            run.append(x)
        elif not x.left_out:
            if x.tag == "br":
                run.append(" ")
            edge = [] if x.tag in INLINE else [None]
            todo += edge + x.children[::-1] + edge
    yield "".join(run)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    _, nodes = parse(page)
    score(nodes)
    found = (SPACE.sub(" ", b).strip() for top in article(nodes) for b in text_blocks(top))
    return "\n".join(b for b in found if b)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(row, text): each row of ``pages`` as one struct, and its main text."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            texts = [main_text(h) for h in named(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([named(batch, "row"), pa.array(texts, pa.string())], names=["row", "text"])

    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col(html_column).alias("html"))
    return rows.mapInArrow(stream, StructType(rows.select("row").schema.fields).add("text", "string"))
