"""Main text of web pages by composite text density.

Every page is parsed into a light tree of block elements. A node's composite density is its
characters per tag, adjusted by the share of characters and tags inside links; a node's
density sum adds up its children's densities. The subtree with the largest sum is the
article; neighbours of the path from body to it join where they are as dense as the
least dense node of that path, with a heading that stands right before what is taken. An article element around it,
or sections beside it, join by their share of links instead: short sections and captions belong to it, lists of links don't.
Pages are independent, so this is one map over the rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Elements by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "annotation", "annotation-xml", "canvas", "object", "audio", "video", "dialog", "menu", "fieldset", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {"math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics", "annotation", "annotation-xml"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
# Class tokens and ids that mark what isn't the article, unless ``mute`` finds the page's text there.
NOISE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "sidebar", "sidenav", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "disqus", "replies", "respond", "footer", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "widget", "widgets", "toolbar", "pagination", "pager", "skip", "login", "signup", "tags", "copyright", "disclaimer", "trending", "outbrain", "taboola"}
ADS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "outbrain", "taboola"}
#: Parts of compound names: with the first, the name says what is absent or how the page is laid out.
NEGATED = {"no", "not", "has", "with", "without", "layout", "free"}
AMBIGUOUS = {"nav", "notice", "notices", "promotion", "overlay", "skip", "tags", "site", "sharing", "login", "consent"}
PART = re.compile(r"[-_:.]+|(?<=[a-z0-9])(?=[A-Z])")
NOISE_OUTSIDE = {"header", "masthead", "topbar", "site", "logo", "branding"}

TAG = re.compile(r"""<!--(?>.*?)(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']*(?>(?:"[^"]*"|'[^']*')[^>"']*)*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


HEADING = re.compile("h[1-6]|header|hgroup")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "noise", "suspect", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.suspect: set[str] | bool = False  # tokens of class and id that mark noise
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def compound_noise(token: str) -> bool:
    """Whether a name of several parts (ad-slot, comments_area, relatedPosts) has one that marks noise."""
    parts = {x.lower() for x in PART.split(token) if x}
    return len(parts) > 1 and bool(parts & (NOISE - AMBIGUOUS)) and not parts & NEGATED


def is_noise(tag: str, attributes: str, in_article: bool) -> bool | set[str]:
    """Whether an element is no text by its tag, role or style; the tokens if only its class or id says so."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    suspect: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            tokens = set(value.lower().split())
            suspect |= tokens & NOISE if in_article else tokens & (NOISE | NOISE_OUTSIDE)
            suspect |= {token for token in value.split() if compound_noise(token)}
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return suspect or False


def parse(page: str) -> Node:
    """The page's body as block nodes, inline text and link counts folded into them. What is noise is left out.

    Inline elements are nodes only where their class or id makes them suspect.
    """
    root = Node("body", None, False)
    stack: list[tuple[str, Node]] = [("body", root)]  # open elements with the block that holds their text
    muted = 0  # depth of the stack at which noise began
    in_article = in_link = 0
    at, n = 0, len(page)

    def close(to: int) -> None:
        nonlocal muted, in_article, in_link
        for tag, _ in stack[to:]:
            in_article -= tag in ("article", "main")
            in_link -= tag == "a"
        del stack[to:]
        if muted and len(stack) < muted:
            muted = 0

    def write(text: str) -> None:
        if muted or not text:
            return
        block = stack[-1][1]
        text = entities.unescape(text) if "&" in text else text
        block.children.append(text)
        size = len(text.strip())
        block.chars += size
        if in_link:
            block.link_chars += size

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            write(page[at:])
            break
        write(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                write(m[0][9:-3])
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag doesn't close blocks
            continue
        attributes = m[3] or m[6] or ""
        if tag == "body" or tag == "html":
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in CLOSES_SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag or (tag in ("td", "th") and stack[k][0] in ("td", "th")) or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                    close(k)
                    break
                if stack[k][0] in CLOSES_SAME[tag]:
                    break
        if stack[-1][0] == "head" and tag not in VOID:
            close(len(stack) - 1)
        block = stack[-1][1]
        if not muted:
            block.tags += 1
            if in_link:
                block.link_tags += 1
        if tag in VOID:
            if not muted:
                if tag == "hr":
                    block.children.append(Node("hr", block, False))
                else:
                    block.children.append(" ")
            continue
        if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        noise = not muted and is_noise(tag, attributes, in_article > 0)
        if noise is True:
            muted = len(stack) + 1
            if tag not in INLINE:
                block.children.append(Node(tag, block, True))
        if not muted and (tag not in INLINE or noise):
            node = Node(tag, block, False)
            node.suspect = noise
            block.children.append(node)
            block = node
        stack.append((tag, block))
        in_article += tag in ("article", "main")
        if tag == "a":
            in_link += 1
            block.link_tags += not muted
    return root


def nodes_of(root: Node) -> list[Node]:
    """The nodes that aren't noise, parents first, otherwise in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    return order


def mute(root: Node) -> None:
    """Makes suspect nodes noise, but for those that hold the text: most of the page's text outside links, or its article.

    Most is a half, or nine tenths where an article or main element stands elsewhere; what is called an advertisement
    is never kept for its length. A node holds the article if it is or holds an article or main element, while all other such elements are suspect as well
    or are main elements around it. So a comment thread of article elements beside the article, or in it, is noise.
    """
    order = nodes_of(root)
    if not any(x.suspect for x in order):
        return
    plain: dict[int, int] = {}  # characters outside links in a subtree
    says: dict[int, bool] = {}  # whether a subtree is or holds an article or main element
    for x in reversed(order):
        below = [c for c in x.children if isinstance(c, Node) and not c.noise]
        plain[id(x)] = x.chars - x.link_chars + sum(plain[id(c)] for c in below)
        says[id(x)] = x.tag in ("article", "main") or any(says[id(c)] for c in below)
    within: dict[int, tuple[bool, int]] = {}  # whether a node is suspect or in a suspect one, and the main elements around it
    for x in order:
        held, mains = within[id(x.parent)] if x.parent is not None else (False, 0)
        within[id(x)] = held or x.suspect, mains + (x.parent is not None and x.parent.tag == "main")
    free = sum(x.tag in ("article", "main") and not within[id(x)][0] for x in order)
    for x in order:
        if x.suspect:
            alone = free <= within[id(x)][1]
            most = plain[id(x)] > (0.5 if alone else 0.9) * plain[id(root)] and not x.suspect & ADS
            x.noise = not (most or (alone and says[id(x)]))
    for x in reversed(order):
        if x.tag in INLINE:  # no block of its own: what it holds goes to the block around it
            up = x.parent
            at = next(k for k, c in enumerate(up.children) if c is x)
            up.children[at : at + 1] = [] if x.noise else x.children
            for c in () if x.noise else x.children:
                if isinstance(c, Node):
                    c.parent = up
            for k in () if x.noise else ("chars", "tags", "link_chars", "link_tags"):
                setattr(up, k, getattr(up, k) + getattr(x, k))


def measure(root: Node) -> list[Node]:
    """Fills in chars, tags, density and density sum of every node; returns them, parents first."""
    order = nodes_of(root)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, Node) and not c.noise:
                for k in ("chars", "tags", "link_chars", "link_tags"):
                    setattr(node, k, getattr(node, k) + getattr(c, k))
    page_ratio = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        base = math.log(lc * c / max(1, c - lc) + page_ratio * c + math.e)
        ratio = max(c, 1) / max(1, lc) * t / lt
        node.density = c / t * max(0.0, math.log(max(ratio, 1.0)) / max(base, 1.0)) if c else 0.0
        blocks = [x for x in node.children if isinstance(x, Node) and not x.noise]
        node.total = sum(x.density for x in blocks) if blocks else node.density
    return order


def is_link_list(node: Node) -> bool:
    """Three links or more that make up most of the text."""
    return node.link_tags > 2 and 2 * node.link_chars > node.chars


def join_by_links(best: Node, taken: set[int]) -> None:
    """Takes the whole article element around the best node, its lists of links made noise; without one, the sections beside the best node or around it."""
    path = [best]
    while (up := path[-1].parent) is not None:
        path.append(up)
    articles = [x for x in path if x.tag == "article"]
    if articles:
        taken.add(id(articles[-1]))
        todo = [articles[-1]]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, Node) and not c.noise:
                    c.noise = is_link_list(c) and c not in path
                    todo.append(c)
        return
    for x in path:
        if x.tag == "section":
            beside = [c for c in x.parent.children if isinstance(c, Node) and not c.noise and c.tag in ("section", "figure") and c.chars]
            taken.update(id(c) for c in beside if not is_link_list(c))


def content_roots(root: Node) -> list[Node]:
    mute(root)
    order = measure(root)
    best = max(order, key=lambda x: x.total)  # the outermost among equals, as parents come first
    if not best.chars:
        return [root]
    least, at = best.density, best
    while (at := at.parent) is not None:
        least = min(least, at.density)
    top: dict[int, Node] = {}  # the node of the largest sum in each subtree, the outermost among equals
    for node in reversed(order):
        below = [top[id(c)] for c in node.children if isinstance(c, Node) and not c.noise]
        top[id(node)] = max([node, *below], key=lambda x: x.total)
    taken, todo = {id(best)}, [root]
    while todo:
        node = todo.pop()
        if node is not best and node.density >= least and node.chars:
            taken.add(id(top[id(node)]))
            todo.extend(c for c in node.children if isinstance(c, Node) and not c.noise)
    join_by_links(best, taken)
    chosen, todo = [], [root]
    while todo:
        node = todo.pop()
        if id(node) in taken:
            chosen.append(node)
            continue
        blocks = [c for c in node.children if isinstance(c, Node) and not c.noise]
        # A heading is less dense than what it heads: it joins what follows it.
        for one, after in zip(reversed(blocks[:-1]), reversed(blocks[1:]), strict=True):
            if HEADING.fullmatch(one.tag) and id(after) in taken:
                taken.add(id(one))
        todo.extend(reversed(blocks))
    return chosen


def blocks_of(node: Node) -> Iterator[str]:
    """The node's texts between block boundaries, in page order."""
    todo: list[Node | str | None] = [node]
    open_text: list[str] = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            open_text.append(x)
            continue
        if open_text:
            yield " ".join("".join(open_text).split())
            open_text = []
        if x is not None and not x.noise:
            todo.append(None)
            todo.extend(reversed(x.children))
    if open_text:
        yield " ".join("".join(open_text).split())


def main_text(page: str | None) -> str:
    """The page's article: blocks joined by \\n, white space collapsed, references decoded. Empty for null, empty and textless pages."""
    if not page:
        return ""
    return "\n".join(b for root in content_roots(parse(page)) for b in blocks_of(root) if b)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; columns of those names are replaced, every row stays."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch[html]]
            yield batch.assign(text=text, n_chars=[len(x) for x in text])

    return pages.select(*keep).mapInPandas(run, f"{schema}, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
