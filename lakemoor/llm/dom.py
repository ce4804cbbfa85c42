"""Blocks of text of HTML pages and the tree of elements that hold them.

Only elements that begin a line of their own become nodes; inline markup is part of the text around
it. End tags that HTML lets out are put in, and tags that are never closed end with what holds them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import xxhash

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is not parsed, and elements whose content is no text of the page.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_MUTE = frozenset("head template svg object video audio canvas button select datalist".split())
_HEAD = frozenset("base link meta title script style noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What a start tag closes, and the element behind which it does not look for it.
_CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "caption"}), frozenset({"table"})),
} | {one: (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"})) for one in ("tbody", "thead", "tfoot")}
_TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
_CELLS = frozenset({"td", "th", "caption", "table"})

# Words in a class, an id or a role that mark what is not the article. (Fixed values.)
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertisements adsense adslot banner sponsor sponsored sponsors "
    "promo promos promotion promoted taboola outbrain "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs pager pagination toolbar topbar masthead "
    "footer contentinfo copyright sidebar aside complementary widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications alert alertdialog dialog popup modal overlay paywall "
    "newsletter subscribe subscription signup signin login register "
    "share sharing social follow related recommended recommendations trending popular "
    "comment comments commentlist respond reply replies disqus discussion search searchbox".split()
)
# What they can mean for an element that says itself that it is an article.
_NOT_THE_ARTICLE = frozenset(
    "ad ads advert adverts advertisement sponsored promo comment comments respond reply replies related recommended".split()
)
_MARKED_TAGS = frozenset("nav footer aside form dialog menu fieldset header search".split())
_OF_THE_ARTICLE = frozenset("article post entry story content heading".split())
_LAYOUT = frozenset("with has no without".split())
HIDDEN = "hidden!"

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.DOTALL)
_TO_BRACKET = re.compile(r"[^>]*+(?:>|\Z)")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# A quoted value may hold brackets; a quote that is never closed is a character like any other.
_REST = re.compile(r"""(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|))*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|(?<![0-9])[0-9]{1,2}(?![0-9])")  # longer numbers name pages
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}

MOST_DEEP = 200  # elements nested deeper are lines of the one at this depth
MOST_TOKENS = 12


@dataclass(slots=True, eq=False)
class Node:
    """An element that begins a line, in a page or in the template of many pages.

    ``texts`` counts the pages that hold a text (by hash and length) directly in this element.
    """

    tag: str
    tokens: frozenset[str] = frozenset()
    kids: list[Node] = field(default_factory=list)
    size: int = 1
    pages: int = 1
    times: int = 1
    chars: int = 0
    link_chars: int = 0
    texts: dict[tuple[int, int], int] = field(default_factory=dict)
    members: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    """A line of text: the node that holds it, and how many of its characters are links."""

    node: int
    text: str
    link_chars: int

    @property
    def key(self) -> tuple[int, int]:
        return xxhash.xxh64_intdigest(self.text), len(self.text)


@dataclass(slots=True)
class Page:
    """Nodes in the order they begin (the first is the page itself), each one's parent, and all blocks."""

    nodes: list[Node]
    parents: list[int]
    blocks: list[Block]


@lru_cache(maxsize=100_000)
def marked(tag: str, tokens: frozenset[str]) -> bool:
    """Whether an element's name, class, id or role says that it is not part of the article."""
    if tag in _MARKED_TAGS or HIDDEN in tokens:
        return True
    found = tokens & (_NOT_THE_ARTICLE if tag in ("article", "main") else MARKS)
    if "sidebar" in found and tokens & _LAYOUT:  # a layout with or without one
        found -= {"sidebar"}
    return bool(found) or ("header" in tokens and not tokens & _OF_THE_ARTICLE)


@lru_cache(maxsize=100_000)
def _tokens(attributes: str) -> frozenset[str]:
    found: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "style" and _UNSEEN.search(value)):
            found.add(HIDDEN)
        elif name != "style":
            found.update(token.lower() for token in _TOKEN.findall(unescape(value))[:MOST_TOKENS])
    return frozenset(found)


class _Parser:
    def __init__(self) -> None:
        self.nodes, self.parents, self.blocks = [Node("body")], [-1], []
        self.open: list[tuple[str, int, bool]] = [("body", 0, False)]  # tag, node, whether text counts for nothing
        self.buffer: list[str] = []
        self.link, self.link_chars, self.too_deep = False, 0, 0

    def text(self, raw: str) -> None:
        if self.open[-1][2]:
            if self.open[-1][0] != "head" or raw.isspace():
                return
            self.pop()  # text ends a head that is not closed
        piece = unescape(raw) if "&" in raw else raw
        self.buffer.append(piece)
        if self.link:
            self.link_chars += len(piece)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append(Block(self.open[-1][1], text, min(self.link_chars, len(text))))
            self.buffer, self.link_chars = [], 0

    def pop(self) -> None:
        tag, _, mute = self.open[-1]
        if tag in _BLOCK:
            self.flush()
        self.open.pop()

    def close(self, tags: frozenset[str], behind: frozenset[str]) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``behind`` stands in between."""
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in tags:
                while len(self.open) > at:
                    self.pop()
                return True
            if tag in behind:
                return False
        return False

    def start(self, tag: str, attributes: str) -> None:
        if self.open[-1][0] == "head" and tag not in _HEAD and tag != "head":
            self.pop()
        if tag == "br":
            self.text(" ")
        elif tag == "a":
            self.link = True
        elif tag == "hr":
            self.flush()
        elif tag in _MUTE:
            if len(self.open) < MOST_DEEP:
                self.open.append((tag, self.open[-1][1], True))
        elif tag in _BLOCK:
            if self.open[-1][0] == "p" or (tag in HEADINGS and self.open[-1][0] in HEADINGS):
                self.pop()
            if tag in _CLOSES:
                self.close(*_CLOSES[tag])
            self.flush()
            if len(self.open) >= MOST_DEEP:
                self.too_deep += 1
                return
            tokens = _tokens(attributes) if len(attributes) > 4 else frozenset()
            above, mute = self.open[-1][1], self.open[-1][2]
            name = tag
            if tag == "header" and any(one[0] in ("article", "main") for one in self.open):
                name, tokens = "div", tokens | {"heading"}  # of the article, not of the site
            self.nodes.append(Node(name, tokens))
            self.parents.append(above)
            self.open.append((tag, len(self.nodes) - 1, mute))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag in _BLOCK:
            self.flush()
            if self.too_deep:
                self.too_deep -= 1
            else:
                self.close(frozenset({tag}), frozenset({"table"} - {tag}) if tag in _TABLE_PARTS else _CELLS)
        elif tag in _MUTE:
            self.close(frozenset({tag}), _CELLS if tag != "head" else frozenset())


def parse(html: str) -> Page:
    """The blocks of a page, in its order, and the tree of the elements that hold them."""
    parser, at = _Parser(), 0
    while (opened := html.find("<", at)) >= 0:
        if opened > at:
            parser.text(html[at:opened])
        if (name := _NAME.match(html, opened + 1)) is not None:
            rest = _REST.match(html, name.end())
            if rest is None:  # a tag that never ends
                at = len(html)
                break
            tag, at = name.group().lower(), rest.end()
            if tag in _RAW:
                end = _ENDS[tag].search(html, at)
                at = _TO_BRACKET.match(html, end.end()).end() if end else len(html)
            elif tag not in _VOID or tag in ("br", "hr"):
                parser.start(tag, rest.group())
        elif html.startswith("</", opened):
            end = _NAME.match(html, opened + 2)
            at = _TO_BRACKET.match(html, opened + 2).end()
            if end is not None:
                parser.end(end.group().lower())
        elif html.startswith("<!--", opened):
            at = _COMMENT.match(html, opened).end()
        elif html.startswith(("<!", "<?"), opened):
            at = _TO_BRACKET.match(html, opened).end()
        else:
            parser.text("<")
            at = opened + 1
    if at < len(html):
        parser.text(html[at:])
    while len(parser.open) > 1:
        parser.pop()
    parser.flush()
    return Page(parser.nodes, parser.parents, parser.blocks)
