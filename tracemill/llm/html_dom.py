"""A small tolerant HTML reader: block elements as nodes, runs of text between them as leaves."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text: what follows is not markup until the end tag, and never text of the page.
RAW = frozenset("script style title template textarea iframe".split())
#: Parts of forms: their text doesn't count, up to the end tag or the next border of a block.
CONTROLS = frozenset("select button".split())
BLOCKS = frozenset(
    "body noscript div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "form fieldset legend figure figcaption blockquote pre details summary address hr center dialog menu".split()
)
#: A new element of the kind ends an open one, up to the nearest of its containers.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
LEAF = "#text"

#: Words of class names, ids and roles, by what they tell of an element.
WORDS = {
    "main": "article content main post entry story body text page blog news prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager skip toolbar",
    "frame": "header masthead footer foot copyright colophon legal logo branding top bottom",
    "side": "sidebar side aside widget rail complementary column",
    "advert": "ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored sponsors adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay dialog warning message toast disclaimer privacy",
    "comment": "comment comments reply replies respond discussion disqus thread feedback reviews",
    "form": "form search login signup subscribe subscription newsletter register contact input poll",
    "social": "share sharing social follow like tweet related recommended recommend more tags tag author meta popular trending",
}
_CATEGORY = {w: i for i, words in enumerate(WORDS.values()) for w in words.split()}


@lru_cache(maxsize=4096)
def described(attributes: str) -> tuple[int, ...]:
    """Counts of words of each category in the attributes, then whether they hide the element."""
    counts, hidden = [0] * len(WORDS), 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = 1
        elif name != "style":
            for token in _TOKEN.findall(value):
                i = _CATEGORY.get(token.lower())
                if i is not None:
                    counts[i] += 1
    return (*counts, hidden)


class Node:
    __slots__ = ("attributes", "children", "depth", "index", "links", "parts", "tag", "tags")

    def __init__(self, tag: str, attributes: str, depth: int, index: int):
        self.tag, self.attributes, self.depth, self.index = tag, attributes, depth, index
        self.children: list[Node] = []
        self.parts: list[str] = []  # of a leaf
        self.links = self.tags = 0

    def text(self) -> str:
        """Character references decoded, runs of white space as one space, trimmed."""
        return _SPACE.sub(" ", unescape("".join(self.parts))).strip()


def parse(html: str) -> list[Node]:
    """All nodes in page order, the root first; leaves are nodes with the tag `LEAF`.

    Unclosed and misplaced tags are borne as browsers do in the common cases: a block ends an
    open paragraph, list items and cells end each other, stray end tags are left out. Only raw-text elements
    take what follows an opening tag without an end; drawings, formulas and the fallback of embedded
    objects are text of the block they stand in.
    """
    root = Node("body", "", 0, 0)
    nodes, stack, leaf = [root], [root], None
    in_link, at, muted = False, 0, ""

    def text(raw: str) -> None:
        nonlocal leaf
        if muted:
            return
        if leaf is None:
            if raw.isspace():
                return
            leaf = Node(LEAF, stack[-1].attributes, stack[-1].depth + 1, len(nodes))
            stack[-1].children.append(leaf)
            nodes.append(leaf)
        leaf.parts.append(raw)
        if in_link:
            leaf.links += len(raw)

    while at < len(html):
        found = _TAG.search(html, at)
        if found is None:
            text(html[at:])
            break
        if found.start() > at:
            text(html[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name, closing = name.lower(), bool(found[1] or found[4])
        if name in RAW:
            if not closing and not (found[3] or "").rstrip().endswith("/"):
                end = re.compile(f"</{name}\\s*>", re.I).search(html, at)
                at = len(html) if end is None else end.end()
            continue
        if name in CONTROLS:
            if not closing:
                muted = muted or name
            elif muted == name:
                muted = ""
            continue
        if name == "head":  # links and settings; text in it would be no page's
            continue
        if name == "html":
            continue
        if name == "body":
            if not closing:
                root.attributes = found[3] or ""
            continue
        if name in BLOCKS or "-" in name:
            leaf, in_link, muted = None, False, ""
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "table") and name not in ("tr", "table", "tbody", "thead", "tfoot", "td", "th"):
                        break
                continue
            if stack[-1].tag == "p" or (len(stack) > 1 and stack[-1].tag[0] == "h" and stack[-1].tag == name):
                stack.pop()
            if name in _ENDS:
                ended, within = _ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in ended:
                        del stack[i:]
                        break
            node = Node(name, found[3] or found[6] or "", stack[-1].depth + 1, len(nodes))
            stack[-1].children.append(node)
            nodes.append(node)
            if name != "hr":
                stack.append(node)
        else:
            if name == "a":
                in_link = not closing
            elif name == "br" and leaf is not None:
                leaf.parts.append(" ")
            (leaf or stack[-1]).tags += 1
    return nodes
