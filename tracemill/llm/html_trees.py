"""Main text of web pages by gradient-boosted trees over DOM nodes.

The trees score every block element and every run of text by its subtree (length, density of
text and of links), its attribute words, its depth and its siblings. Decoding is hierarchical:
a node is kept only below kept ones, and of all such choices the one with the greatest sum of
log-odds is taken, by dynamic programming over the tree. The trees are learnt from pages that
`sample_page` lays out at random in the usual ways, where every node's role is known.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.common import texts
from tracemill.llm.html_dom import LEAF, WORDS, Node, described, parse

TAG_GROUPS = [
    {"article", "main"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd", "menu"}, {"nav"},
    {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th"},
    {"blockquote", "pre", "figure", "figcaption"}, {"dialog", "details", "summary"}, {LEAF},
]
_GROUP = {t: i for i, group in enumerate(TAG_GROUPS) for t in group}
_POOR = {"nav", "footer", "aside", "form", "dialog"}
N_WORDS = len(WORDS) + 1
DEPTH, TREES, BINS, RATE = 4, 40, 24, 0.3


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    length, links, tags, marks, paragraphs = (np.zeros(n) for _ in range(5))
    holds = np.zeros(n)
    own = np.zeros((n, N_WORDS))
    above = np.zeros((n, N_WORDS))
    group = np.zeros((n, len(TAG_GROUPS)))
    place, siblings, before, poor, good, level = (np.zeros(n) for _ in range(6))
    parent = np.zeros(n, np.int64)
    for node in nodes:
        i = node.index
        level[i] = node.depth
        if node.tag in _GROUP:
            group[i, _GROUP[node.tag]] = 1
        if node.tag == LEAF:
            raw = "".join(node.parts)
            length[i], links[i] = len(raw.strip()), node.links
            marks[i] = raw.count(".") + raw.count(",") - 20 * (raw.count("©") + raw.count("&copy"))
        else:
            own[i] = described(node.attributes)
            paragraphs[i] = node.tag == "p"
            holds[i] = node.tag in ("article", "main")
        tags[i] = node.tags + 1
        count = len(node.children)
        for k, child in enumerate(node.children):
            c = child.index
            parent[c], place[c], siblings[c] = i, k / count, count
            above[c] = np.maximum(above[i], own[i])
            poor[c] = poor[i] + (node.tag in _POOR)
            good[c] = max(good[i], float(node.tag in ("article", "main")))
    for total in (length, links, tags, marks, paragraphs, holds):
        for i in range(n - 1, 0, -1):  # children come after their parents
            total[parent[i]] += total[i]
    for node in nodes:
        run = 0.0
        for child in node.children:
            before[child.index] = run
            run += length[child.index]
    whole = length[parent]
    columns = [
        level, np.log1p(length), links / (length + 1), np.log1p(tags), length / tags, marks * 100 / (length + 20), np.log1p(paragraphs),
        np.minimum(holds, 2), place, np.log1p(siblings), length / (whole + 1), before / (whole + 1), length / (length[0] + 1), poor, good,
    ]
    return np.column_stack([*columns, own, above, group])


class Trees:
    """Logistic gradient boosting with trees of a fixed depth over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.start)
        inner = (1 << DEPTH) - 1
        self.feature = np.zeros((TREES, inner), np.int64)
        self.limit = np.full((TREES, inner), np.inf)
        self.leaf = np.zeros((TREES, 1 << DEPTH))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for d in range(DEPTH):
                first, width = (1 << d) - 1, 1 << d
                best = np.full(width, 1e-6)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    slot = (at - first) * (BINS + 1) + binned[:, f]
                    sums = [np.bincount(slot, v, width * (BINS + 1)).reshape(width, -1) for v in (g, h)]
                    gl, hl = (np.cumsum(s, axis=1) for s in sums)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain = np.where((hl > 0.5) & (ht - hl > 0.5), gain, 0)[:, : len(e)]
                    cut = gain.argmax(axis=1)
                    value = gain[np.arange(width), cut]
                    for k in np.flatnonzero(value > best):
                        best[k] = value[k]
                        self.feature[t, first + k], self.limit[t, first + k] = f, e[cut[k]]
                at = 2 * at + 1 + (x[np.arange(len(y)), self.feature[t, at]] > self.limit[t, at])
            end = at - inner
            gs, hs = (np.bincount(end, v, 1 << DEPTH) for v in (g, h))
            self.leaf[t] = -RATE * gs / (hs + 1)
            score += self.leaf[t, end]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node holds main text."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += leaf[at - len(feature)]
        return total


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """Which nodes to keep: none below a dropped one, the sum of signed log-odds greatest."""
    n = len(nodes)
    drop, keep = -score.astype(float), score.astype(float)
    for node in reversed(nodes):
        for child in node.children:
            drop[node.index] += drop[child.index]
            keep[node.index] += max(drop[child.index], keep[child.index])
    kept = np.zeros(n, bool)
    kept[0] = True  # the page itself; an empty choice keeps nothing below it
    for node in nodes:
        if kept[node.index]:
            for child in node.children:
                kept[child.index] = keep[child.index] > drop[child.index]
    return kept


def main_blocks(nodes: list[Node], kept: np.ndarray) -> list[str]:
    found = (node.text() for node in nodes if node.tag == LEAF and kept[node.index])
    return [t for t in found if t]


def main_text(html: str, trees: Trees) -> str:
    nodes = parse(html)
    return "\n\n".join(main_blocks(nodes, decode(nodes, trees.score(features(nodes)))))


_SYLLABLES = "ta re in on the ver st al mi ca lo de ung er ci que la pe so na".split()


def sample_page(rng: random.Random) -> str:
    """A random page; elements with `data-y` hold main text or nothing else but it."""

    def words(low: int, high: int) -> str:
        made = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        for i in range(rng.randint(4, 12), len(made), rng.randint(5, 14)):
            made[i - 1] += rng.choice([".", ",", "."])
        return " ".join(made).capitalize() + rng.choice([".", ".", ""])

    def element(tag: str, inside: str, names: str = "", main: bool = False) -> str:
        attribute = ""
        if names and rng.random() < 0.85:
            attribute = f' {rng.choice(["class", "class", "class", "id"])}="{rng.choice(names.split())}"'
        return f"<{tag}{attribute}{' data-y' if main else ''}>{inside}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>")

    def link(low=1, high=4) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(low, high)}</a>'

    def links(main=False) -> str:
        items = [element("li", link()) for _ in range(rng.randint(2, 9))]
        return element("ul", "".join(items)) if rng.random() < 0.7 else " | ".join(link() for _ in items)

    def plain(low=5, high=50) -> str:
        return element(rng.choice(["p", "div", "span"]), words(low, high)) if rng.random() < 0.6 else words(low, high)

    def paragraph() -> str:
        kind = rng.random()
        long = rng.choice([(1, 5), (3, 25), (20, 90), (40, 200)])
        if kind < 0.72:
            text = words(*long)
            if rng.random() < 0.25:
                text = f"<{(t := rng.choice(['b', 'em', 'span']))}>{words(2, 9)}" + (f"</{t}> " if rng.random() < 0.7 else "<br>") + text
            if rng.random() < 0.2:
                text += " " + link() + " " + words(2, 20)
            return element("p", text, main=True)
        if kind < 0.8:
            return element(rng.choice(["h2", "h3"]), words(1, 8), main=True)
        if kind < 0.86:
            return element(rng.choice(["ul", "ol"]), "".join(element("li", words(3, 20), main=True) for _ in range(rng.randint(2, 6))), main=True)
        if kind < 0.9:
            return element("blockquote", element("p", words(8, 40), main=True), main=True)
        if kind < 0.94:
            rows = "".join(element("tr", "".join(element("td", words(1, 4), main=True) for _ in range(3)), main=True) for _ in range(3))
            return element("table", rows, main=True)
        return element(rng.choice(["div", "section"]), words(*long), main=True)

    def block(tags: str, names: str, inside: str) -> str:
        own, plainer = rng.choice(tags.split()), rng.random() < 0.5
        return element(own, inside) if plainer and own not in ("div", "section", "p") else element("div" if plainer else own, inside, names)

    comments = lambda: block(
        "section div", "comments comment-list discussion replies responses-comments user-comments",
        (element("h3", words(1, 2)) if rng.random() < 0.5 else "")
        + "".join(element(rng.choice(["div", "li", "article"]), element("p", words(4, 60)), "comment reply comment-body") for _ in range(rng.randint(1, 6))),
    )
    poor = {
        "nav": lambda: block("nav nav div", "nav menu navbar main-menu top-menu breadcrumbs", links()),
        "head": lambda: block("header div", "header masthead site-header top branding", plain(1, 8) + (links() if rng.random() < 0.5 else "")),
        "ad": lambda: block("div div section", "ad ads advert advertisement promo sponsored banner ad-box", plain(3, 60)),
        "notice": lambda: block("div section dialog p", "cookie-notice notice alert consent cookie-banner privacy-notice", plain(4, 50)),
        "side": lambda: block("aside aside div", "sidebar widget side related right-rail", rng.choice([links, plain])() + plain(3, 40)),
        "form": lambda: element("form", f"<label>{words(1, 4)}</label><input name=q>" + plain(1, 12), "search newsletter login subscribe contact-form"),
        "foot": lambda: block("footer footer div", "footer site-footer copyright bottom", rng.choice(["&copy; ", "", "© "]) + plain(3, 25)),
        "share": lambda: block("div ul", "share social related tags more author-meta", links() if rng.random() < 0.6 else plain(1, 12)),
        "comments": comments,
    }
    title = element("h1", words(1, 9), main=True) if rng.random() < 0.8 else ""
    body = title + "".join(paragraph() for _ in range(rng.choice([1, 2, 3, 6, 12])))
    if rng.random() < 0.2:
        middle = poor[rng.choice(["ad", "share", "notice", "form"])]()
        body += middle + paragraph() + paragraph()
    if rng.random() < 0.15:
        body += comments()
    tag, names = rng.choice(
        [("article", ""), ("article", ""), ("article", "post entry story"), ("main", ""), ("main", "content"),
         ("div", "content article post entry-content post-body story article-body main-text"), ("section", "content story article")]
    )
    page = element(tag, body, names, main=True)
    if rng.random() < 0.4:
        beside = "".join(poor[rng.choice(["side", "ad", "share", "notice"])]() for _ in range(rng.randint(0, 2)))
        page = element("div", page + beside if rng.random() < 0.7 else beside + page, "wrapper container page wrap layout", main=True)
    top = "".join(poor[k]() for k in rng.choices(["nav", "head", "ad", "notice", "form"], k=rng.randint(1, 4)))
    bottom = "".join(poor[k]() for k in rng.choices(["comments", "side", "share", "ad", "foot", "notice", "form"], k=rng.randint(0, 4)))
    return f"<body>{top}{page}{bottom}{poor['foot']() if rng.random() < 0.8 else ''}</body>"


def truth(nodes: list[Node]) -> np.ndarray:
    """What `sample_page` meant: marked elements, leaves right below them, and the root."""
    y = np.zeros(len(nodes))
    y[0] = 1
    for node in nodes:
        marked = "data-y" in node.attributes
        y[node.index] = max(y[node.index], marked and node.tag != LEAF)
        for child in node.children:
            if child.tag == LEAF:
                y[child.index] = marked and node.index > 0
    return y


@lru_cache(maxsize=2)
def fit(pages: int = 700, seed: int = 11) -> Trees:
    """Trees learnt from `pages` random pages, the same ones for the same seed."""
    rng = random.Random(seed)
    found = [parse(sample_page(rng)) for _ in range(pages)]
    return Trees(np.concatenate([features(n) for n in found]), np.concatenate([truth(n) for n in found]))


def extracted(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text): one row per row of `pages`, empty where nothing is main text.

    The whole html is read, a null is an empty page. Blocks stand in page order, joined by two
    line breaks, with character references decoded and white space as single spaces. Other
    columns are not used.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees or fit())

    def extract(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [parse(html) for html in texts(batch.column(2))]
                rows = [features(nodes) for nodes in found]
                scores = np.split(sent.value.score(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                made = ["\n\n".join(main_blocks(n, decode(n, s))) for n, s in zip(found, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
