"""op5: the reader, the decoding, and pages whose main text is known."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracemill.llm import html_trees
from tracemill.llm import queries as q
from tracemill.llm.html_dom import LEAF, parse
from tracemill.llm.html_trees import decode, features, fit, main_text, sample_page, truth

from .conftest import SF, frame

PAGES = {
    "<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div class='cookie-notice'>We use cookies.</div>"
    "<article><h1>A title &amp; more</h1><p>First   <b>bold</b>\n text.<p>Second, with <a href=/a>a link</a> inside it.</article>"
    "<aside class=sidebar><p>Read also this.</p></aside><section class=comments><p>I disagree, said a reader.</p></section>"
    "<form><label>Mail</label><input name=q></form><footer>&copy; 2020 nobody</footer>": "A title & more\n\nFirst bold text.\n\nSecond, with a link inside it.",
    "<body><header><h2>Site</h2></header><main><p>Only this sentence is the text of the page, and no other.</p>"
    "<script>var x = '<p>no</p>';</script><style>p{}</style></main><div class='ad'>Buy now.</div></body>": "Only this sentence is the text of the page, and no other.",
    "": "",
    None: "",
    "<!-- only a comment -->": "",
}


def test_known_pages(spark):
    rows = [(i, "u", h, "t", 1.5) for i, h in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, score double").repartition(2)
    found = {r.page_id: r.text for r in html_trees.extracted(pages).collect()}
    assert found == dict(enumerate(PAGES.values()))
    assert html_trees.extracted(pages.limit(0)).count() == 0


def article(inner):
    return (
        "<html><head><title>T</title><meta name=a></head><body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1>"
        f"<p>The first paragraph stands here, with enough words to be one.</p>{inner}</article><footer>&copy; nobody</footer></body>"
    )


FIRST = "Title of it\n\nThe first paragraph stands here, with enough words to be one."

ODD_MARKUP = {
    "<p>An icon <svg viewBox='0'> and text after it that goes on for a while.</p><p>And one more paragraph of text.</p>": (
        "An icon and text after it that goes on for a while.",
        "And one more paragraph of text.",
    ),
    "<p>The mass is <math><mi>E</mi><mo>=</mo><mn>3</mn></math> joule, as the text says here.</p>": ("The mass is E=3 joule, as the text says here.",),
    "<p>See <object data=x>the fallback text</object> in this long enough sentence.</p>": ("See the fallback text in this long enough sentence.",),
    "<p>Press <button>Copy</button> to go on with this long enough sentence.</p>": ("Press to go on with this long enough sentence.",),
    "<p>An unclosed <button>Copy</p><p>doesn't take the next paragraph along with it.</p>": ("An unclosed", "doesn't take the next paragraph along with it."),
    "<p>Words before <select><option>a<option>b</p><p>and words after an unclosed choice of options.</p>": (
        "Words before",
        "and words after an unclosed choice of options.",
    ),
    "<p>Words before <canvas></canvas><video src=v>a film</video> and after it in one paragraph.</p>": ("Words before a film and after it in one paragraph.",),
    "<p>Some script <script>if (a < b) { '<p>x</p>' }</script> is not in this paragraph of text.</p>": ("Some script is not in this paragraph of text.",),
}


@pytest.mark.parametrize("inner", list(ODD_MARKUP))
def test_odd_markup_loses_no_text(inner):
    assert main_text(article(inner), fit()) == "\n\n".join([FIRST, *ODD_MARKUP[inner]])


def test_an_unclosed_noscript_takes_nothing_along():
    found = main_text(article("<noscript>Please turn scripts on.<p>The paragraph after it is read as before, with all its words.</p>"), fit())
    assert found.startswith("Title of it") and "The paragraph after it is read as before, with all its words." in found


def test_long_repeated_and_unnamed_pages(spark):
    long = article("".join(f"<p>Paragraph number {i} of a very long page, with words enough.</p>" for i in range(4000)))
    rows = [(1, "u", long), (1, "u", long), (None, None, article("")), (None, "v", "")]
    found = html_trees.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = sorted((r.page_id or 0, len(r.text)) for r in found)
    want = FIRST + "".join(f"\n\nParagraph number {i} of a very long page, with words enough." for i in range(4000))
    assert texts == [(0, 0), (0, len(FIRST)), (1, len(want)), (1, len(want))]


def test_given_pages_keep_whole_articles(spark):
    pages = {r.page_id: r.html for r in frame(spark, "pages").collect()}
    for r in q.op5_html_trees(spark, SF).collect():
        html = pages[r.page_id]
        article = html[html.index("<article>") : html.index("</article>")]
        want = "\n\n".join(n.text() for n in parse(article) if n.tag == LEAF and n.text())
        assert r.text == want and r.n_chars == len(r.text)


def test_unseen_layouts():
    rng, exact = random.Random(99), []
    for _ in range(150):
        nodes = parse(sample_page(rng))
        kept, y = decode(nodes, fit().score(features(nodes))), truth(nodes)
        exact.append(all(kept[n.index] == (y[n.index] > 0) for n in nodes if n.tag == LEAF))
    assert np.mean(exact) > 0.85


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    nodes = parse("<div><p>a</p><section><p>b</p>c<ul><li>d<li>e</ul></section></div><p>f</p>")
    for _ in range(30):
        score = rng.normal(size=len(nodes))
        kept = decode(nodes, score)
        parent = {c.index: n.index for n in nodes for c in n.children}
        best = -1e9
        for bits in range(1 << (len(nodes) - 1)):
            choice = np.array([True] + [bool(bits >> i & 1) for i in range(len(nodes) - 1)])
            if all(choice[parent[i]] or not choice[i] for i in range(1, len(nodes))):
                best = max(best, (score * np.where(choice, 1, -1)).sum())
        assert all(kept[parent[i]] or not kept[i] for i in range(1, len(nodes)))
        assert (score * np.where(kept, 1, -1)).sum() == pytest.approx(best)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a<p>b<p>c</div>d", ["a", "b", "c", "d"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<p>a<br>b&nbsp;&lt;c", ["a b <c"]),
        ("x < y and <b unclosed", ["x < y and <b unclosed"]),
        ("<textarea><p>no</textarea><p title='a>b'>yes", ["yes"]),
        ("<div>" * 3000 + "deep", ["deep"]),
        ("<script>never closed <p>x", []),
    ],
)
def test_tolerant_reader(html, want):
    assert [n.text() for n in parse(html) if n.tag == LEAF and n.text()] == want
    main_text(html, fit())
