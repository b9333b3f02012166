"""Main-text extraction: message passing against enumeration, held-out and hand-written pages."""

import html
import itertools
import re

import numpy as np
import pytest

from sextant.llm import html_tree


@pytest.fixture(scope="module")
def model():
    trees = []
    for k, page in enumerate(html_tree.built_in_pages()):
        tree = html_tree.Tree()
        tree.parse(k, page)
        trees.append(tree)
    return html_tree.fit(trees)


def texts_of(pages, model):
    tree = html_tree.Tree()
    for k, page in enumerate(pages):
        tree.parse(k, page)
    return html_tree.main_texts(tree, len(pages), model, 0.5)


def test_marginals_equal_enumeration(model):
    tree = html_tree.Tree()
    tree.parse(0, '<body><nav><li><a>x</a></li></nav><div class="post"><p>A text.</p><p>more</p></div></body>')
    parent, depth, kind, hint, form = tree.arrays()
    n, total = len(parent), np.zeros((len(parent), 2))
    for states in itertools.product((0, 1), repeat=n):
        score = 0.0
        for k, y in enumerate(states):
            leaf = kind[k] == html_tree.LEAF
            score += model["tag"][y, kind[k]] + (model["form"][y, form[k]] if leaf else model["hint"][y, hint[k]])
            if parent[k] >= 0:
                score += np.log(0.5) if depth[k] == 1 else model["pair"][int(leaf), states[parent[k]], y]
        for k, y in enumerate(states):
            total[k, y] += np.exp(score)
    assert np.allclose(html_tree.content(tree, model), total[:, 1] / total.sum(axis=1))


def test_hand_written_pages(model):
    pages = [
        '<html><head><title>x</title></head><body><header><a href="/">Site</a></header><div class="cookie-notice">We use cookies.</div>'
        "<nav><ul><li><a>Home</a></li></ul></nav><main><article><h1>T</h1><p>Hello &eacute; <b>w</b>orld.</p><div class=\"ad\">Buy</div>"
        "<ul><li>one thing</li><li>two</li></ul><p>Bye.</article><section class=\"comments\"><article class=\"comment\"><p>Nice long "
        'comment here, with text.</p></article></section></main><aside class="sidebar"><p>About us.</p></aside><form><button>Go</button>'
        "</form><footer>c</footer></body>",
        '<body><div id="wrap"><div class="menu"><a href=1>a</a> <a href=2>b</a></div><div class="content"><p>Short.</p><p>Some longer '
        'paragraph of text that is the content of the page.</p></div><div class="sidebar"><p>Other text.</p></div></div>',
        "",
        "<p>a < b &amp c &am",
        "<div><p>Only\n text&nbsp;here.</p><p>More.</p></div><script>if(a<b){\"</p>\"}</script><a hr",
    ]
    assert texts_of(pages, model) == [
        "T\nHello é world.\none thing\ntwo\nBye.",
        "Short.\nSome longer paragraph of text that is the content of the page.",
        "",
        "a < b & c &am",
        "Only text here.\nMore.",
    ]


def plain_text(page):
    inside = re.sub(r"<[^>]*$", "", page[page.index("<article>") + 9 :].split("</article>")[0])
    parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", p.replace("<b>", ""))).split()) for p in re.split("</?(?:p|h1)>", inside))
    return "\n".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_tree.extract(pages).collect()}
    for page in pages.collect():
        row = got[page["page_id"]]
        assert row["text"] == plain_text(page["html"]) and row["n_chars"] == len(row["text"]) and row["url"] == page["url"]


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "deep text" + "<p>" * 50
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "v", "<p>x.</p>", 3), (None, "v", "<p>x.</p>", 3), (5, "w", deep, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_tree.extract(pages).collect()
    assert len(got) == 5 and {r["page_id"]: r["text"] for r in got}[1] == "" and {r["page_id"]: r["text"] for r in got}[2] == ""
    assert html_tree.extract(pages.limit(0)).collect() == []
