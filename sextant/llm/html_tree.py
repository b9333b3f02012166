"""Main text of web pages by sum-product message passing on the page's tree.

A page becomes a tree of block elements with runs of text as leaves. Each node is content
or not. A node's potential comes from its tag, its class, id and role words and, for
leaves, from length, share of links and final punctuation; a potential between parent and
child makes neighbours agree. Messages go up from the leaves and down from the root, level
by level for many pages at once, and give every leaf the probability that it is content.

The potentials are smoothed counts over labelled pages: built-in layouts whose blocks are
labelled as they are made, and a bounded sample of about ``SAMPLE`` pages of the table
that mark their article, labelled by those marks. The fit is all that the sample bounds.

Cases: a null or empty page has no text; tags that are never closed end with what holds
them, tags cut off by the end of the page go; unknown character references stay as they
are; repeated rows give equal rows; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: how tags behave, and words that tell what a block is for ---
RAW = frozenset("script style textarea title noframes iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var br wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TELLING = tuple(
    "article main nav header footer aside form button select option label dialog menu noscript svg p h1 h2 h3 h4 h5 h6 blockquote pre "
    "figcaption".split()
)
AGAINST = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar widget nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer copyright comment comments disqus reply replies respond discussion cookie "
    "cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations pagination pager tags toolbar complementary contentinfo form".split()
)
FOR = frozenset("article articlebody content entry post story main body text blog page single maincontent".split())

# --- parameters ---
SAMPLE = 200
SEED = 5
BUILT_IN = 240
SMOOTHING = 1.0
#: Nodes worked on at a time.
CHUNK_NODES = 200_000

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>?)")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"data-label=\"([01])\"")
WORD = re.compile(r"[a-z]+")
N_KINDS = len(TELLING) + 2  # other element, leaf
LEAF = len(TELLING) + 1
KINDS = {t: k for k, t in enumerate(TELLING)}
N_LEAF = 4 * 3 * 2


class Tree:
    """Nodes of several pages, parents before children."""

    def __init__(self):
        self.parent, self.depth, self.kind, self.hint, self.form, self.text, self.label = [], [], [], [], [], [], []
        self.page = []

    def add(self, page: int, parent: int, kind: int, hint: int = 0, form: int = -1, text: str = "", label: int = -1) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.hint.append(hint)
        self.form.append(form)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1

    def parse(self, page: int, source: str) -> None:
        root = self.add(page, -1, len(TELLING))
        stack, open_tags = [("", root, -1)], {}
        run: list[str] = []  # the text run that is open, its characters in links
        linked = link = 0
        at, size = 0, len(source)
        find = source.find

        def flush():
            nonlocal linked
            if run:
                text = "".join(run)
                if "&" in text:
                    text = html.unescape(text)
                text = " ".join(text.split())
                if text:
                    n = len(text)
                    length = 0 if n < 15 else 1 if n < 60 else 2 if n < 200 else 3
                    share = linked / n
                    form = (length * 3 + (0 if share < 0.3 else 1 if share < 0.8 else 2)) * 2 + (text[-1] in ".!?。！？:\"”»")
                    self.add(page, stack[-1][1], LEAF, 0, form, text, stack[-1][2])
                run.clear()
            linked = 0

        def pop():
            tag = stack.pop()[0]
            open_tags[tag] -= 1

        while at < size:
            next_tag = find("<", at)
            if next_tag < 0:
                next_tag = size
            if next_tag > at:
                run.append(source[at:next_tag])
                if link:
                    linked += next_tag - at
            if next_tag == size:
                break
            m = TAG.match(source, next_tag)
            if m is None:
                c = source[next_tag + 1 : next_tag + 2]
                if c == "!" or c == "?" or c == "/":
                    if source.startswith("<!--", next_tag):
                        end = find("-->", next_tag + 4)
                        at = size if end < 0 else end + 3
                    else:
                        end = find(">", next_tag)
                        at = size if end < 0 else end + 1
                else:
                    run.append("<")
                    at = next_tag + 1
                continue
            closing, tag, attributes, ended = m.groups()
            at = m.end()
            if not ended:
                break  # cut off
            tag = tag.lower()
            if closing:
                if tag == "a":
                    link = 0
                if tag in INLINE:
                    continue
                flush()
                if open_tags.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag in RAW:
                flush()
                end = re.compile("</" + re.escape(tag) + r"(?=[\s/>])", re.I).search(source, at)
                if end is None:
                    break
                close = find(">", end.end())
                at = size if close < 0 else close + 1
                continue
            if tag in INLINE:
                if tag == "a":
                    link = 1
                elif tag == "br" or tag == "img" or tag == "wbr":
                    run.append(" " if tag == "br" else "")
                continue
            flush()
            link = 0
            if tag in CLOSES_P and open_tags.get("p"):
                while stack[-1][0] != "p":
                    pop()
                pop()
            same = CLOSES_SAME.get(tag)
            if same and stack[-1][0] in same:
                pop()
            if tag in VOID:
                continue
            hint = 0
            label = stack[-1][2]
            if attributes:
                words = set()
                for named in NAMED.finditer(attributes):
                    value = named[1] or named[2] or named[3] or ""
                    words.update(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
                hint = 2 if words & AGAINST else 1 if words & FOR else 0
                marked = LABEL.search(attributes)
                label = int(marked[1]) if marked else label
            node = self.add(page, stack[-1][1], KINDS.get(tag, len(TELLING)), hint, -1, "", label)
            if not attributes.endswith("/") or tag != "svg":
                stack.append((tag, node, label))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        flush()

    def arrays(self):
        return tuple(np.array(x, np.int64) for x in (self.parent, self.depth, self.kind, self.hint, self.form))


def fit(trees: list[Tree]) -> dict[str, np.ndarray]:
    """Log potentials from labelled leaves; an element is what most of its text is."""
    tag, hint, form = (np.full((2, n), SMOOTHING) for n in (N_KINDS, 3, N_LEAF))
    pair = np.full((2, 2, 2), SMOOTHING)  # by child being a leaf, parent, child
    for tree in trees:
        parent, _, kind, hints, forms = tree.arrays()
        weight = np.zeros((len(parent), 2))
        for k, text in enumerate(tree.text):
            if kind[k] == LEAF and tree.label[k] >= 0:
                weight[k, tree.label[k]] = len(text)
        for k in range(len(parent) - 1, 0, -1):
            if parent[k] >= 0:
                weight[parent[k]] += weight[k]
        known = weight.sum(axis=1) > 0
        y = (weight[:, 1] > weight[:, 0]).astype(int)
        for k in np.flatnonzero(known):
            tag[y[k], kind[k]] += 1
            if kind[k] == LEAF:
                form[y[k], forms[k]] += 1
            else:
                hint[y[k], hints[k]] += 1
            if parent[k] >= 0 and parent[parent[k]] >= 0:
                pair[int(kind[k] == LEAF), y[parent[k]], y[k]] += 1
    logs = {"tag": tag, "hint": hint, "form": form}
    out = {k: np.log(v / v.sum(axis=1, keepdims=True)) for k, v in logs.items()}
    out["tag"][:, len(TELLING) :] = 0.0  # plain containers and leaves tell nothing by their tag
    out["form"] *= 0.3  # length and links of a run are weak signs beside its place
    out["pair"] = np.log(pair / pair.sum(axis=2, keepdims=True))
    return out


def content(tree: Tree, model: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of each node that it is content."""
    parent, depth, kind, hint, form = tree.arrays()
    own = model["tag"][:, kind].T + model["hint"][:, hint].T * (kind != LEAF)[:, None]
    leaf = kind == LEAF
    own[leaf] += model["form"][:, form[leaf]].T
    pair = model["pair"][leaf.astype(int)]  # node, parent's state, own state
    pair[depth == 1] = math.log(0.5)  # the root has no say
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    below, up = own.copy(), np.zeros_like(own)
    for d in range(depth.max(), 0, -1):
        nodes = order[edges[d] : edges[d + 1]]
        message = np.logaddexp(pair[nodes, :, 0] + below[nodes, :1], pair[nodes, :, 1] + below[nodes, 1:])
        up[nodes] = message
        np.add.at(below, parent[nodes], message)
    belief = below.copy()
    for d in range(1, depth.max() + 1):
        nodes = order[edges[d] : edges[d + 1]]
        rest = belief[parent[nodes]] - up[nodes]
        rest -= rest.max(axis=1, keepdims=True)
        belief[nodes] += np.logaddexp(pair[nodes, 0] + rest[:, :1], pair[nodes, 1] + rest[:, 1:])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


# --- labelled pages ---


def built_in_pages(n: int = BUILT_IN) -> Iterator[str]:
    """Pages of common layouts whose blocks carry their label."""
    draw = random.Random(SEED)

    def words(low: int, high: int) -> str:
        return " ".join("".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(low, high)))

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(draw.randint(low, high)))

    def paragraph() -> str:
        return f"<p>{words(*draw.choice(((1, 3), (5, 15), (20, 90))))}.</p>"

    def body() -> str:
        extra = (
            lambda: f"<ul>{''.join(f'<li>{words(1, 12)}</li>' for _ in range(draw.randint(2, 8)))}</ul>",
            lambda: f"<ol>{''.join(f'<li>{words(3, 20)}.</li>' for _ in range(draw.randint(2, 6)))}</ol>",
            lambda: f"<blockquote>{words(8, 30)}.</blockquote>",
            lambda: f"<pre>{words(5, 20)}</pre>",
            lambda: f"<h{(k := draw.randint(2, 6))}>{words(1, 7)}</h{k}>",
            lambda: f"<table>{''.join(f'<tr><td>{words(1, 4)}</td><td>{words(1, 3)}</td></tr>' for _ in range(draw.randint(1, 6)))}</table>",
            lambda: f"<figure><figcaption>{words(2, 12)}</figcaption></figure>",
            lambda: f"<section><h3>{words(1, 5)}</h3>{paragraph()}</section>",
            lambda: f'<p>{words(5, 20)} <a href="#">{words(1, 3)}</a> {words(5, 20)}.</p>',
            lambda: f"<div>{words(10, 40)}.</div>",
        )
        parts = [f"<h1>{words(3, 9)}</h1>"]
        for _ in range(draw.randint(2, 12)):
            parts.append(paragraph() if draw.random() < 0.6 else draw.choice(extra)())
            if draw.random() < 0.08:
                parts.append(against())
        return "".join(parts)

    def against() -> str:
        name = draw.choice(sorted(AGAINST))
        tag = draw.choice(("div", "div", "section", "ul", "aside"))
        inner = links(2, 6) if tag == "ul" else draw.choice((words(3, 25) + ".", paragraph(), f"<p>{words(3, 20)}</p>", f"<ul>{links(2, 6)}</ul>"))
        return f'<{tag} class="{name}" data-label="0">{inner}</{tag}>'

    def marked() -> str:
        tag = draw.choice(("nav", "header", "footer", "aside", "form"))
        inner = {
            "nav": f"<ul>{links(3, 9)}</ul>",
            "header": f'<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>' if draw.random() < 0.3 else f'<a href="#">{words(1, 3)}</a> {words(1, 6)}',
            "footer": f"{words(3, 15)}.",
            "aside": f"<h3>{words(1, 4)}</h3><p>{words(4, 30)}.</p>",
            "form": f"<label>{words(1, 4)}</label><button>{words(1, 2)}</button>",
        }[tag]
        return f'<{tag} data-label="0">{inner}</{tag}>'

    def comments() -> str:
        each = "".join(f'<{t} class="comment"><p>{words(4, 50)}.</p></{t}>' for t in draw.choices(("div", "li", "article"), k=draw.randint(1, 5)))
        return f'<section class="comments" data-label="0"><h3>{words(1, 3)}</h3>{each}</section>'

    for _ in range(n):
        opening, closing = draw.choice(
            (
                ("<article", "article"), ("<article", "article"), ("<main", "main"), ('<div class="content"', "div"), ('<div id="main"', "div"),
                ('<div class="post-body"', "div"), ('<section class="entry"', "section"), ("<div", "div"),
            )
        )
        article = f'{opening} data-label="1">{body()}</{closing}>'
        before = "".join(draw.choice((marked, marked, against))() for _ in range(draw.randint(1, 4)))
        after = "".join(draw.choice((marked, against, comments))() for _ in range(draw.randint(1, 4)))
        page = before + (f'<div class="wrapper">{article}{against()}</div>' if draw.random() < 0.3 else article) + after
        yield f"<html><body>{page}</body></html>"


def mark_by_article(source: str) -> str | None:
    """The page with labels where it marks its own parts; none if it marks no article."""
    if not re.search(r"<article[\s>]", source, re.I):
        return None
    out = re.sub(r"<(nav|header|footer|aside|form)(?=[\s>])", r'<\1 data-label="0"', source, flags=re.I)
    out = re.sub(r"<(\w+)(?=[^>]*class=\"(?:ad|ads|comments?|sidebar)\")", r'<\1 data-label="0"', out)
    return re.sub(r"<article(?=[\s>])(?![^>]*data-label)", '<article data-label="1"', out, flags=re.I)


def train(pages: DataFrame, size: int = SAMPLE) -> dict[str, np.ndarray]:
    """Potentials from the built-in layouts and a bounded sample of pages that mark their article."""
    total = pages.count()
    draw = F.pmod(F.xxhash64("page_id", F.lit(SEED)), F.lit(1 << 20))
    chosen = pages.filter(F.col("html").isNotNull() & (draw < min(1.0, size / max(total, 1)) * (1 << 20)))
    # its size is bounded by the parameter
    sources = [r["html"] for r in chosen.select("html").limit(2 * size).collect()]
    trees = []
    for k, source in enumerate([*built_in_pages(), *filter(None, map(mark_by_article, sources))]):
        tree = Tree()
        tree.parse(k, source)
        trees.append(tree)
    return fit(trees)


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None, limit: float = 0.5) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    model = model or train(pages)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, tree, texts = 0, Tree(), []
            column = batch.column("html")
            for k in range(len(column)):
                tree.parse(k - first, column[k].as_py() or "")
                if len(tree.parent) >= CHUNK_NODES or k == len(column) - 1:
                    texts += main_texts(tree, k + 1 - first, model, limit)
                    first, tree = k + 1, Tree()
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def main_texts(tree: Tree, pages: int, model: dict[str, np.ndarray], limit: float) -> list[str]:
    taken: list[list[str]] = [[] for _ in range(pages)]
    likely = content(tree, model)
    for k in np.flatnonzero((np.array(tree.kind) == LEAF) & (likely > limit)).tolist():
        taken[tree.page[k]].append(tree.text[k])
    return ["\n".join(t) for t in taken]
