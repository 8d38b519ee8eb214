"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (htmlblocks.py), the text between the borders of block elements. Features of
a block are its ancestors' tags, the words of their class, id and role attributes, and measures of its text (length,
share of links, stops, place in the page). The chain has two states, main and other; weights are trained by gradient
steps on the log-likelihood (forward-backward) and pages are decoded by Viterbi. Time and memory are linear in a page.

Labelled pages for training come from a bounded sample (`train_pages`, SAMPLE_BYTES and SAMPLE_BLOCKS, by hash; MOST_ANCESTRY ancestor
features for each block) of the distinct pages with an article or main element. Blocks inside
article or main elements that are not in a nested menu, header, footer, aside or form are labelled main, all others not. If no
page has such an element, any pages are drawn and the run of blocks with most text is main; if that labels nothing either, the field is
fitted on a page of ours. As those elements give the label away, each page is also trained on in other clothes: its blocks are set in fixed
layouts of generic elements (div, section) whose class words tell the parts, with sidebars, notices, adverts, forms and
reader comments added from the page's own side texts, so that the field learns class words and text measures as well.

Defined cases: a null or empty html gives the empty text, an empty table no rows; script, style, template, head and comments never give text, nor do svg,
iframe and textarea, the fallbacks in noscript and object, and the annotations of a formula, whose own text stays; a head ends where
its first other element or text begins, a foreign element (svg, math and what they hold) at its "/>", an open drawing or formula at the
next block element; an unclosed element ends where its parent does, or where the HTML rules close it (p, li, tr, td, option); what follows an
unclosed comment or tag at the end of the page is part of it; character references are decoded, also those without a semicolon that HTML
allows; `br` counts as white space; ids and urls are carried as they are; equal pages give equal texts, repeated rows a row each; extra columns
are ignored; a page of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.llm.htmlblocks import Block, Node, chain, leaf_blocks

TRAIN_PAGES = 300
#: What the sample holds at most; blocks in one training chain; words that a block costs a run of text.
SAMPLE_BYTES, SAMPLE_BLOCKS, CHAIN_BLOCKS, RUN_COST = 8 << 20, 60_000, 1000, 8
ROUNDS, RATE, RIDGE = 150, 0.5, 1e-4

#: Ancestor features of a block in training, the innermost first.
MOST_ANCESTRY = 64


def own_features(b: Block, i: int, n: int) -> list[str]:
    """The features of a block apart from its ancestry: i is its place among n blocks."""
    f = ["leaf:" + b.node.leaf, f"words:{min(b.text.count(' ') + 1, 200).bit_length()}", f"links:{4 * b.linked // max(len(b.text), 1)}"]
    f.append(f"stops:{min(sum(b.text.count(c) for c in '.!?'), 3)}")
    if "©" in b.text:
        f.append("has:copyright")
    f.append("place:first" if i == 0 else "place:last" if i == n - 1 else "place:inner")
    f.append("bias")
    return f


def block_features(blocks: list[Block]) -> list[list[str]]:
    """The feature names of each block, for training."""
    return [b.node.features(MOST_ANCESTRY) + own_features(b, i, len(blocks)) for i, b in enumerate(blocks)]


@dataclass
class Field:
    """Weights of both states by feature, and of the steps between states."""

    weights: dict[str, tuple[float, float]]
    steps: np.ndarray  # [from, to]

    def unaries(self, blocks: list[Block]) -> list[tuple[float, float]]:
        """The weights of both states for each block; a node's sum is made once, from that of the node around it."""
        get, none = self.weights.get, (0.0, 0.0)

        def summed(features: Iterable[str], at: tuple[float, float]) -> tuple[float, float]:
            u, v = at
            for f in features:
                p, q = get(f, none)
                u, v = u + p, v + q
            return u, v

        known: dict[int, tuple[float, float]] = {}
        out = []
        for i, b in enumerate(blocks):
            open_nodes, node = [], b.node
            while node is not None and id(node) not in known:
                open_nodes.append(node)
                node = node.parent
            at = none if node is None else known[id(node)]
            for node in reversed(open_nodes):
                at = known[id(node)] = summed(node.added, at)
            out.append(summed(own_features(b, i, len(blocks)), at))
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest states of blocks given by all their features."""
        none = (0.0, 0.0)
        found = [[self.weights.get(f, none) for f in row] for row in rows]
        return self.viterbi([(sum(p for p, _ in r), sum(q for _, q in r)) for r in found])

    def viterbi(self, unaries: list[tuple[float, float]]) -> list[int]:
        """The likeliest states; 1 is main."""
        if not unaries:
            return []
        (aa, ab), (ba, bb) = self.steps.tolist()
        back: list[tuple[int, int]] = []
        x, y = unaries[0]
        for u, v in unaries[1:]:
            x0, x1, y0, y1 = x + aa, y + ba, x + ab, y + bb
            back.append((int(x1 > x0), int(y1 > y0)))
            x, y = max(x0, x1) + u, max(y0, y1) + v
        state = int(y > x)
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]


def train_field(pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """Maximise the mean log-likelihood of labelled pages: forward-backward over all pages side by side, AdaGrad steps."""
    pages = [p for p in pages if p[0]]
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    size, longest = len(pages), max((len(rows) for rows, _ in pages), default=0)
    theta, steps = np.zeros((len(names), 2)), np.zeros((2, 2))
    if not pages:
        return Field({}, steps)
    page_of = np.concatenate([np.full(len(rows), i) for i, (rows, _) in enumerate(pages)])
    place = np.concatenate([np.arange(len(rows)) for rows, _ in pages])
    block = np.repeat(np.arange(len(page_of)), [len(row) for rows, _ in pages for row in rows])
    column = np.array([names[f] for rows, _ in pages for row in rows for f in row], np.int64)
    gold = np.array([s for _, states in pages for s in states])
    there = np.zeros((size, longest), bool)
    there[page_of, place] = True
    gold_steps = np.zeros((2, 2))
    follows = np.flatnonzero(page_of[1:] == page_of[:-1])
    np.add.at(gold_steps, (gold[follows], gold[follows + 1]), 1)
    gold_theta = np.stack([np.bincount(column, (gold == s)[block], len(names)) for s in (0, 1)], axis=1)
    seen_t, seen_s = np.full_like(theta, 1e-8), np.full_like(steps, 1e-8)
    for _ in range(rounds):
        score = np.stack([np.bincount(block, theta[column, s], len(page_of)) for s in (0, 1)], axis=1)
        unary = np.zeros((size, longest, 2))
        unary[page_of, place] = score
        forward, backward = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1]) + unary[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = backward[:, t + 1] + unary[:, t + 1]
            new = np.logaddexp(steps[:, 0] + ahead[:, :1], steps[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        marginal = np.exp(forward + backward - z[:, None, None])[page_of, place]
        pair = np.exp(forward[:, :-1, :, None] + steps[None, None] + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])
        want_steps = (pair * there[:, 1:, None, None]).sum((0, 1))
        want = np.stack([np.bincount(column, marginal[block, s], len(names)) for s in (0, 1)], axis=1)
        g_t, g_s = (gold_theta - want) / size - ridge * theta, (gold_steps - want_steps) / size - ridge * steps
        seen_t += g_t**2
        seen_s += g_s**2
        theta, steps = theta + rate * g_t / np.sqrt(seen_t), steps + rate * g_s / np.sqrt(seen_s)
    return Field({f: (float(theta[i, 0]), float(theta[i, 1])) for f, i in names.items()}, steps)


#: Class words of the layouts that labelled pages are also set in; the first of each part is generic.
LAYOUTS = (
    {"main": ("div", "content"), "menu": ("div", "menu"), "head": ("div", "header"), "side": ("div", "sidebar"), "ad": ("div", "ad"), "notice": ("div", "cookie notice"), "form": ("form", "search"), "comment": ("div", "comments"), "foot": ("div", "footer")},
    {"main": ("div", "post entry body"), "menu": ("ul", "nav navbar"), "head": ("header", "site header masthead"), "side": ("aside", "widget related"), "ad": ("div", "advert sponsored promo"), "notice": ("div", "banner consent alert"), "form": ("form", "newsletter subscribe login"), "comment": ("section", "comment reply discussion"), "foot": ("footer", "site footer copyright")},
    {"main": ("main", ""), "menu": ("nav", "breadcrumb"), "head": ("header", ""), "side": ("aside", ""), "ad": ("aside", "ads"), "notice": ("dialog", "popup notice"), "form": ("form", ""), "comment": ("div", "responses comment list"), "foot": ("footer", "")},
    {"main": ("article", "story"), "menu": ("nav", ""), "head": ("div", "topbar"), "side": ("div", "side rail recommended share social"), "ad": ("div", "advertisement"), "notice": ("p", "notice gdpr"), "form": ("form", "signup"), "comment": ("div", "comment thread"), "foot": ("div", "bottom legal")},
)


def weak_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks inside an article or main element and in no side element or side class within it."""
    return [int(b.node.inside and not b.node.worded) for b in blocks]


def run_labels(blocks: list[Block]) -> list[int]:
    """For pages without such elements: 1 for the blocks of the run that holds most text, outside side elements and classes.

    The run is that of the largest sum of words outside links, less RUN_COST for each block, and goes on while its neighbours stand in
    the same elements as its own blocks.
    """
    aside = [b.node.sided or b.node.worded for b in blocks]
    gains = [-RUN_COST if a else (b.text.count(" ") + 1) * (1 - b.linked / max(len(b.text), 1)) - RUN_COST for a, b in zip(aside, blocks)]
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, g in enumerate(gains):
        if total <= 0:
            total, start = 0.0, i
        total += g
        if total > best:
            best, span = total, (start, i + 1)
    first, end = span
    within = {id(b.node.parent) for b in blocks[first:end]}
    while 0 < first < end and id(blocks[first - 1].node.parent) in within:
        first -= 1
    while first < end < len(blocks) and id(blocks[end].node.parent) in within:
        end += 1
    return [int(first <= i < end and not a) for i, a in enumerate(aside)]


def _inside(around: Node, *tags: str) -> Node:
    """The ancestry of a block within further elements."""
    for tag in tags:
        around = around.under(tag, (), (f"in:{tag}",) if f"in:{tag}" not in around.features(MOST_ANCESTRY) else ())
    return around


def _setting(b: Block, i: int, heading: str) -> tuple[str, ...]:
    """The elements that the i-th block of an article is set in: headings, and now and then a list, a quotation or a table."""
    if re.fullmatch("h[1-6]", b.node.leaf):
        return (heading,)
    return ("ul", "li") if i % 5 == 3 else ("blockquote", "p") if i % 7 == 5 else ("table", "tr", "td") if i % 11 == 8 else ("p",)


def dressed(blocks: list[Block], states: list[int], layout: dict[str, tuple[str, str]], heading: str = "h1") -> tuple[list[Block], list[int]]:
    """The page's article in another layout: side parts hold the page's own side texts, comments its own sentences."""
    main = [b for b, s in zip(blocks, states) if s]
    short = [b.text for b, s in zip(blocks, states) if not s] or ["Home"]
    prose = [s for b in main for s in re.split(r"(?<=[.!?]) ", b.text) if s]

    def around(kind: str) -> Node:
        return chain(["html", "body", layout[kind][0]], layout[kind][1].split())

    def part(kind: str, texts: list[str], leaf: str, linked: bool = False) -> list[tuple[Block, int]]:
        node = _inside(around(kind), leaf)
        return [(Block(t, node, len(t) if linked else 0), 0) for t in texts]

    rows = part("notice", short[-1:], "p") + part("head", short[:1], "div") + part("menu", short[:6], "li", True) + part("ad", short[-2:-1] or short[:1], "div")
    article = around("main")
    told = [(Block(b.text, _inside(article, *_setting(b, i, heading)), b.linked), 1) for i, b in enumerate(main)]
    # A box within the article: what others say, beside its first blocks.
    tag, words = layout["side"]
    box = _inside(article.under(tag, tuple(words.split()), tuple(f"name:{w}" for w in words.split())), "p")
    rows += told[:2] + [(Block(t, box, len(t)), 0) for t in short[-1:]] + told[2:]
    rows += part("ad", short[-1:], "div") + part("comment", prose[:3], "p") + part("form", short[:2], "div") + part("side", [*short[:2], *prose[3:5]], "p") + part("foot", short[-1:], "p")
    return [b for b, _ in rows], [s for _, s in rows]


def labelled_pages(pages: list[str], labels: Callable[[list[Block]], list[int]] = weak_labels) -> list[tuple[list[list[str]], list[int]]]:
    """Feature rows and states of each page as it is, and in each layout: pages until SAMPLE_BLOCKS blocks."""
    out, room = [], SAMPLE_BLOCKS
    for page in pages:
        blocks = leaf_blocks(page)[:room]
        states = labels(blocks)
        if not any(states):
            continue
        room -= len(blocks)
        out.append((block_features(blocks), states))
        for layout, heading in zip(LAYOUTS, ("h1", "h2", "h1", "h3")):
            other, marks = dressed(blocks, states, layout, heading)
            out.append((block_features(other), marks))
    return out


#: A page for tables without a labelled one.
SEED_PAGE = """<html><body><header><p>The Daily Site</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul></nav>
<article><h1>How rivers shape the land</h1><p>Water carries sand and stone from the hills to the plain. Over many years a valley grows wide, and its floor becomes level.</p>
<p>Where the river slows, it drops what it carries. Farmers have used that soil for thousands of years, and towns grew beside it.</p><p>Floods are part of this. They bring new soil, but they also take houses and roads away.</p></article>
<aside><p><a href="/r">Related stories</a></p><p>Buy our maps today</p></aside><footer><p>© All rights reserved</p></footer></body></html>"""


def drawn(pages: DataFrame, train_pages: int = TRAIN_PAGES, sample_bytes: int = SAMPLE_BYTES) -> list[str]:
    """Some `train_pages` distinct pages, on average, by hash, of `sample_bytes` in all; a longer one counts by its opening."""
    hashed = pages.select("html", F.xxhash64(F.lit("crf"), "html").alias("a"), F.xxhash64("html").alias("b"))
    heads = hashed.select("a", "b", F.octet_length("html").alias("bytes")).distinct()  # copies are one page
    n = heads.count()
    place = F.pmod("a", F.lit(1 << 30)) / float(1 << 30)
    most = 2 * train_pages
    rows = heads.where(place < min(1.0, train_pages / max(n, 1))).orderBy("b", "a").limit(most).collect() or heads.orderBy("b", "a").limit(1).collect()
    chosen, room = [], sample_bytes
    for r in rows:
        if r.bytes <= room:
            chosen.append(r)
            room -= r.bytes
    chosen = chosen or sorted(rows, key=lambda r: (r.bytes, r.b))[:1]
    if not chosen:
        return []
    opening = F.substring(F.first("html"), 1, sample_bytes)
    found = hashed.where(F.col("b").isin([r.b for r in chosen])).groupBy("a", "b").agg(opening.alias("html")).orderBy("b", "a")
    return [r.html for r in found.limit(most).collect()]


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fit on pages with an article or main element; if none is labelled, on any pages by their run of most text."""
    some = pages.where("html is not null")
    marked = some.where(F.rlike("html", F.lit(r"(?i)<(article|main)[\s/>]")))
    found = labelled_pages(drawn(marked, train_pages, sample_bytes))
    found = found or labelled_pages(drawn(some, train_pages, sample_bytes), run_labels) or labelled_pages([SEED_PAGE])
    return train_field([(f[i : i + CHAIN_BLOCKS], s[i : i + CHAIN_BLOCKS]) for f, s in found for i in range(0, len(f), CHAIN_BLOCKS)])


def main_text(page: str, model: Field) -> str:
    blocks = leaf_blocks(page)
    states = model.viterbi(model.unaries(blocks))
    return "\n".join(b.text for b, s in zip(blocks, states) if s)


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string")


def extracted(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
