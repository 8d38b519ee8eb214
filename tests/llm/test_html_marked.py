"""Extraction from pages that were marked by hand, hostile pages, and tables without article elements."""

import resource
import time

import pytest

from rowproof.llm import htmlcrf
from rowproof.llm.htmlblocks import leaf_blocks

# Pages with their main text as a reader marked it: none relies on article or main elements alone.
MARKED = {
    "blog": (
        """<html><head><title>My blog</title><style>p{}</style></head><body><div id="header"><a href="/">My blog</a></div>
        <div id="menu"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/rss">Feed</a></li></ul></div>
        <div class="post"><h2>Mending a wooden boat</h2><p>Last spring we found a rowing boat behind the shed. Its planks had dried, and the seams let daylight through.</p>
        <p>First we soaked the hull for a week. Then we drove <a href="/oakum">oakum</a> into the seams, and painted it twice.</p>
        <blockquote><p>A boat is a hole in the water that you pour paint into, as my uncle says.</p></blockquote></div>
        <div class="sidebar"><p>Popular posts</p><p><a href="/1">Ten knots to know</a></p></div>
        <div class="comments"><p>Lovely work, well done! I would have used cotton instead of oakum.</p></div>
        <div class="footer"><p>&copy; 2019 My blog</p></div></body></html>""",
        ["Mending a wooden boat", "Last spring we found a rowing boat behind the shed. Its planks had dried, and the seams let daylight through.",
         "First we soaked the hull for a week. Then we drove oakum into the seams, and painted it twice.", "A boat is a hole in the water that you pour paint into, as my uncle says."],
    ),
    "news": (
        """<!doctype html><body><header class=masthead><p>The Evening Post</p></header><nav><a href=/w>World</a><a href=/s>Sport</a></nav>
        <main><article><h1>Bridge opens after ten years</h1><aside class=related><p><a href=/b>More on bridges</a></p></aside><p>The bridge over the Lune was opened on Monday. It cost twice what was planned, the council said.</p>
        <ul><li>It is 900 metres long and carries four lanes of traffic.</li><li>Cyclists have a path of their own, on the northern side.</li></ul></article></main>
        <aside><p>Subscribe to our letter</p></aside><footer><p>&copy; The Evening Post</p><p>Contact us</p></footer>""",
        ["Bridge opens after ten years", "The bridge over the Lune was opened on Monday. It cost twice what was planned, the council said.",
         "It is 900 metres long and carries four lanes of traffic.", "Cyclists have a path of their own, on the northern side."],
    ),
    "shop advice": (
        """<body><div class="cookie notice"><p>We use cookies to make this site better.</p></div><ul class="navbar"><li><a href=#>Shop</a><li><a href=#>Help</a></ul>
        <div class="ad"><p>Half price on all kettles</p></div><div class="content"><h1>How to choose a kettle</h1><p>Think of how many cups you make at a time. A litre is enough for three people.
        <br>A kettle of steel lasts longer, but it is louder than one of glass.</p></div><form class="newsletter"><p>Join our letter</p><input><button>Go</button></form><div class="footer"><p>Terms</p></div></body>""",
        ["How to choose a kettle", "Think of how many cups you make at a time. A litre is enough for three people. A kettle of steel lasts longer, but it is louder than one of glass."],
    ),
}


def test_pages_marked_by_hand(spark):
    model = htmlcrf.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for name, (page, want) in MARKED.items():
        assert htmlcrf.main_text(page, model).split("\n") == want, name


# Hostile pages of a megabyte: what each repeats would cost a scanner that goes back the square of its length.
HOSTILE = {
    "open tags": "<a " * 350_000, "nested": "<div>x " * 150_000, "formatting": "<b>" * 150_000 + "<p>x</p>" * 75_000,
    "stray ends": "<div>" * 100_000 + "</section>" * 80_000, "quotes": "<a \">\" " * 150_000, "half quotes": "<a href='> " * 80_000 + ">",
    "class words": "".join(f"<div class=w{i:06d}{'abcdefghij'[i % 10] * (i % 17)}>x " for i in range(40_000)),
    "declarations": "<!" * 500_000, "items": "<li>x" * 200_000, "drawings": "<svg>" * 200_000, "reference": "&#" + "9" * 1_000_000, "text": "plain words and no tags. " * 40_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    model = htmlcrf.train_field(htmlcrf.labelled_pages([htmlcrf.SEED_PAGE]))
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    htmlcrf.main_text(HOSTILE[name], model)
    assert time.process_time() - start < 10  # a second or two on an idle machine; minutes and more if quadratic
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_broken_markup_keeps_its_text():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p class=don't>one</p><p title='x>y'>two</p>") == ["one", "two"]
    assert texts("<a href='x>one</a> two") == ["one two"]
    assert texts("<p>one<!-- never closed <p>two") == ["one"]
    assert texts("<p>a <svg><path d=m><p>b</p>") == ["a", "b"]
    assert texts("<p>one</ p>two</>three <b") == ["onetwothree"]
    assert texts("&#65;&#00000000000066;&#99999999999999999999;") == ["AB�"]


def test_a_table_without_article_elements_gives_its_texts(spark):
    side = "<div class=menu><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></div>"
    rows = [(i, "u", f"<body>{side}<div class=z{i % 7}><p>The lake number {i} is deep, and its water is cold all year. Few people swim there.</p><p>In winter it freezes over, and they skate.</p></div><div class=footer><p>&copy; us</p></div>") for i in range(40)]
    rows += [(40, "u", None), (41, "u", ""), (0, "u", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as cutter")
    got = [(r.page_id, r.text) for r in htmlcrf.extracted(pages).collect()]
    assert len(got) == 43
    for i, text in got:
        want = f"The lake number {i} is deep, and its water is cold all year. Few people swim there.\nIn winter it freezes over, and they skate."
        assert text == (want if i < 40 else "")
