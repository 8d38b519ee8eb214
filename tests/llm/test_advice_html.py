"""Pages with omitted tags and foreign elements keep their text."""

from rowproof.llm import htmlcrf


def texts(page):
    return [b.text for b in htmlcrf.leaf_blocks(page)]


def test_a_head_without_end_tag_ends_at_the_body():
    assert texts("<html><head><title>t</title><body><article><p>a</article>") == ["a"]
    assert texts("<head><meta charset=x><title>t</title><article><p>a<p>b</article>") == ["a", "b"]
    assert texts("<head><title>t</title>\n plain <b>text</b>") == ["plain text"]
    assert texts("<head><title>t</title><script>x</script><template><p>no</template><noscript><p>no</noscript></head><p>a") == ["a"]


def test_foreign_elements():
    assert texts('<article><p>a <svg width="1"/> b<p>c</article>') == ["a b", "c"]
    assert texts("<article><p>a<svg/>b<svg><title/><path d='m'/><text>no</text></svg>c<svg hidden/>d</article>") == ["abcd"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn><annotation>x=1</annotation></math> holds") == ["so x=1 holds"]
    assert texts("<p>a<div/>b") == ["a", "b"]


PROSE = "<p>The river %d is long and its banks are green. People live there, and they fish.</p><p>More is said in this second part. It goes on.</p>"


def page(i, tag, more=""):
    return f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><{tag} class=content>{PROSE % i}{more}</{tag}><footer><p>&copy; us</p></footer></body></html>"


def held(spark, htmls):
    rows = [(i, "u", h) for i, h in enumerate(htmls)]
    got = htmlcrf.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_few_long_or_no_labelled_pages(spark):
    rare = held(spark, [page(i, "div") for i in range(2000)] + [page(2000, "article"), page(2001, "main")])
    assert all(f"The river {i} " in t for i, t in rare.items())
    big = "".join(PROSE % i for i in range(900))
    assert len(big) > 100_000
    assert all(f"The river {i} " in t and "Home" not in t for i, t in held(spark, [page(i, "article", big) for i in range(3)]).items())
    assert all(f"The river {i} " in t for i, t in held(spark, [page(i, "div") for i in range(20)]).items())


def test_copies_are_drawn_as_one_page(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(htmlcrf, "labelled_pages", lambda pages: fitted.append(pages) or [([["a"]], [1])])
    htmls = [page(0, "article")] * 500 + [page(i, "article") for i in range(1, 20)]
    htmlcrf.train(spark.createDataFrame([(h,) for h in htmls], "html string"))
    assert sorted(fitted[0]) == sorted(set(htmls))
