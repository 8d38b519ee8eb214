"""Copies of a page are left to the SimHash stage, which keeps one of them with its text."""

import corpus_pipeline as pipeline
from rowproof.llm import linededup


def test_a_large_copy_group_keeps_its_lines(spark):
    copied = "\n".join(f"line {i} of a page that was copied many times over" for i in range(12))
    texts = [copied] * 30 + [f"menu\nown words of page {i} and more of them {i * i}" for i in range(40)] + [None] * 9
    rows = [(i, t, "en", host, len(t or "")) for host, at in (("a", 0), (None, 100)) for i, t in enumerate(texts, at)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = pipeline.drop_boilerplate(spark, docs, "").cache()
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got == {i: t.removeprefix("menu\n") if t else t for i, t, *_ in rows}
    kept = pipeline.drop_near_copies(spark, clean.where("text is not null"), "").collect()
    assert [r.text for r in kept].count(copied) == 1
    counted = {r.doc_id: r.text for r in linededup.cleaned(docs, "source", "text", each_copy=True).collect()}
    assert counted[0] == "" and counted[30] == got[30]


def test_copies_count_once_in_the_denominator(spark):
    texts = ["common\n" + str(i) for i in range(5)] + [f"own {i}" for i in range(5)] + ["own 0"] * 20
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    dropped = lambda **k: sum(r.n_dropped for r in linededup.cleaned(docs, "source", "text", ratio=0.4, **k).collect())
    assert dropped() == 5 and dropped(each_copy=True) == 21  # 5 of 10 texts; else 5 of 30 rows, and 21 of 30
