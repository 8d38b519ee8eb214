"""License scans against a search of every block for every template."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rowproof.llm import licenses as lc

LOW = str.maketrans(lc.UPPER, lc.UPPER.lower())


def words(text):
    return re.findall(lc.WORD, text.translate(LOW))


def expected(doc_id, text, threshold=lc.THRESHOLD):
    text = text or ""
    said, base, blocks = words(text), [], []
    for phrase, label in lc.PHRASES:
        p = phrase.split()
        base += [(label, i) for i in range(len(said) - len(p) + 1) if said[i : i + len(p)] == p]
    for k, line in enumerate(text.split("\n")):
        for label, template in lc.TEMPLATES:
            t = set(template.split())
            share = len(t & set(words(line)))
            if 100 * share >= threshold * len(t):
                blocks.append((k, line, label, share / len(t)))
    places = [i for _, i in base]
    labels = {x for x, _ in base}
    score = 1.0 if base else max((b[3] for b in blocks), default=0.0)
    row = (doc_id, len(said), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {b[2] for b in blocks})), score)
    return row, blocks


def texts(seed, n):
    r = random.Random(seed)
    other = "the a le de license of public und code é Ünder CC-by All,rights permission granted".split()
    out = []
    for _ in range(n):
        lines = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(lc.TEMPLATES)[1].split()
            kept = [w for w in t if r.random() > r.choice([0, 0.05, 0.12, 0.3])]
            kept += [r.choice(other) for _ in range(r.randint(0, 5))]
            r.shuffle(kept)
            lines.append(r.choice([" ", ", ", "-", "\t"]).join(w.upper() if r.random() < 0.2 else w for w in kept))
        out.append(r.choice(["\n", "\n\n", " "]).join(lines))
    return out


def test_every_block_that_meets_a_template_is_found(spark):
    fixed = [None, "", " \n ", "CC BY\ncc", "all rights\nreserved all RIGHTS reserved", "xall rights reserved", "cc by cc by cc by", "éall rights reserved all rights reserved2", "Released under the MIT License.", "Kcc by"]
    rows = [(i % 90, t, "x", 1) for i, t in enumerate(fixed + texts(3, 150))]
    d = spark.createDataFrame(rows, "doc_id long, text string, blocks string, _low int")
    want = [expected(i, t) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, lc.report(d).collect()))) == sorted(str(w) for w, _ in want)
    found, names = lc.scanned(d)
    assert found.columns[:4] == d.columns and names["blocks"] == "blocks_"
    got = [tuple(b) for r in found.select(names["blocks"]).collect() for b in r[0]]
    assert sorted(got) == sorted(b for _, bs in want for b in bs) and len(got) > 100


@pytest.mark.parametrize("threshold", [50, 75, 100])
def test_thresholds(spark, threshold):
    rows = list(enumerate(texts(threshold, 60)))
    got = lc.report(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(expected(i, t, threshold)[0]) for i, t in rows)


def test_order_is_from_the_rarest_word_on_and_prefixes_are_short(spark):
    d = spark.createDataFrame([("the the mit\nthe license",), ("The of\n",), (None,)], "text string")
    counts = lc.frequencies(d, "text", ["the", "mit", "license", "none"])
    assert counts == {"the": 3, "mit": 1, "license": 1, "none": 0}
    order = sorted(counts, key=lambda w: (counts[w], w))
    (t,) = lc.ordered((("x", "the mit license none"),), order, 75)
    assert (t.words, t.need, t.prefix) == (("none", "license", "mit", "the"), 3, ("none", "license"))


def test_blocks_of_several_lines_and_no_rows(spark):
    wrapped = "Released under\nthe MIT\nLicense.\n\nother text"
    d = spark.createDataFrame([(1, wrapped)], "doc_id long, text string")
    assert [r.labels for r in lc.report(d).collect()] == [""] and [r.labels for r in lc.report(d, break_at="\n[ \t]*\n").collect()] == ["mit"]
    assert lc.report(d.where("false")).collect() == []


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = lc.report(d.select("doc_id", F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
