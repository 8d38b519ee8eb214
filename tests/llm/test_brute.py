"""The toxicity classifier against a dense training of the same objective, the CRF against all labelings of short pages, and stages on nulls and without rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from rowproof.llm import bpe, htmlcrf, toxicity
from rowproof.llm.htmlblocks import leaf_blocks

DATA = "/root/testdata/sf0.001"


def labelled(n):
    """(doc_id, text, toxic) with words that tell the label, some identity terms, and noise."""
    r = random.Random(6)
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [r.choice("alpha beta gamma delta river stone tree house".split()) for _ in range(r.randint(2, 9))]
        words += [r.choice("idiot moron trash".split())] * (toxic and r.random() < 0.8) + [r.choice("muslim gay women".split())] * (r.random() < (0.5 if toxic else 0.1))
        r.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def dense(rows, penalty, steps=1500, ridge=1e-5):
    """Weights by feature and the intercept, by accelerated gradient steps on full matrices."""
    texts = [toxicity.words_of(t) for _, t, _ in rows]
    y = np.array([label for *_, label in rows], float)
    seen = {c: Counter(f for w, v in zip(texts, y) if v == c for f in toxicity.features(w)) for c in (0, 1)}
    n1, n0 = y.sum(), (1 - y).sum()

    def gain(f):
        p, q = (seen[1][f] + 0.5) / (n1 + 1), (seen[0][f] + 0.5) / (n0 + 1)
        return (p - q) * math.log(p / q) * 2 * n1 * n0 / (n1 + n0)

    names = [f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= toxicity.MIN_DOCS and (gain(f) >= toxicity.MIN_GAIN or f in toxicity.NEXT_TERM)]
    row = lambda words: np.array([float(f in toxicity.features(words)) for f in names])
    x = np.array([row(w) for w in texts])
    others = ([toxicity.swapped(w) for w in texts] + [toxicity.without_terms(w) for w in texts], [toxicity.mentioning(w) for w in texts])
    sorts = [np.concatenate([x] * (len(o) // len(x))) - np.array([row(w) for w in o]) for o in others]
    sorts = [d[np.abs(d).sum(1) > 0] for d in sorts]
    sorts = [d for d in sorts if len(d)] if penalty else []
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    step = 1 / (0.25 * (share * (x.sum(1) + 1)).sum() + ridge + sum(2 * penalty * np.abs(d).sum() / len(d) for d in sorts))
    w = look = np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        g = (1 / (1 + np.exp(-(x @ look[:-1] + look[-1]))) - y) * share
        grad = np.append(x.T @ g + ridge * look[:-1] + sum(2 * penalty / len(d) * d.T @ (d @ look[:-1]) for d in sorts), g.sum())
        moved = look - step * grad
        look, w = moved + (t - 1) / (t + 2) * (moved - w), moved
    return dict(zip(names, w[:-1])), w[-1], [len(d) for d in sorts]


@pytest.mark.parametrize("penalty", [0.0, toxicity.SWAP_PENALTY])
def test_training_equals_dense_gradients(spark, penalty):
    rows = labelled(300)
    held = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("fold", toxicity.fold())
    learned = [(r.doc_id, r.text, r.toxic) for r in held.where("fold <> 1").collect()]
    weights, bias, pairs = dense(learned, penalty)
    model = toxicity.train(held.select("doc_id", "text"), held.select("doc_id", "toxic"), swap_penalty=penalty)
    assert len(learned) > 150 and len(weights) > 10 and abs(model.bias - bias) < 1e-9
    assert {f for f, w in weights.items() if abs(w) > 1e-5} <= set(model.weights) and all(abs(model.weights.get(f, 0.0) - w) < 2e-6 for f, w in weights.items())
    assert not penalty or [model.swaps, model.mentions] == pairs
    got = {r.doc_id: r.score for r in toxicity.score(held, model).collect()}
    for i, text, _ in rows:
        z = bias + sum(weights.get(f, 0.0) for f in toxicity.features(toxicity.words_of(text)))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-5


def page(parts):
    return "<html><body>" + "".join(f"<{tag} class='{c}'>{text}</{tag.split()[0]}>" for tag, c, text in parts) + "</body></html>"


def test_short_pages_get_the_best_of_all_labelings(spark):
    r = random.Random(2)
    said = lambda n: " ".join(r.choice("the of land water stone light under".split()) for _ in range(n)) + "."
    whole = [f"<html><body><nav><a href='/'>Home</a></nav><article><h1>{said(4)}</h1><p>{said(40)}</p><p>{said(30)}</p></article><footer>{said(5)}</footer></body></html>" for _ in range(30)]
    kinds = [("div", "menu"), ("p", ""), ("p", "notice"), ("div", "comments"), ("h2", ""), ("footer", ""), ("div", "content"), ("article", "post"), ("nav", "x")]
    short = [page([(*r.choice(kinds), said(r.choice([2, 6, 40]))) for _ in range(r.randint(1, 9))]) for _ in range(60)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(whole + short)] + [(200, "u", None), (201, None, ""), (202, "u", "<p>")], "page_id long, url string, html string")
    field = htmlcrf.train(pages)
    got = {x.page_id: x.text for x in htmlcrf.extract(pages, field).collect()}
    kept = 0
    for i, h in enumerate(whole + short):
        blocks = leaf_blocks(h)
        rows = [b.node.features(10**6) + htmlcrf.own_features(b, k, len(blocks)) for k, b in enumerate(blocks)]
        unary = [[sum(field.weights.get(f, (0.0, 0.0))[s] for f in row) for s in (0, 1)] for row in rows]
        score = lambda s: sum(u[k] for u, k in zip(unary, s)) + sum(field.steps[a, b] for a, b in zip(s, s[1:]))  # noqa: E731,B023
        best = max(map(score, itertools.product((0, 1), repeat=len(blocks))))
        states = field.viterbi(field.unaries(blocks))
        assert abs(score(states) - best) < 1e-9 and len(blocks) <= 9
        assert got[i] == "\n".join(b.text for b, s in zip(blocks, states) if s)
        kept += bool(got[i])
    assert kept > 30 and (got[200], got[201], got[202]) == ("", "", "")


def test_word_store_of_bpe_makes_no_difference():
    v = bpe.Vocabulary(open(pipeline.VOCABULARY).read())
    r = random.Random(1)
    texts = ["".join(r.choice(["the", " the", "ing", "x", " ", "é", "1"]) for _ in range(40)) for _ in range(50)]
    kept = {}
    once = [v.encode_batch([t], {})[0] for t in texts]
    assert [v.encode_batch([t], kept)[0] for t in texts] == once == v.encode_batch(texts, {}) and kept


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_on_nulls_long_texts_and_no_rows(spark, name, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    long = " ".join(f"word{i % 977}" for i in range(40_000)) + "\n" + "line of text\n" * 3000
    odd = [(9001, None, None, None, None), (None, "no id", "en", "src0", 5), (9002, "", "", "", 0), (9003, long, "en", "src0", len(long)), (9004, long, "en", "src0", len(long)), (9004, long, "en", "src0", len(long)), (9005, " \n\t\n", "en", None, 4)]
    odd = spark.createDataFrame(odd, docs.schema)
    out = stage(spark, docs.unionByName(odd), DATA)
    rows = out.collect()
    assert name == "BPE" or out.columns == docs.columns
    ids = [r.doc_id for r in rows]
    if name in ("toxicity", "line dedup", "BPE"):  # nothing here is toxic
        assert {9001, 9002, 9003, 9004, 9005, None} <= set(ids) and ids.count(9004) == 2
    if name == "SimHash near-dedup":
        assert not {9004} & set(ids) and 9003 in ids and 9001 in ids and not {9002, 9005} & set(ids)  # texts without words are one group
    if name == "BPE":
        assert {r.n_tokens for r in rows if r.doc_id in (9001, 9002)} == {0}
    none = stage(spark, docs.where("false"), DATA)
    assert none.columns == out.columns and none.collect() == []
