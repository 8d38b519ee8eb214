"""The counterfactual penalty end to end, bounds of the sample, and awkward rows."""

import random

from rowproof.llm import toxicity

GROUPS = {"en": ("muslim", "christian"), "fr": ("juif", "hindou"), "de": ("frauen", "männer"), "es": ("árabes", "blancos")}
PLAIN = {"en": "tree river stone market garden winter", "fr": "arbre rivière pierre marché jardin hiver", "de": "baum fluss stein markt garten winter", "es": "árbol río piedra mercado jardín invierno"}
INSULTS = {"en": "idiot", "fr": "imbécile", "de": "trottel", "es": "tonto"}


def corpus(spark, n=2400):
    """Most toxic texts name a group and few clean ones do: the name foretells the label, but the insult makes it."""
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        lang, toxic = rng.choice(list(GROUPS)), rng.random() < 0.4
        words = rng.choices(PLAIN[lang].split(), k=6)
        if toxic and rng.random() < 0.8:
            words.append(INSULTS[lang])
        if rng.random() < (0.9 if toxic else 0.15):
            words.append(GROUPS[lang][0] if rng.random() < 0.9 else GROUPS[lang][1])
        rng.shuffle(words)
        texts.append((i, " ".join(words), lang))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_the_penalty_lowers_false_positives_on_neutral_mentions(spark):
    docs, labels = corpus(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    names = {t for g in GROUPS.values() for t in g}

    def rates(**options):
        rows = [r for r in toxicity.classified(docs, labels, threshold=0.5, **options).collect() if r.held_out]
        neutral = [r.predicted for r in rows if not truth[r.doc_id] and names.intersection(text[r.doc_id].split())]
        insulted = [r.predicted for r in rows if truth[r.doc_id] and set(INSULTS.values()).intersection(text[r.doc_id].split())]
        return sum(neutral) / len(neutral), sum(insulted) / len(insulted)

    plain, caught = rates(swap_penalty=0.0)
    fair, still_caught = rates()
    assert plain > 0.5 and fair < 0.1, (plain, fair)
    assert still_caught > 0.95, (caught, still_caught)
    # Without the terms, the penalty has nothing to act on.
    assert rates(terms=())[0] == plain


def test_the_model_reports_its_pairs(spark):
    docs, labels = corpus(spark, 600)
    assert (m := toxicity.train(docs, labels)).swaps > 100 and m.mentions > 50
    none = toxicity.train(docs, labels, terms=())
    assert (none.swaps, none.mentions) == (0, 0)


def test_terms_absent_from_the_sample_are_freed_of_what_they_share():
    """"oldest" is toxic here by its beginning; a mention of "old" must not be."""
    names = ["^ol", "tree", "stone"]
    rows = [[0, 1]] * 50 + [[1], [2]] * 50
    y = [1] * 50 + [0] * 100
    mentions = [(r, sorted({*r, 0})) for r in rows]
    import numpy as np

    free, _ = toxicity.fit(rows, [], np.array(y), len(names), swap_penalty=4.0, mentions=mentions)
    plain, _ = toxicity.fit(rows, [], np.array(y), len(names), swap_penalty=0.0, mentions=mentions)
    assert abs(free[0]) < 0.3 < plain[0]


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    docs, labels = corpus(spark, 300)
    seen = []
    kept = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a, **k: seen.append(len(rows)) or kept(rows, *a, **k))
    once = toxicity.classified(docs, labels).where("doc_id = 5").first()
    again = toxicity.classified(docs.unionByName(docs).unionByName(docs.where("doc_id = 5")), labels).where("doc_id = 5").collect()
    assert seen[0] == seen[1] and len(again) == 3 and {r.score for r in again} == {once.score}


def test_awkward_texts_and_columns(spark):
    docs, labels = corpus(spark, 300)
    more = spark.createDataFrame([(9000, None, None), (9001, "", ""), (9002, "tree " * 400_000, "en"), (9003, "x" * 2_000_000, "en"), (None, "idiot", "en")], docs.schema)
    wide = docs.unionByName(more).selectExpr("*", "1 as score", "2 as predicted", "3 as toxic", "4 as held_out")
    got = {r.doc_id: r for r in toxicity.classified(wide, labels.selectExpr("*", "'a' as text")).collect()}
    assert len(got) == 305 and got[9000].score == got[9001].score == got[9003].score and got[9002].predicted == 0
    assert toxicity.classified(wide.where("false"), labels).count() == 0


def test_training_and_scoring_read_the_same_words():
    for text in ("ΟΔΟΣ Σ. İstanbul don't_x", "A B\x1cC-d E", "straße STRASSE"):
        assert toxicity.words_of(text) == {w for t in text.split() for w in toxicity.words_in(t)} == set(toxicity._WORD.findall(text.lower()))
