"""Topics from the texts, token counts, and targets that cannot be met; hosts of addresses."""

import pytest
from pyspark.sql import functions as F

from rowproof.llm import linededup, mixing


def test_topics_are_the_key_words_said_most(spark):
    said = {0: "harbour Harbour market", 1: "market, market harbour"}
    rows = [(i, f"The {said.get(i % 16, 'plain')} text {i}", "en") for i in range(160)] + [(160, None, "en"), (161, "", None), (162, "harbour", "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = mixing.key_words(d, topics=2)
    assert names["en"] == ["harbour", "market"]
    topic = mixing.topic_of(F.col("text"), F.col("lang"), {"en": names["en"]})
    got = {r.doc_id: r for r in d.select("doc_id", topic.alias("t"), mixing.tokens_of(F.col("text")).alias("n")).collect()}
    assert [got[i].t for i in (0, 1, 2, 160, 161, 162)] == ["topic 1", "topic 2", *[mixing.OTHER] * 4]
    assert (got[0].n, got[160].n, got[161].n) == (6, 1, 1)


def test_targets_that_cells_cannot_meet_raise(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("b", "y", "t", 10.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": [("a", 0.9), ("b", 0.1)], "lang": [("x", 0.1), ("y", 0.9)]}
    with pytest.raises(ValueError, match="targets not met"):
        mixing.rake(cells, {d: spark.createDataFrame(v, "value string, share double") for d, v in targets.items()}, max_sweeps=4)


def test_hosts(spark):
    d = spark.createDataFrame([("https://Www.Example.com/a?b",), (None,), ("no address",)], "url string")
    assert [r[0] for r in d.select(linededup.host_of(F.col("url"))).collect()] == ["www.example.com", None, None]
