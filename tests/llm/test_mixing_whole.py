"""Topics come from every word of every text, in every language, in the query and its SQL."""

import duckdb

from rowproof.llm import mixing
from rowproof.llm.queries import SQL


def test_topics_of_the_report_are_the_key_words_of_all_texts(spark):
    said = {0: "Harbour harbour market", 1: "market, harbour Market", 2: "market"}
    rows = [(i, f"The {said.get(i % 20, 'plain')} text {i}", f"l{i % 25}" if i >= 3000 else "en", ("a", "b", None)[i % 3]) for i in range(4000)]
    rows += [(i, f"ÉTÉ été {i // 25} Straße | STRASSE étés", f"l{i % 25}", "c") for i in range(4000, 4200)]
    rows += [(5000, None, "en", "a"), (5001, "", None, None), (5002, "market " * 9000 + "harbour " * 9001, "en", "b"), (5002, "plain", "en", "b"), (None, "market", "zz", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.report(d)
    topics = {r.doc_id: r.topic for r in got.collect()}
    assert [topics[i] for i in (0, 1, 2, 3, 5000, 5001)] == ["topic 2", "topic 1", "topic 1", *[mixing.OTHER] * 3]
    assert len({r.lang for r in got.where("topic != '(other)'").collect()}) > 20
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    names = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({SQL['op4_mixing']})").fetchall()))


def test_no_sample_names_the_topics(spark):
    """A word in one of fifty texts is a key word, one in fewer is none, among more texts than any sample of 2,000 shows exactly."""
    rows = [(i, "alpha" if i < 100 else "beta1" if i < 199 else "plain", "en") for i in range(5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert mixing.key_words(d) == {"en": ["alpha"]}
