"""Text columns are scored whole; only files are scored by their opening."""

from rowproof.functions import delimited


def test_a_first_record_past_the_opening_counts(spark):
    long = "w" * delimited.SNIFF_CHARS
    texts = {1: f"{long};b;c\n1;2;3\n", 2: f"\"{long}\n\"|b\n1|2\n", 3: f"{long}|b|c"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    choice = lambda **k: {r.id: (r.delim, r.delim_status) for r in delimited.choose_dialect(delimited.dialect_scores(df, "id", **k), "id").collect()}
    assert choice() == {1: (";", "detected"), 2: ("|", "detected"), 3: ("|", "detected")}
    assert set(choice(opening_chars=delimited.SNIFF_CHARS).values()) == {(",", "guessed")}


def test_200_records_count(spark):
    df = spark.createDataFrame([(1, "a;b\n" * 200 + "a,b,c,d\n" * 5000)], "id int, text string")
    assert delimited.choose_dialect(delimited.dialect_scores(df, "id"), "id").first().delim == ";"
