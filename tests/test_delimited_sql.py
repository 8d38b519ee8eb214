"""The delimited-text queries against their SQL on texts with quotes, breaks and blanks in awkward places."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from rowproof.functions import delimited, sqltable

NAMES = ("csv_tokens", "csv_columns", "csv_table_function", "csv_samples", "csv_profile_text", "across_files", "dialect_choice")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(4), tmp_path_factory.mktemp("texts")
    bits = ['"', '""', "'", ",", ",", "|", "\t", ";", "\n", "\n", "\r\n", "\r", " ", "a", "é", '","', '"\n', "12", "-1.5e3", '"x"', "word " * 12]
    texts = [None, "", " ", "\n", "\n\n", '"', '""', ',', '"a,', 'a,"b\n', "a,b\n1,2\n\n3\n", '"a" ,"b"\t\n" ","\t"\n']
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["\n".join(rng.choice(["1", '"x"', "x", ""]) + rng.choice([",", "|"]) + "2" for _ in range(250))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = sorted(got.columns)
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == want and want


@pytest.mark.parametrize("delim,quote", [(",", '"'), ("|", "'"), ("\t", '"'), ("^", "]"), (";", "$")])
def test_table_function_equals_the_tokenizer(spark, folder, delim, quote):
    sqltable.register(spark, "told")
    d = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", f"""replace(replace(text, '|', '{delim if delim in "^;" else "|"}'), '"', '{quote if quote in "]$" else chr(34)}') AS text""")
    got = spark.sql("SELECT d.doc_id, t.* FROM {d} d, LATERAL told_tokens(d.text, {delim}, {quote}) t", d=d, delim=delim, quote=quote)
    names = got.columns
    want = delimited.tokens(d, "doc_id", "text", delim, quote).select(*names)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    records = spark.sql("SELECT count(*), sum(width) FROM {d} d, LATERAL told_records(d.text, {delim}, {quote}) t", d=d, delim=delim, quote=quote).first()
    assert tuple(records) == (len({r[:2] for r in rows}), len(rows))
