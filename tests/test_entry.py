"""Registered queries against their SQL, and the streaming counts."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from rowproof.plans import file_queries, queries
from rowproof.plans.sides import order_sides
from rowproof.streaming.counts import arriving_counts

QUERIES, SQL = queries.QUERIES | file_queries.QUERIES, queries.SQL | file_queries.SQL
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda rows: sorted(map(repr, plain(rows)))
    assert key(map(tuple, got.select(*names).collect())) == key(duck.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    a, b = order_sides(spark, DATA)
    for name, side in (("a", a), ("b", b)):
        side.write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema(a.schema).parquet(str(tmp_path / n))
    q = arriving_counts(read("a"), read("b")).writeStream.outputMode("complete").format("memory").queryName("arriving").start()
    q.processAllAvailable()
    q.stop()
    m = spark.sql("SELECT sum(an) AS a, sum(bn) AS b FROM arriving").first()
    assert (m.a, m.b) == (a.count(), b.count())
