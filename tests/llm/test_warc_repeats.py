"""Rows that repeat a page id and payload: one response, the others revisit it."""

import duckdb

from rowproof.llm import queries, warc


def test_one_of_repeated_rows_is_the_response(spark, tmp_path):
    long = "<p>" + "x" * 200
    rows = [(1, "u", long), (1, "u", long), (1, None, long), (2, "v", long), (3, "w", "short"), (3, "w", "short"), (None, "n", long), (None, "n", "<q>" + "y" * 200), (None, "n", "<q>" + "y" * 200), (5, "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.round_trip(pages).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(queries.SQL["op6_warc"])
    names = [c[0] for c in found.description]
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == sorted(map(str, found.fetchall()))
    assert [(r.url, r.record_type, r.refers_to) for r in got if r.page_id == 1 and r.record_type == "response"] == [(None, "response", None)]
    assert sum(r.record_type == "revisit" for r in got) == 4
