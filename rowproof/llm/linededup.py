"""Site-relative line frequency: lines on too many of a site's pages are boilerplate and go.

For each host, the pages that hold a line (trimmed, blank lines aside) are divided by the host's pages; lines above
`ratio` that are on `min_pages` pages or more are dropped from all of that host's pages. Pages of one host with equal texts
count as one page, so that a large group of copies does not make its own lines boilerplate; with `each_copy` every row
is a page, as in the SQL. Copies are told by two 64-bit hashes of the text and meet by the hashes of their lines. Counting works on two 64-bit hashes of a
line, is pre-aggregated before the shuffle, and keeps at most (mean lines of a page) / ratio lines for a host, whose list
meets the pages in one join: broadcast if the written table is small, else by host, where adaptive execution
splits a hot host. Everything is built from DataFrame functions.

Defined cases: a null text stays null and counts as a page without lines; a null host is a site of its
own; a line that repeats within a page counts once; blank lines stay; a page that loses all its lines keeps its row
with the empty text; an empty table gives no rows; a line and a page of any length count whole; extra columns are carried unchanged. Web pages take
their host from the address (`host_of`); the corpus's documents have sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm.common import unused
from rowproof.session import saved

#: A line of one page repeats nothing; from two pages on the ratio decides, whatever the size of the site.
RATIO, MIN_PAGES = 0.01, 2


def _key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, each_copy: bool = False) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines."""
    lines = F.filter(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    text, keys = F.col(text_col), F.array_distinct(F.transform(lines, _key)).alias("keys")
    held = pages.select(F.col(host_col).alias("host"), F.struct(text.isNull().alias("none"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("page"), text).alias("b")).alias("page"), keys)
    whole = held if each_copy else held.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    counted = held if each_copy else held.select("host", "page").distinct()
    seen = whole.select("host", F.explode("keys").alias("line"))
    often = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = counted.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"))
    bad = often.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return bad.groupBy("host").agg(F.collect_list("line").alias("lines"))


def cleaned(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True, each_copy: bool = False) -> DataFrame:
    """pages with `text_col` cleaned and, with `counts`, the longs n_lines and n_dropped at the end."""
    host, bad_lines, all_lines, kept_lines = unused(pages, "_host", "_bad", "_lines", "_kept")
    bad = saved(boilerplate(pages, host_col, text_col, ratio, min_pages, each_copy), "boilerplate").toDF(host, bad_lines)
    joined = pages.join(bad, pages[host_col].eqNullSafe(F.col(host)), "left")
    marked = joined.withColumn(all_lines, _lines(F.col(text_col)))
    # A page's own boilerplate is found by sets of hashes; its lines are then held against those few.
    met = F.array_intersect(F.transform(all_lines, lambda x: _key(x)["a"]), F.transform(bad_lines, lambda b: b["a"]))
    few = lambda found: F.filter(bad_lines, lambda b: F.array_contains(found, b["a"]))
    blank = lambda x: F.btrim(x, F.lit(" \t\r")) == ""
    kept = lambda own: F.when(F.size(own) == 0, F.col(all_lines)).otherwise(F.filter(all_lines, lambda x: blank(x) | ~F.array_contains(own, _key(x))))
    cleared = F.get(F.transform(F.array(met), lambda found: F.get(F.transform(F.array(few(found)), kept), F.lit(0))), F.lit(0))
    marked = marked.withColumn(kept_lines, F.when(F.col(bad_lines).isNull(), F.col(all_lines)).otherwise(cleared))
    columns = [F.array_join(kept_lines, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    more = [size(all_lines).alias("n_lines"), (size(all_lines) - size(kept_lines)).alias("n_dropped")]
    return marked.select(*columns, *(more if counts else []))


SQL = f"""
WITH page AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
seen AS (SELECT DISTINCT r, source, trim(x, ' ' || chr(9) || chr(13)) AS line FROM (SELECT r, source, unnest(lines) AS x FROM page)),
often AS (SELECT source, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY source, line),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT o.source, list(line) AS bad FROM often o JOIN total t ON o.source IS NOT DISTINCT FROM t.source
        WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY o.source),
kept AS (SELECT p.*, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
         FROM page p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped FROM kept
"""
