"""Queries that go through files: tables written as delimited files to the shared folder, and read back by the reader of files.

A file is one value to its writer, so that writing one is one task; reading is in splits. Each query gives what the table itself tells in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.plans.reconcile import process_pair
from rowproof.plans.sides import table
from rowproof.session import scratch_path
from rowproof.settings import Settings
from rowproof.sources import files, records, tables


def _file(lines: DataFrame, name: str) -> str:
    """The path of the one file that holds the lines in the order of their places."""
    path = scratch_path(lines.sparkSession, name)
    lines.repartition(1).sortWithinPartitions("place").select("line").write.option("lineSep", "\n").text(path)
    return next(f"{path}/{n}" for n in files.list_folder(lines.sparkSession, path) if n.startswith("part-"))


def quoted(value: Column, always: bool = False) -> Column:
    """A cell as a comma-separated file writes it: marks doubled inside marks, where it needs them or always."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    inside = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return inside if always else F.when(F.rlike(text, F.lit(r'[",\r\n]')), inside).otherwise(text)


def _lines(df: DataFrame, columns: list[str], always: bool = False) -> Column:
    return F.concat_ws(",", *[quoted(F.col(c), always) for c in columns])


def _headed(rows: DataFrame, header: str) -> DataFrame:
    """rows (place, line) with the header before them."""
    return rows.sparkSession.createDataFrame([(-1, header)], "place long, line string").unionByName(rows.select("place", "line"))


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as a comma-separated file and loaded from it: encoding, format and header are found, texts have their line breaks."""
    names = ["doc_id", "text", "lang", "source"]
    docs = table(spark, sf_dir, "documents")
    path = _file(_headed(docs.select(F.col("doc_id").alias("place"), _lines(docs, names).alias("line")), ",".join(names)), "documents")
    opened = records.open_file(spark, path)
    f = tables.sniff(opened.opening_text(spark))
    header = records.first_record(opened, spark, f.delim, f.quote) or names
    loaded = tables.load(records.records(opened, f.delim, f.quote), f, len(header))
    return loaded.rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(header, 1)])


FILE_ROWS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents"


def file_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The malformed lines of a file of customers, in which some lack a cell, have one more, leave a quote open in their line or write on after one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    cells = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")]
    kind = F.col("c_custkey") % 50
    line = (
        F.when(kind == 7, F.concat_ws("|", *cells[:2])).when(kind == 19, F.concat_ws("|", *cells, F.lit("more")))
        .when(kind == 31, F.concat_ws("|", cells[0], F.concat(F.lit('"'), cells[1], F.lit('" x')), cells[2])).when(kind == 40, F.lit("")).otherwise(F.concat_ws("|", *cells))
    )
    path = _file(_headed(c.select(F.col("c_custkey").alias("place"), line.alias("line")), "KEY|NAME|SEGMENT"), "customer")
    opened = records.open_file(spark, path)
    f = tables.sniff(opened.opening_text(spark), {"a": {"delim": "|"}}, "a")  # given, as so many broken quotes make another mark likelier
    return tables.load(records.records(opened, f.delim, f.quote), f, 3).rejects.drop("file")


FILE_REJECTS = """WITH c AS (SELECT c_custkey % 50 AS kind, CAST(c_custkey AS VARCHAR) AS k, c_name AS n, c_mktsegment AS m, row_number() OVER (ORDER BY c_custkey) + 1 AS line FROM customer)
SELECT CAST(line AS BIGINT) AS line, CASE kind WHEN 7 THEN 'MISSING COLUMNS' WHEN 19 THEN 'TOO MANY COLUMNS' ELSE 'INVALID STATE' END AS error_type,
'Expected 3 columns, found ' || CASE kind WHEN 7 THEN 2 WHEN 19 THEN 4 ELSE 3 END AS error_message,
CASE kind WHEN 7 THEN k || '|' || n WHEN 19 THEN k || '|' || n || '|' || m || '|more' ELSE k || '|"' || n || '" x|' || m END AS raw_line FROM c WHERE kind IN (7, 19, 31)"""


def file_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of files of all orders, from the files to the verdict: one lacks some orders, has others twice and changes a cell of some; it is quoted throughout."""
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    o = table(spark, sf_dir, "orders").select(*names)
    o = o.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,2)"))
    n = F.pmod(F.col("o_orderkey"), F.lit(97))
    b = o.where(n != 3).withColumn("o_orderstatus", F.when(n == 5, "X").otherwise(F.col("o_orderstatus"))).withColumn("_k", F.explode(F.when(n == 11, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    path_a = _file(_headed(o.select(F.col("o_orderkey").alias("place"), _lines(o, names).alias("line")), ",".join(names)), "orders-a")
    path_b = _file(_headed(b.select(F.col("o_orderkey").alias("place"), _lines(b, names, True).alias("line")), ",".join(names)), "orders-b")
    r = process_pair(spark, files.Pair("orders", path_a, path_b), Settings())
    found = {"overall": r.overall, "key": ",".join(r.key.names) if r.key else "", "rows a": r.rows[0], "rows b": r.rows[1], "matched": r.metrics.matched_rows if r.metrics else 0, **r.counts, "message": r.message}
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "item string, value string")


FILE_PAIR = """WITH o AS (SELECT o_orderkey % 97 AS k FROM orders), n AS (SELECT count(*) AS a, count(*) FILTER (k = 3) AS gone, count(*) FILTER (k = 5) AS changed, count(*) FILTER (k = 11) AS twice FROM o)
SELECT unnest(['overall', 'key', 'rows a', 'rows b', 'matched', 'Only in A', 'Extra copies in B', 'Paired records', 'Differing cells', 'message']) AS item,
unnest(['MISMATCH', 'o_orderkey', CAST(a AS VARCHAR), CAST(a - gone + twice AS VARCHAR), CAST(a - gone - changed AS VARCHAR), CAST(gone AS VARCHAR), CAST(twice AS VARCHAR), CAST(changed AS VARCHAR), CAST(changed AS VARCHAR), '']) AS value FROM n"""

QUERIES = {"file_rows": file_rows, "file_rejects": file_rejects, "file_pair": file_pair}
SQL = {"file_rows": FILE_ROWS, "file_rejects": FILE_REJECTS, "file_pair": FILE_PAIR}
