"""Two extracts of one table that differ in known ways, derived from the given tables; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions.cells import with_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders without every 11th key (A) and without every 13th (B); B re-writes some cells; both repeat some rows."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    price, status, priority = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")

    def side(drop: int, again: int, *text) -> DataFrame:
        rows = o.where(key % drop != 0)
        cells = [F.coalesce(x, F.lit("")).alias(f"c{i}") for i, x in enumerate((key.cast("string"), *text, day), 1)]
        return with_hash(rows.withColumn("_n", F.explode(F.when(key % again == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(*cells))

    a = side(11, 29, price, status, priority)
    b = side(
        13, 31,
        F.when(key % 19 == 0, F.concat(F.lit("000"), price)).otherwise(price),
        F.when(key % 23 == 0, F.concat(status, F.lit(" "))).otherwise(status),
        F.when(key % 17 == 0, F.lower(priority)).otherwise(priority),
    )
    return a, b


def line_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders under keys that repeat (order) or do not (order and line number)."""
    rows = table(spark, sf_dir, "lineitem")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")

    def side(drop: int, quantity) -> DataFrame:
        cells = (key.cast("string"), line.cast("string"), quantity, F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd"))
        return with_hash(rows.where((key + line) % drop != 0).select(*[F.coalesce(x, F.lit("")).alias(f"c{i}") for i, x in enumerate(cells, 1)]))

    quantity = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    return side(37, quantity), side(41, F.when(key % 7 == 0, F.concat(quantity, F.lit("0"))).otherwise(quantity))


def _hashed(rows: str) -> str:
    return "SELECT *, md5(concat(" + ", ".join(f"strlen(c{i}), ':', c{i}" for i in range(1, 6)) + f")) AS h FROM ({rows})"


_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _order_rows(drop: int, again: int, price: str, status: str, priority: str) -> str:
    row = f"SELECT CAST(o_orderkey AS VARCHAR) AS c1, {price} AS c2, {status} AS c3, {priority} AS c4, {_DAY} AS c5 FROM orders WHERE o_orderkey % {drop} <> 0"
    return f"{row} UNION ALL {row} AND o_orderkey % {again} = 0"


ORDER_SQL = (
    "a AS ("
    + _hashed(_order_rows(11, 29, _PRICE, "o_orderstatus", "o_orderpriority"))
    + "), b AS ("
    + _hashed(
        _order_rows(
            13, 31,
            f"CASE WHEN o_orderkey % 19 = 0 THEN '000' || {_PRICE} ELSE {_PRICE} END",
            "CASE WHEN o_orderkey % 23 = 0 THEN o_orderstatus || ' ' ELSE o_orderstatus END",
            "CASE WHEN o_orderkey % 17 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END",
        )
    )
    + ")"
)

_QUANTITY = "CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)"


def _line_rows(drop: int, quantity: str) -> str:
    return (
        f"SELECT CAST(l_orderkey AS VARCHAR) AS c1, CAST(l_linenumber AS VARCHAR) AS c2, {quantity} AS c3, l_returnflag AS c4, "
        f"strftime(l_shipdate, '%Y-%m-%d') AS c5 FROM lineitem WHERE (l_orderkey + l_linenumber) % {drop} <> 0"
    )


LINE_SQL = "a AS (" + _hashed(_line_rows(37, _QUANTITY)) + "), b AS (" + _hashed(_line_rows(41, f"CASE WHEN l_orderkey % 7 = 0 THEN {_QUANTITY} || '0' ELSE {_QUANTITY} END")) + ")"

CMP_SQL = """cmp AS (SELECT coalesce(x.h, y.h) AS h, coalesce(an, 0) AS an, coalesce(bn, 0) AS bn
FROM (SELECT h, count(*) AS an FROM a GROUP BY h) x FULL JOIN (SELECT h, count(*) AS bn FROM b GROUP BY h) y ON x.h = y.h),
only_a AS (SELECT DISTINCT a.*, an AS copies FROM a JOIN cmp ON a.h = cmp.h WHERE bn = 0),
only_b AS (SELECT DISTINCT b.*, bn AS copies FROM b JOIN cmp ON b.h = cmp.h WHERE an = 0)"""
