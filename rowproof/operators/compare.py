"""Multiset comparison of two tables of text rows.

Both sides have the columns c1 .. cN and h (see functions.cells). Only hashes and counts are shuffled for the
comparison, after partial sums; whole rows are fetched later, for the hashes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("A", "B")


def cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "h"]


def counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per distinct row hash: h, an, bn (copies on each side). One union, one shuffle."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = a.select("h", one.alias("an"), none.alias("bn")).unionByName(b.select("h", none.alias("an"), one.alias("bn")))
    return both.groupBy("h").agg(F.sum("an").alias("an"), F.sum("bn").alias("bn"))


def metrics(cmp: DataFrame) -> DataFrame:
    """One row: matched, one-sided and surplus rows, distinct rows and the match rate."""
    an, bn = F.col("an"), F.col("bn")

    def total(value: Column, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("long")

    sums = cmp.agg(
        total(F.least(an, bn)).alias("matched_rows"),
        total(an, bn == 0).alias("only_a"),
        total(bn, an == 0).alias("only_b"),
        total(an - bn, (an > bn) & (bn > 0)).alias("extra_a"),
        total(bn - an, (bn > an) & (an > 0)).alias("extra_b"),
        F.count_if(an > 0).alias("distinct_a"),
        F.count_if(bn > 0).alias("distinct_b"),
        total(an).alias("rows_a"),
        total(bn).alias("rows_b"),
    )
    most = F.greatest("rows_a", "rows_b")
    return sums.withColumn("match_rate", F.when(most == 0, 0.0).otherwise(100.0 * F.col("matched_rows") / F.greatest(most, F.lit(1))))


def representatives(side: DataFrame, cmp: DataFrame, where: Column) -> DataFrame:
    """One whole row for each hash of cmp that fulfils `where`, with its counts."""
    return side.join(cmp.where(where), "h").dropDuplicates(["h"])


def one_sided(side: DataFrame, cmp: DataFrame, mine: str) -> DataFrame:
    """Distinct rows that have no copy on the other side, with `copies`."""
    other = "bn" if mine == "an" else "an"
    return representatives(side, cmp, F.col(other) == 0).withColumn("copies", F.col(mine)).drop("an", "bn")


def tagged(rows: DataFrame, status: str | Column, a: str | Column, b: str | Column, unmatched: str | Column, names: list[str]) -> DataFrame:
    as_col = lambda x: F.expr(x) if isinstance(x, str) else x
    label = F.lit(status) if isinstance(status, str) else status
    return rows.select(label.alias("status"), as_col(a).cast("long").alias("a_copies"), as_col(b).cast("long").alias("b_copies"), as_col(unmatched).cast("long").alias("unmatched_copies"), *names)


def status_of(sides: tuple[str, str] = SIDES) -> Column:
    an, bn = F.col("an"), F.col("bn")
    return (
        F.when(bn == 0, f"Only in {sides[0]}")
        .when(an == 0, f"Only in {sides[1]}")
        .when(an > bn, f"Extra copies in {sides[0]}")
        .otherwise(f"Extra copies in {sides[1]}")
    )


def surplus(a: DataFrame, b: DataFrame, cmp: DataFrame, sides: tuple[str, str] = SIDES) -> DataFrame:
    """Rows on both sides with more copies on one, once each. As both sides hold them, one side's rows will do."""
    rows = representatives(a, cmp, (F.col("an") != F.col("bn")) & (F.col("an") > 0) & (F.col("bn") > 0))
    return tagged(rows, status_of(sides), "an", "bn", "abs(an - bn)", cells(a))


def mismatches(a: DataFrame, b: DataFrame, cmp: DataFrame, sides: tuple[str, str] = SIDES) -> DataFrame:
    """All differing rows by the four statuses, without a key: one join over both sides' rows and one shuffle on the hash."""
    rows = a.unionByName(b).join(cmp.where("an <> bn"), "h").dropDuplicates(["h"])
    return tagged(rows, status_of(sides), "an", "bn", "abs(an - bn)", cells(a))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def multiset_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a beyond b's copies, each as often as it is in surplus."""
    return a.drop("h").exceptAll(b.drop("h"))


def multiset_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.drop("h").intersectAll(b.drop("h"))
