"""Column statistics of two sides, over all rows.

Columns are unpivoted once into (pos, value) and summed per value, rather than one job per column; partial sums drop
most repetitions before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions.cells import shape_counts, shape_label
from rowproof.operators.compare import cells

EXAMPLES = 3


def values(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column and distinct value: pos, v, in_a, in_b."""

    def long(side: DataFrame, in_a: bool) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).alias("v")) for i, c in enumerate(cells(side), 1)])
        return side.select(F.explode(pairs).alias("x")).select("x.pos", "x.v", F.lit(in_a).alias("in_a"), F.lit(not in_a).alias("in_b"))

    return long(a, True).unionByName(long(b, False)).groupBy("pos", "v").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))


def overlap(vals: DataFrame) -> DataFrame:
    """One row per column: distinct values on each side, values on one side only, and overlap = common / larger side."""
    both = F.col("in_a") & F.col("in_b")
    out = vals.groupBy("pos").agg(
        F.count_if("in_a").alias("a_distinct"),
        F.count_if("in_b").alias("b_distinct"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"),
        F.count_if(both).alias("common"),
    )
    return out.withColumn("overlap", F.col("common") / F.greatest("a_distinct", "b_distinct", F.lit(1))).drop("common")


def examples(vals: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """The first k values, in text order, of each column that are on one side only: pos, side, rank, v."""
    one = vals.where("in_a <> in_b").select("pos", F.when(F.col("in_a"), "A").otherwise("B").alias("side"), "v")
    rank = F.row_number().over(Window.partitionBy("pos", "side").orderBy("v"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("pos", "side", "rank", "v")


def shapes(side: DataFrame) -> DataFrame:
    """One row per column: how many cells look like integers, like decimals, like text, and the column's label."""
    names = cells(side)
    wide = side.agg(*[agg.alias(f"{c}_{k}") for c in names for k, agg in shape_counts(c).items()])
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), *[F.col(f"{c}_{k}").alias(k) for k in ("integer", "decimal", "text")]) for i, c in enumerate(names, 1)])
    long = wide.select(F.explode(rows).alias("x")).select("x.*")
    return long.withColumn("label", shape_label(F.col("integer"), F.col("decimal"), F.col("text")))


def statistics(a: DataFrame, b: DataFrame, distinct_a: int, distinct_b: int, k: int = EXAMPLES) -> DataFrame:
    """One row per column with everything the report shows. distinct_a and distinct_b are the sides' distinct rows."""
    vals = values(a, b)
    side = lambda df, s: shapes(df).select("pos", *[F.col(c).alias(f"{s}_{c}") for c in ("label", "integer", "decimal", "text")])
    seen = examples(vals, k).groupBy("pos").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("rank", "v")))), lambda x: x["v"]).alias(f"{s.lower()}_examples") for s in ("A", "B")]
    )
    out = overlap(vals).join(side(a, "a"), "pos").join(side(b, "b"), "pos").join(seen, "pos", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns(
        {
            "a_examples": F.coalesce("a_examples", empty),
            "b_examples": F.coalesce("b_examples", empty),
            "unique_a": (F.col("a_distinct") == distinct_a) & (F.lit(distinct_a) > 0),
            "unique_b": (F.col("b_distinct") == distinct_b) & (F.lit(distinct_b) > 0),
        }
    )


def differing_by_column(differences: DataFrame) -> DataFrame:
    """How many paired records differ in each column."""
    return differences.groupBy("pos").agg(F.count("*").alias("paired_differing"))
