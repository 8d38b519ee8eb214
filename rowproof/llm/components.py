"""Connected components of an edge table, by alternating star operations on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.session import saved

MAX_ROUNDS = 40
#: Keys of more than HUB_ROWS rows and of more than one row in MAX_HUBS are hubs: 2 * MAX_HUBS of them at most among twice the rows.
HUB_ROWS, MAX_HUBS = 1_000, 50_000
_SALTS = 1 << 20


def looked_up(rows: DataFrame, groups: DataFrame, key: str, value: str, other: str, total: int) -> DataFrame:
    """rows (key, other) with the value that groups (key, value, n) holds for their key, where every key of rows is in groups.

    n counts the rows of a key and total those of the table (a half of them at least). The values of hubs, whose number is bounded, are broadcast;
    rows of a hub are dealt by `other` and not by their key, so that no key meets in one task, however many of the rows it holds.
    """
    hubs = groups.where(F.col("n") > max(HUB_ROWS, total // MAX_HUBS)).select(key, F.col(value).alias("_hub"))
    salt = F.when(F.col("_hub").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(other), F.lit(_SALTS)) + 1).cast("long")
    dealt = rows.join(F.broadcast(hubs), key, "left").withColumn("_salt", salt)
    none = F.pmod(F.col("n"), F.lit(1).cast("long"))  # zero, but no constant, which Spark would take out of the join's keys
    met = dealt.join(groups.select(key, value, none.alias("_salt")), [key, "_salt"], "left")
    return met.select(key, other, F.coalesce("_hub", value).alias(value))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return looked_up(both.where("v > u"), least, "u", "m", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = looked_up(down, least, "u", "m", "v", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the smallest node reachable.

    edges has columns u and v of one orderable type. Rows with a null or u = v are ignored. Every round writes its edges
    to the shared folder, so that the plan stays short and lost executors cost one round at most. Rounds end when
    all edges are stars around their roots. A node with most of all edges is looked up without being one task.
    """
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, total = None, edges.count()
    for _ in range(MAX_ROUNDS):
        edges = saved(_small_star(_large_star(edges, total), total).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, total = now, now[0]
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
