"""Pairing one-sided rows on a key, differing cells, and the rows that stay unpaired."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.operators import compare
from rowproof.operators.compare import SIDES
from rowproof.session import saved

#: Keys of more than HUB_ROWS rows, and of more than one in MAX_HUBS of those with a shared key, are told by broadcast: MAX_HUBS of them at most.
HUB_ROWS, MAX_HUBS = 1_000, 50_000


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_key_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    return flagged(rows, key).where("_twice").drop("_twice")


def flagged(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with `_twice`, whether another row has its key.

    Keys of very many rows, whose number is bounded, are told by a broadcast; their rows are dealt by all cells, and only those of other keys by the key, so that no task gets
    more rows of one key than HUB_ROWS or a MAX_HUBS-th of all.
    """
    shared = saved(duplicate_keys(rows, key), "duplicate-keys")
    least = max(HUB_ROWS, (shared.agg(F.sum("n")).first()[0] or 0) // MAX_HUBS)
    hubs = shared.where(F.col("n") > least).select(*key, F.lit(True).alias("_hub"))
    salt = F.when(F.col("_hub").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).cast("long")
    dealt = rows.join(F.broadcast(hubs), key, "left").withColumn("_salt", salt)
    none = F.pmod(F.col("n"), F.lit(1).cast("long"))  # zero, but no constant, which Spark would take out of the join's keys
    known = shared.select(*key, none.alias("_salt"), F.lit(True).alias("_known"))
    met = dealt.join(known, [*key, "_salt"], "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_hub", "_known", F.lit(False)).alias("_twice"))


def pairs(a_rows: DataFrame, b_rows: DataFrame, key: list[str]) -> DataFrame:
    """Records of both sides with equal keys: key, a_* and b_* cells, a_copies and b_copies."""
    rest = [c for c in compare.cells(a_rows) if c not in key and c != "copies"]
    left = a_rows.select(*key, *[F.col(c).alias(f"a_{c}") for c in rest], F.col("copies").alias("a_copies"))
    right = b_rows.select(*key, *[F.col(c).alias(f"b_{c}") for c in rest], F.col("copies").alias("b_copies"))
    return left.join(right, key)


def cell_differences(paired: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per differing cell: key, pos, b_val, a_val, b_copies, a_copies. One generator, no union per column."""
    rest = [(i, c) for i, c in enumerate(columns, 1) if c not in key]
    kind = "array<struct<pos:int,b_val:string,a_val:string>>"
    both = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"b_{c}").alias("b_val"), F.col(f"a_{c}").alias("a_val")) for i, c in rest]).cast(kind)
    cell = F.explode(F.filter(both, lambda x: x["b_val"] != x["a_val"]))
    return paired.select(*key, cell.alias("x"), "b_copies", "a_copies").select(*key, "x.pos", "x.b_val", "x.a_val", "b_copies", "a_copies")


@dataclass
class Keyed:
    paired: DataFrame
    differences: DataFrame
    unpaired: DataFrame


def keyed(a: DataFrame, b: DataFrame, cmp: DataFrame, key: list[str], manual: bool, sides: tuple[str, str] = SIDES) -> Keyed:
    """Pair the rows that have no copy on the other side by key; the rest by status.

    A key chosen by hand may not be unique: rows that share one are set aside as duplicates and pair with nothing.
    """
    names = compare.cells(a)
    # The differing hashes and the one-sided rows are read several times below: each is written once.
    cmp = saved(cmp.where("an <> bn"), "differing")
    only_a, only_b = saved(compare.one_sided(a, cmp, "an"), "only-a"), saved(compare.one_sided(b, cmp, "bn"), "only-b")
    parts = []
    tag_a = lambda rows, status: compare.tagged(rows, status, "copies", F.lit(0), "copies", names)
    tag_b = lambda rows, status: compare.tagged(rows, status, F.lit(0), "copies", "copies", names)
    if manual:
        only_a, only_b = (saved(flagged(rows, key), "flagged") for rows in (only_a, only_b))
        for rows, tag, side in ((only_a, tag_a, sides[0]), (only_b, tag_b, sides[1])):
            parts.append(tag(rows.where("_twice"), f"Duplicate key in {side}"))
        only_a, only_b = (rows.where("not _twice").drop("_twice") for rows in (only_a, only_b))
    paired = pairs(only_a, only_b, key)
    parts += [
        tag_a(only_a.join(only_b.select(*key), key, "left_anti"), f"Only in {sides[0]}"),
        tag_b(only_b.join(only_a.select(*key), key, "left_anti"), f"Only in {sides[1]}"),
        compare.surplus(a, b, cmp, sides),
    ]
    unpaired = parts[0]
    for p in parts[1:]:
        unpaired = unpaired.unionByName(p)
    return Keyed(paired, cell_differences(paired, key, names), unpaired)
