"""The golden example, multiset identities and difference statuses."""

import random

import pytest
from pyspark.sql import functions as F

from rowproof.functions.cells import with_hash
from rowproof.operators import columns, compare, differences, keys
from rowproof.plans.reconcile import reconcile
from rowproof.settings import Settings

HEADERS = ["CUST_ID", "NAME", "AMOUNT"]


def sides(spark, a, b, n=None):
    n = n or len(a[0])
    schema = ", ".join(f"c{i} string" for i in range(1, n + 1))
    return [with_hash(spark.createDataFrame(rows, schema)) for rows in (a, b)]


def test_counts_are_multiset_counts(spark):
    a, b = sides(spark, [("1", "a")] * 3 + [("2", "b")], [("1", "a"), ("2", "b")])
    m = compare.metrics(compare.counts(a, b)).first()
    assert (m.matched_rows, m.only_a, m.only_b, m.extra_a, m.extra_b, m.distinct_a, m.distinct_b) == (2, 0, 0, 2, 0, 2, 2)
    assert m.match_rate == 50.0


def test_identities_hold_on_random_tables(spark):
    rng = random.Random(3)
    for _ in range(3):
        a, b = ([(rng.choice("xyz"), rng.choice(["", " ", "1"])) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        da, db = sides(spark, a, b)
        m = compare.metrics(compare.counts(da, db)).first()
        assert m.rows_a == len(a) == m.matched_rows + m.only_a + m.extra_a
        assert m.rows_b == len(b) == m.matched_rows + m.only_b + m.extra_b
        assert compare.multiset_except(da, db).count() == m.only_a + m.extra_a
        swapped = compare.metrics(compare.counts(db, da)).first()
        assert (swapped.only_a, swapped.extra_b) == (m.only_b, m.extra_a)


def test_hash_is_injective_over_cell_borders(spark):
    rows = with_hash(spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc"), ("é", ""), ("", "é")], "c1 string, c2 string"))
    assert rows.select("h").distinct().count() == 5


A = [("101", "Ann", "10"), ("102", "Bob", "20"), ("103", "Cy", "30"), ("103", "Cy", "30"), ("104", "Di", "40"), ("107", "Gus", "70")]
B = [("101", "Ann", "11"), ("102", "Bob", "20"), ("103", "Cy", "30"), ("104", "Dee", "40"), ("105", "Eve", "50")]


def test_detected_key_pairs_and_differences(spark):
    a, b = sides(spark, A, B)
    r = reconcile(a, b, HEADERS, Settings(key_min_overlap=0.6))
    assert r.overall == "MISMATCH" and r.key.names == ["CUST_ID"] and r.key.source == "detected"
    assert r.counts == {"Only in A": 1, "Only in B": 1, "Extra copies in A": 1, "Paired records": 2, "Differing cells": 2}
    cells = {(d.c1, d.pos, d.b_val, d.a_val) for d in r.differences.collect()}
    assert cells == {("101", 3, "11", "10"), ("104", 2, "Dee", "Di")}
    assert r.paired_differing == {2: 1, 3: 1}


def test_without_a_key_all_differences_are_rows(spark):
    a, b = sides(spark, A, B)
    r = reconcile(a, b, HEADERS, Settings(key_mode="none"))
    assert r.mismatches.count() == 3 + 3 + 1
    extra = r.mismatches.where("status like 'Extra%'").first()
    assert (extra.a_copies, extra.b_copies, extra.unmatched_copies, extra.c1) == (2, 1, 1, "103")


def test_manual_key_sets_duplicates_aside(spark):
    a, b = sides(spark, [("1", "a", "10"), ("1", "b", "20"), ("2", "c", "30")], [("1", "a", "11"), ("2", "c", "31")])
    found = differences.keyed(a, b, compare.counts(a, b), ["c1"], True)
    got = sorted((r.status, r.c1, r.c2) for r in found.unpaired.collect())
    # The lone row of B finds its partners set aside, and is on one side only.
    assert got == [("Duplicate key in A", "1", "a"), ("Duplicate key in A", "1", "b"), ("Only in B", "1", "a")]
    assert [(d.c1, d.pos) for d in found.differences.collect()] == [("2", 3)]


def test_match_and_invalid_key(spark):
    a, b = sides(spark, A, A)
    assert reconcile(a, b, HEADERS).overall == "MATCH"
    r = reconcile(a, b, HEADERS, Settings(key_overrides={"P": ["NOPE"]}), prefix="p")
    assert r.overall == "ERROR" and "in no column" in r.message
    assert reconcile(a, b, HEADERS, Settings(key_overrides={"p": None}), prefix="P").key.positions == []


def test_combination_key(spark):
    rows = [(str(i), str(j), f"v{i}{j}"[:2]) for i in range(6) for j in range(6)]
    a, b = sides(spark, rows, [(i, j, v + ("x" if i == "0" else "")) for i, j, v in rows])
    r = reconcile(a, b, ["X", "Y", "V"])
    assert r.key.names == ["X", "Y"] and r.counts["Differing cells"] == 6


def test_keys_by_hand_are_looked_up_as_written():
    place = lambda name, written, shown=None: keys.Headers(written, shown or written).place(name)
    assert place(" cust_id ", ["CUST_ID", "B"]) == 1
    assert place("AMOUNT (USD)", ["ID", "AMOUNT (USD)"]) == 2
    with pytest.raises(LookupError, match="in no column"):
        place("amount", ["ID", "AMOUNT (USD)"])
    with pytest.raises(LookupError, match="in columns 1, 2"):
        place("a", ["A", "a "], ["A (1)", "a (2)"])
    assert place("A (2)", ["A", "a "], ["A (1)", "a (2)"]) == 2
    assert keys.hinted("order_id") and keys.hinted("ID") and not keys.hinted("IDEA")


def test_empty_sides(spark):
    a, b = sides(spark, [("1", "a")], [("1", "a")])
    none = a.where("false")
    m = compare.metrics(compare.counts(none, none)).first()
    assert (m.matched_rows, m.match_rate) == (0, 0.0)
    assert reconcile(a, none, ["X", "Y"]).overall == "MISMATCH"


@pytest.mark.parametrize("cells,label", [(["1", "-2", ""], "Integer-like"), (["1.5", ".5", "2."], "Decimal-like"), (["1", "x"], "Mixed"), (["", ""], "Empty"), (["10\n", "2020-01-01"], "Text")])
def test_labels(spark, cells, label):
    side = with_hash(spark.createDataFrame([(c,) for c in cells], "c1 string"))
    assert columns.shapes(side).first().label == label


def test_rows_of_a_hot_key_are_dealt_out(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("c1"), F.col("id").cast("string").alias("c2"))
    rows = rows.unionByName(spark.createDataFrame([("20", "x"), ("30", "y")], "c1 string, c2 string"))
    want = {("hot", True): 27_000, ("20", True): 2, ("30", True): 2}
    try:
        for n, v in zip(names, ("false", "-1")):
            spark.conf.set(n, v)
        got = differences.flagged(rows, ["c1"]).withColumn("p", F.spark_partition_id())
        sizes = [r["n"] for r in got.groupBy("p").agg(F.count("*").alias("n")).collect()]
        twice = {(r.c1, r._twice): r["n"] for r in got.where("_twice").groupBy("c1", "_twice").agg(F.count("*").alias("n")).collect()}
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert twice == want and len(sizes) > 2 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_all_key_sets_are_counted_at_once_as_one_by_one(spark):
    rows = [(str(i % 4), str(i % 6), str(i % 5)) for i in range(60)]
    a, b = sides(spark, rows, [(x, y, z if x != "1" else z + "0") for x, y, z in rows])
    sets = [["c1", "c2"], ["c1", "c3"], ["c1", "c2", "c3"]]
    at_once = {r.number: r for r in keys.set_stats(a, b, sets).collect()}
    for i, s in enumerate(sets):
        one = keys.tuple_stats(a, b, s).first()
        assert (at_once[i].a_distinct, at_once[i].b_distinct, at_once[i].common, at_once[i].overlap) == tuple(one)
