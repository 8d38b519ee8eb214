"""The sample's size is a stated budget, which a rare value does not shrink."""

from rowproof.llm import mixing


def test_one_dirty_row_leaves_the_sample_its_size(spark):
    rows = [(i, f"text {i} " * 20, ("en", "de")[i % 5 == 0], ("a", "b", "c")[i % 3]) for i in range(20_000)]
    kinds = "doc_id long, text string, lang string, source string"
    clean = spark.createDataFrame(rows, kinds)
    dirty = clean.unionByName(spark.createDataFrame([(20_000, "x", "en", None), (20_001, "x", None, "a")], kinds))
    for d in (clean, dirty):
        r = mixing.report(d).collect()
        tokens = sum(x.tokens for x in r)
        assert abs(sum(x.tokens * x.p for x in r) / tokens - mixing.BUDGET) < 1e-6
        assert abs(sum(x.tokens for x in r if x.kept) / tokens - mixing.BUDGET) < 0.02
        assert mixing.sampled(d).count() == sum(x.kept for x in r)
    short = {(r.source, r.lang): r for r in mixing.shortfalls(dirty).collect()}
    assert set(short) == {("(none)", "en"), ("a", "(none)")} and all(r.shortfall > 0 for r in short.values())
    assert mixing.shortfalls(clean).count() == 0


def test_scale_meets_the_budget_with_clipped_and_weightless_cells(spark):
    cells = spark.createDataFrame([("a", 10.0, 500.0), ("b", 100.0, 300.0), ("c", 1000.0, 310.0), ("d", 90.0, 0.0)], "source string, tokens double, weight double")
    for budget in (0.01, 0.1, 0.5, 0.9):
        scale = mixing.scale_for(cells, budget)
        assert abs(sum(min(r.tokens, scale * r.weight) for r in cells.collect()) - budget * 1200) < 1e-6
    scale = mixing.scale_for(cells, 1.0)  # more than the cells with a weight hold
    assert all(scale * r.weight >= r.tokens * (1 - 1e-9) for r in cells.collect() if r.weight)
