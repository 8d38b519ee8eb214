"""The pipeline's stages, each against its own operator or brute force on the same input."""

import corpus_pipeline as pipeline
from rowproof.llm import linededup, mixing, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "SimHash near-dedup", "mixing", "BPE"]

    def step(name, df):
        out = stages[name](spark, df, DATA)
        assert name == "BPE" or out.columns == docs.columns
        return out.cache()

    clean = step("toxicity", docs)
    rejected = {r.doc_id for r in toxicity.classified(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == rejected
    lines = step("line dedup", clean)
    want = {r.doc_id: r.text for r in linededup.cleaned(clean, "source", "text").collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    alone = step("SimHash near-dedup", lines)
    fps = sorted((r.doc_id, simhash.fingerprint(r.text.encode())) for r in lines.collect())
    root = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            least = min(root[j] for j, g in fps if (f ^ g).bit_count() <= 4)
            if least < root[i]:
                root[i], changed = least, True
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, r in root.items() if i == r)
    mixed = step("mixing", alone)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in mixing.report(alone).where("kept").collect()}
    assert step("BPE", mixed).count() == mixed.count()


def test_run(spark):
    out = pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_carry_extra_columns_with_clashing_names(spark):
    names = ["score", "n_lines", "n_dropped", "_host", "_bad", "_lines", "_kept", "_cell", "_tokens", "_p", "_of", "least", "n", "fp", "component_id", "root"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").selectExpr("*", *(f"'mine' as `{n}`" for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.count() and {tuple(r) for r in docs.select(*names).distinct().collect()} == {("mine",) * len(names)}, name
    assert pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
