"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of docs; the last returns the tokens of each document.

Defined cases, the same in every stage: a null text counts as empty (toxicity scores it by the intercept alone, line dedup leaves it null, SimHash links it with other texts
without words, mixing gives it one token, BPE no tokens); null ids, sources and languages are values like any other, so that no row is lost for them; repeated rows
are documents of their own until SimHash near-dedup, where one of a group stays; texts of any length are read whole; extra columns are carried up to the last stage, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import bpe, linededup, mixing, simhash, toxicity
from rowproof.llm.common import small_batches, table, unused
from rowproof.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, by scores of THRESHOLD or more; the labels of the held-out fold are never learned from. Without labels of both kinds the score is the base rate."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (name,) = unused(docs, "score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share go, equal texts counting once; n_chars follows the text. A document that loses all lines stays, with the empty text."""
    clean = linededup.cleaned(docs, "source", "text", counts=False)
    return clean.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest id; of rows without an id only a group without other ids keeps one."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their calibrated probabilities, to a budget of half of the tokens: the share of a rare value is clipped and costs others nothing."""
    return mixing.sampled(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the hashes of ids and decoded text."""
    small_batches(spark)
    return bpe.digests(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("BPE", tokenize),
]

#: A trained classifier and a hash fingerprint have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
