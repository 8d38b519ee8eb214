"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowproof.llm import ballkmeans, bpe, gif, htmlcrf, licenses, linededup, mixing, multiindex, periodic, quotes, simhash, toxicity, warc
from rowproof.llm.common import small_batches, table
from rowproof.session import spread

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.as_mail(table(spark, sf_dir, "conversations")))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return multiindex.links(table(spark, sf_dir, "embeddings"))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return gif.digests(spread(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.groups(spread(table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(spread(table(spark, sf_dir, "documents")), VOCABULARY)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.cleaned(pages, "source", "text", each_copy=True)  # as the SQL


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.classified(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op10_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return htmlcrf.extracted(spread(table(spark, sf_dir, "pages")))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.codes(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotes": op1_quotes,
    "op2_multi_index": op2_multi_index,
    "op3_gif": op3_gif,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_html_crf": op10_html_crf,
    "op11_licenses": op11_licenses,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_quotes": quotes.SQL,
    "op4_mixing": mixing.oracle(),
    "op6_warc": f"""
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, url, octet_length(b) AS n, sha256(b) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST, url NULLS FIRST) AS place FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= {warc.MIN_REVISIT} AND least IS NOT NULL AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= {warc.MIN_REVISIT} AND least IS NOT NULL AND place > 1 THEN least END AS refers_to, url
        FROM f""",
    "op8_line_dedup": linededup.SQL,
    "op11_licenses": licenses.oracle(),
    "op12_ball_kmeans": ballkmeans.oracle(),
}
