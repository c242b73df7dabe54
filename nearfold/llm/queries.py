"""The operators of this folder applied to their whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import bpe, brown, decontaminate, keyed, minhash, passages, pii, quality, shuffled, warc
from nearfold.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_keyed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.write_shards(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.write_archives(table(spark, sf_dir, "pages"))
    return records.select("page_id", "url", "warc_type", "payload_digest", "n_bytes", "original_page_id", "original_url")


OP4_SQL = """
WITH c AS (SELECT DISTINCT page_id, url, sha1(html) AS payload_digest, strlen(html) AS n_bytes FROM pages WHERE html IS NOT NULL),
f AS (SELECT *, first_value(page_id) OVER w AS original_page_id, first_value(url) OVER w AS original_url, row_number() OVER w AS nth FROM c
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, url, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS warc_type, payload_digest, n_bytes, original_page_id, original_url FROM f
"""


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op6_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled.write_shuffled(table(spark, sf_dir, "documents"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.accepted(docs).select("doc_id", "lang", "source", "n_chars", "distance")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_brown_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


#: Brute force: all pairs that share a shingle, their Jaccard similarity, and the components by recursion.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_have AS MATERIALIZED (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2
), near AS MATERIALIZED (
  SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 5 >= (x.n + y.n - c) * 3
), edges AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
  SELECT DISTINCT doc_id AS node, doc_id AS label FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node AND e.b > r.label
)
SELECT doc_id, group_id, doc_id = group_id AS kept FROM (SELECT node AS doc_id, min(label) AS group_id FROM reach GROUP BY node)
QUALIFY count(*) OVER (PARTITION BY group_id) > 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_leaks": op2_leaks,
    "op3_keyed_ids": op3_keyed_ids,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_shuffled_shards": op6_shuffled_shards,
    "op7_private_data": op7_private_data,
    "op8_quality_kept": op8_quality_kept,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_brown_perplexity": op10_brown_perplexity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": OP1_SQL,
    "op4_warc_revisits": OP4_SQL,
}
