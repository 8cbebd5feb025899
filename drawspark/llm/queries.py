"""The queries of this subpackage, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, ngram_join, packing, pii, quality, sharding, token_counts, topk, toxicity, warc
from .common import free_name, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.classify(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"))))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = free_name(documents, "n_pseudonyms")
    return pii.pseudonymise(documents, found_col=found).select("doc_id", "text", F.col(found).alias("n_pseudonyms"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages")))
    headers = [F.col("headers")[h].alias(h.replace("-", "_")) for h in ("content-type", "content-length", "server", "date", "expires")]
    return resolved.select("record_id", "canonical_url", "outcome", "response_id", *headers)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_pii_pseudonyms, op4_mixing, op5_ngram_join, op6_sharding, op7_warc_revisits, op8_quality, op9_packing, op10_topk)}


WORDS = r"[^\x20\x09-\x0D]+"

OP7 = """
WITH p AS (SELECT page_id, url, md5(html) AS digest, strlen(html) AS bytes, 1600000000 + page_id * 600 AS t,
    CASE WHEN page_id % 5 <> 0 THEN 'day ' || (page_id % 97) END AS modified FROM pages),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS x FROM p),
cut AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(x, '^[^/?]*')), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(x, '^[^?]*\\?(.*)$', 1), '&'), lambda v: v <> '' AND NOT starts_with(v, 'utm_'))) AS params FROM bare),
c AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM cut),
full_ AS (SELECT page_id * 4 AS record_id, canonical_url, t AS ts, substr(digest, 1, 16) AS etag, modified, bytes, page_id FROM c),
revisit AS (
    SELECT page_id * 4 + 1 AS record_id, canonical_url, t + 300 AS ts, CASE WHEN page_id % 7 = 0 THEN 'new' ELSE substr(digest, 1, 16) END AS etag, NULL AS modified, (t + 300)::VARCHAR AS date, (t + 900)::VARCHAR AS expires FROM c
    UNION ALL SELECT page_id * 4 + 2, canonical_url, t - 300, NULL, modified, (t - 300)::VARCHAR, NULL FROM c),
best AS (SELECT r.*, f.record_id AS f_id, f.etag AS f_etag, f.modified AS f_modified, f.bytes, f.page_id,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS k
    FROM revisit r LEFT JOIN full_ f ON r.canonical_url = f.canonical_url AND f.ts < r.ts),
judged AS (SELECT *, CASE WHEN f_id IS NULL THEN 'unmatched'
    WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN etag <> f_etag THEN 'changed' ELSE 'resolved' END
    WHEN modified IS NOT NULL AND f_modified IS NOT NULL AND modified <> f_modified THEN 'changed' ELSE 'resolved' END AS outcome FROM best WHERE k = 1)
SELECT record_id, canonical_url, outcome, f_id AS response_id,
    CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN outcome = 'resolved' THEN bytes::VARCHAR END AS content_length,
    CASE WHEN outcome = 'resolved' THEN 's' || (page_id % 3) END AS server, CASE WHEN outcome = 'resolved' THEN date END AS date,
    CASE WHEN outcome = 'resolved' THEN expires END AS expires FROM judged
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_revisits": OP7, "op10_topk": OP10}
