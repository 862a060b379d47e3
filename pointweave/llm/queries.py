"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import divergence, leaderboard, secrets
from pointweave.llm.common import scratch_path, table
from pointweave.llm.decontamination import benchmark_leaks
from pointweave.llm.jaccard import jaccard_components
from pointweave.llm.licenses import license_digest, license_scan
from pointweave.llm.line_dedup import duplicate_lines
from pointweave.llm.mixing import mixed_stream
from pointweave.llm.quality_model import score, train
from pointweave.llm.quality_rules import quality_rules
from pointweave.llm.sharding import shard_digest, shuffle_into_shards
from pointweave.llm.url_filter import url_filter
from pointweave.llm.warc import read_warc, write_warc


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.secret_scan(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(shuffle_into_shards(table(spark, sf_dir, "documents")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_stream(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return duplicate_lines(docs).select("doc_id", F.size("removed").alias("n_removed"), "removed")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.leaderboard_changes(*(table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality_model, op2_secret_scan, op3_sharding, op4_url_filter, op5_quality_rules, op6_mixing, op7_warc, op8_line_dedup, op9_jaccard_join, op10_decontamination, op11_source_divergence, op12_leaderboard, op13_license_scan, pipeline)
    return {f.__name__: f for f in every}


#: Digests of equal payloads only need a hash in SQL: base32 of SHA-1 in five-bit groups of its hexadecimal form.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n),
b AS (SELECT h, list_reduce(list_prepend('', list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (('0x' || substr(h || '0', (1 + i // 4)::INT, 2))::INT // (8 >> (i % 4)::INT) % 32)::INT, 1))), lambda x, y: x || y) AS digest FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h, n) JOIN b USING (h)"""

#: Pages link to no other page by canonical or refresh tags in these tables, so classes are the page keys.
URL_SQL = r"""
WITH u AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, host, path, host || regexp_replace(path, '/$', '') || '?' || regexp_replace(regexp_replace(q, '(?i)(^|&)(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '', 'g'), '^&', '') AS k,
  (SELECT max_by(rh || rp || ' ' || verdict, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM h)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule, CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2)
  WHEN host <> '' AND bool_or(best LIKE '% block') OVER (PARTITION BY k) AND NOT bool_or(coalesce(best, '') LIKE '% allow') OVER (PARTITION BY k) THEN 'block' ELSE 'allow' END AS verdict FROM m"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets.oracle(), "op4_url_filter": URL_SQL, "op7_warc": WARC_SQL, "op11_source_divergence": divergence.SQL, "op12_leaderboard": leaderboard.SQL}
