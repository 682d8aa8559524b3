"""The registered queries of this subpackage: each applies its operator to its whole table; and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import importable
from veldt.llm.jaccard import jaccard_components
from veldt.llm.line_dedup import line_dedup
from veldt.llm.media import media_columns
from veldt.llm.mixing import mix_sources
from veldt.llm.packing import pack_documents
from veldt.llm.quality_classifier import classify, page_sites
from veldt.llm.quality_rules import quality_rules
from veldt.llm.sharding import shard_documents
from veldt.llm.suffix_dedup import suffix_dedup
from veldt.llm.tokens import token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = page_sites(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), labels, sites).drop("lang", "source")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir).select("doc_id", "text"), k=4, percent=85)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are taken from the media and pixel arrays that the operator writes."""
    stored = media_columns(documents(spark, sf_dir).select("doc_id", "text"))
    return stored.select(
        "doc_id", "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature", "coding", "height", "width",
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return judged.drop("lang")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_jaccard_join, op3_media_columns, op4_mix_sources, op5_token_counts, op6_suffix_dedup, op7_best_fit_packing, op8_sharding, op9_quality_rules, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": OP4_SQL, "op10_line_dedup": OP10_SQL}


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM totals),
weighted AS (
  SELECT *, ([3.0, 1.0, 2.0])[(rk % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS most FROM ranked),
leveled AS (
  SELECT *, most / w AS ratio,
         (1.5 * (SELECT sum(source_size) FROM totals)::DOUBLE
            - coalesce(sum(most) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted),
lev AS (SELECT level FROM leveled WHERE ratio > level ORDER BY ratio, rk LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN (SELECT level FROM lev) IS NULL OR ratio <= (SELECT level FROM lev) THEN most ELSE (SELECT level FROM lev) * w END AS target
  FROM leveled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS full_times FROM targets),
cum AS (
  SELECT s.*, b.source_size, b.target, b.full_times, b.target - b.full_times * b.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
ends AS (
  SELECT source, min(h) AS h FROM cum WHERE upto > budget GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target,
       c.size * (c.full_times + CASE WHEN e.h IS NULL OR c.h < e.h OR (c.h = e.h AND c.upto - c.budget <= c.budget - (c.upto - c.own)) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM cum c LEFT JOIN ends e ON c.source IS NOT DISTINCT FROM e.source
"""

OP10_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, id, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT id) >= 3),
marked AS (
  SELECT y.*, s.k IS NOT NULL AND y.id < s.keeper AS gone FROM keyed y LEFT JOIN shared s ON y.k = s.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
