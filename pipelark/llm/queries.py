"""The registered queries of the corpus operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts, url_filter
from .batches import spread

#: The production vocabularies.
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


#: The production rules for URLs; patterns block what no rule decides.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
URL_BLOCKED = [f"{host}{end}" for host in ("*spam*", "*pills*", "*casino*", "ads-*", "*.ads-*") for end in ("", "/**")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of all documents, for operators that work on texts in Python."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base limits and verdict of every text."""
    report = quality_rules.quality_report(_texts(spark, sf_dir))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text, as digests."""
    path = public_tokenizers.path(PIECES)
    docs = _texts(spark, sf_dir)
    both = sentencepiece_codec.encode(docs, path, decoded="decoded", keep_text=False)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES, URL_BLOCKED).select("page_id", "host", "path", "rule", "verdict")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    found = simhash.near_duplicates(_texts(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whether it holds a test item, which one most of all, and how much of it."""
    docs = _texts(spark, sf_dir)
    marked = decontamination.leaks(docs, _table(spark, sf_dir, "benchmark"))
    best = F.get("leaks", F.lit(0))
    return marked.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        best["item_id"].alias("item_id"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every text go, and a digest of what stays."""
    docs = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, in 24 shards whose counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    dealt = sharding.shard(rows, 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that an earlier one has."""
    found = substring_dedup.substring_dedup(_texts(spark, sf_dir))
    return found.select("doc_id", (F.col("n_removed") > 0).alias("changed"), "n_sentences", "n_removed", "text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every text."""
    return quality_classifier.quality_scores(_texts(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, and how much of it a budget of 512 tokens holds."""
    docs = _texts(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.token_budget(docs, public_tokenizers.path(BYTES), budget=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_url_filter": op3_url_filter,
        "op4_simhash": op4_simhash,
        "op5_decontamination": op5_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_sharding": op7_sharding,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_token_counts": op10_token_counts,
        "pipeline": corpus_pipeline.run,
    }


_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN contains(host, 'spam') OR contains(host, 'pills') OR contains(host, 'casino') OR starts_with(host, 'ads-') OR contains(host, '.ads-') THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

OP6_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split
), keyed AS (
  SELECT *, translate(trim(line, {_BLANK}), {_AZ}) AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op6_line_dedup": OP6_SQL}
