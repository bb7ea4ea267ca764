"""The queries of this subpackage over the driver's tables, beside their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.llm.common import n_words
from binflow.llm.compact_windows import repeated_passages
from binflow.llm.compression_quality import score_quality
from binflow.llm.filter_audit import SQL as AUDIT_SQL
from binflow.llm.filter_audit import audit_filters
from binflow.llm.language_id import identify
from binflow.llm.license_scan import scan_licenses
from binflow.llm.line_dedup import dedup_lines
from binflow.llm.ngram_join import near_components
from binflow.llm.perplexity import judge
from binflow.llm.phrase_mining import SQL as PHRASES_SQL
from binflow.llm.phrase_mining import mine_phrases
from binflow.llm.pivotal_mix import mix_sources
from binflow.llm.simhash_trees import near_fingerprints
from binflow.llm.spaced_seed import contaminated
from binflow.llm.url_filter import judge_urls
from binflow.llm.url_filter import oracle_sql as url_sql

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
b AS (SELECT DISTINCT item_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
bw AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM b WHERE len(w) >= 11),
equal AS (SELECT DISTINCT doc_id, item_id, dw.pos - bw.pos AS diagonal, dw.pos AS pos FROM dw JOIN bw USING (word)),
stretch AS (
  SELECT doc_id, item_id, pos, count(*) OVER w AS n, max(pos) OVER w AS last
  FROM equal WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING))
SELECT doc_id, item_id, CAST(min(pos) AS INTEGER) AS first_word, CAST(max(last) AS INTEGER) AS last_word, CAST(max(n) AS INTEGER) AS most_equal
FROM stretch WHERE n >= 11 GROUP BY doc_id, item_id
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"
    )


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), n_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(_table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_compression_quality": op2_compression_quality,
    "op3_spaced_seeds": op3_spaced_seeds,
    "op4_ngram_join": op4_ngram_join,
    "op5_perplexity": op5_perplexity,
    "op6_compact_windows": op6_compact_windows,
    "op7_pivotal_mix": op7_pivotal_mix,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_simhash_trees": op12_simhash_trees,
    "op13_phrase_mining": op13_phrase_mining,
}
ORACLES: dict[str, str] = {
    "op3_spaced_seeds": OP3_SQL,
    "op9_url_filter": url_sql(),
    "op10_line_dedup": OP10_SQL,
    "op11_filter_audit": AUDIT_SQL,
    "op13_phrase_mining": PHRASES_SQL,
}
