"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sheetscope.llm import (
    decontaminate,
    extendible,
    hard_negatives,
    jaccard,
    lattice,
    line_runs,
    mixing,
    quality,
    secret_scan,
    sentence_spans,
    suffixes,
    toxicity,
    turn_repair,
)
from sheetscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under ``name``."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


# A-Z alone lower-cased, as DuckDB has no such function.
LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE_SQL = rf"""
WITH word_lists AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, list_slice(words, i, i + least(len(words), 10) - 1) AS win
  FROM items, range(1, greatest(len(words) - 10, 0) + 2) AS r(i) WHERE len(words) > 0
), starts AS (
  SELECT doc_id, n, i, list_slice(words, i, i + n - 1) AS win
  FROM word_lists, (SELECT DISTINCT n FROM windows), range(1, len(words) + 1) AS r(i) WHERE i + n - 1 <= len(words)
), found AS (
  SELECT doc_id, item, i, s.n FROM starts s JOIN windows w ON s.win = w.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, range(i, i + n) AS r(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM word_lists LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontaminate", DECONTAMINATE_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {LOWERED.format("text")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


@query("op2_exact_dedup", EXACT_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.exact_duplicates(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, (SELECT sum(size) FROM d) - coalesce(sum(cap) OVER before, 0) AS rest, sum(weight) OVER at_on AS remaining
  FROM w WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    at_on AS (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), full_sources AS (
  SELECT *, bool_and(cap * remaining <= weight * rest) OVER (ORDER BY cap / weight, k) AS is_full FROM r
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    CAST(weight * ((SELECT sum(size) FROM d) - coalesce((SELECT sum(cap) FROM full_sources WHERE is_full), 0)) AS DOUBLE)
    / CAST((SELECT sum(weight) FROM full_sources WHERE NOT is_full) AS DOUBLE) END AS target
  FROM full_sources
), p AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS flow FROM t
), o AS (
  SELECT d.*, p.source_size, p.target, flow // greatest(source_size, 1) AS whole, flow % greatest(source_size, 1) AS rest,
    md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), text)) AS place
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM o
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN done + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""


@query("op10_mix_sources", MIX_SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentence_spans.drop_repeated_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_sentences", "n_removed", "removed_words", "row.text")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_report(table(spark, sf_dir, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op7_secret_scan", secret_scan.secrets_sql())
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_report(table(spark, sf_dir, "documents"))


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.language_report(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_report(table(spark, sf_dir, "documents"))


@query("op11_line_dedup", line_runs.lines_sql())
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.lines_report(table(spark, sf_dir, "documents"))


@query("op12_turn_repair")
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))


@query("op13_hard_negatives", hard_negatives.negatives_sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negatives_report(table(spark, sf_dir, "embeddings"))
