"""Queries of the general data operators: packed fields, nested records, drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read
from ..operators import drift, nested, packed

FIELDS = ["q1_context_quotes", "q2_penalty_quotes", "q3_moderation_quotes"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasoning = read(spark, sf_dir, "processed_json").select(F.col("filename").alias("key"), F.col("segments.reasoning").alias("context"), F.col("ingested_at").alias("at"))
    return packed.unpack(read(spark, sf_dir, "golden_dataset_template"), "document_name", FIELDS, reasoning).withColumnRenamed("key", "document_name")


def p2_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.skeletons(read(spark, sf_dir, "golden_dataset_template"), "document_name", FIELDS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.links(read(spark, sf_dir, "extractions"))


def p4_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.penalties(read(spark, sf_dir, "extractions"))


def p4_key_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.key_quotes(read(spark, sf_dir, "extractions"))


def p4_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.factors(read(spark, sf_dir, "extractions"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(read(spark, sf_dir, "extraction_files"), read(spark, sf_dir, "schema_registry"))


def p6_conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.conformed(read(spark, sf_dir, "extraction_files"), read(spark, sf_dir, "schema_registry"))


def p6_path_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.statistics(read(spark, sf_dir, "extraction_files"))


QUERIES = {f.__name__: f for f in (p2_found, p2_skeletons, p4_found, p4_penalties, p4_key_quotes, p4_factors, p6_found, p6_conformed, p6_path_types)}

_PENS = """WITH pens AS (SELECT extraction_id, i - 1 AS penalty_no, p FROM (
  SELECT extraction_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
   SELECT extraction_id, any_value(result.contractual_penalties) AS ps FROM extractions GROUP BY extraction_id)) WHERE p IS NOT NULL),
 quotes AS (SELECT extraction_id, penalty_no, penalty_id, i - 1 AS quote_no, k FROM (SELECT extraction_id, penalty_no, p.penalty_id AS penalty_id,
  unnest(range(1, len(p.moderation_analysis.key_quotes) + 1)) AS i, unnest(p.moderation_analysis.key_quotes) AS k FROM pens) WHERE k IS NOT NULL),
 facts AS (SELECT extraction_id, penalty_no, penalty_id, i - 1 AS factor_no, f FROM (SELECT extraction_id, penalty_no, p.penalty_id AS penalty_id,
  unnest(range(1, len(p.moderation_analysis.factors) + 1)) AS i, unnest(p.moderation_analysis.factors) AS f FROM pens) WHERE f IS NOT NULL)
"""

SQL = {
    "p4_found": _PENS + """SELECT extraction_id, CAST(penalty_no AS INTEGER) AS penalty_no, 'penalty' AS child, -1 AS child_no FROM pens
 UNION ALL SELECT extraction_id, CAST(penalty_no AS INTEGER), 'key_quote', CAST(quote_no AS INTEGER) FROM quotes
 UNION ALL SELECT extraction_id, CAST(penalty_no AS INTEGER), 'factor', CAST(factor_no AS INTEGER) FROM facts""",
    "p4_penalties": _PENS + """SELECT extraction_id, CAST(penalty_no AS INTEGER) AS penalty_no, p.penalty_id AS penalty_id, p.related_claim_ref AS related_claim_ref,
 p.breach_type.value AS breach_type, p.rate_definition.type AS rate_type, p.rate_definition.value_raw AS rate_value_raw, p.amounts.currency AS currency,
 p.amounts.secured_principal.value AS secured_principal, p.amounts.original_claimed.value AS original_claimed, p.amounts.final_awarded.value AS final_awarded,
 p.associated_interest.awarded AS interest_awarded, p.associated_interest.rate_value AS interest_rate, p.moderation_analysis.decision.value AS decision,
 p.moderation_analysis.decision.dismissal_reason AS dismissal_reason, p.moderation_analysis.legal_reasoning_summary AS legal_reasoning_summary FROM pens""",
    "p4_key_quotes": _PENS + "SELECT extraction_id, CAST(penalty_no AS INTEGER) AS penalty_no, penalty_id, CAST(quote_no AS INTEGER) AS quote_no, k.quote AS quote, k.chunk_id AS chunk_id FROM quotes",
    "p4_factors": _PENS + """SELECT extraction_id, CAST(penalty_no AS INTEGER) AS penalty_no, penalty_id, CAST(factor_no AS INTEGER) AS factor_no, f.label AS label,
 f.sentiment AS sentiment, f.evidence.quote AS quote, f.evidence.chunk_id AS chunk_id FROM facts""",
}
