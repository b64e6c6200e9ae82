"""Nested records to flat tables that keep parent-child links.

One projection per target table: nested ``transform`` calls attach the ancestor's key and the
array indices, ``flatten`` joins the arrays, and a single ``inline`` emits the rows. No shuffle is
needed to flatten; only the removal of redelivered records shuffles, and it shuffles flat rows.

Edge cases: null or empty arrays, null elements and null structs give no rows, but null elements
count in the index; repeated or missing ``penalty_id`` values are kept as they are, the link is the
index; a record delivered again gives its rows once; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PENS = "coalesce(result.contractual_penalties, array())"

#: per table: SQL of the array of structs that one penalty ``p`` with index ``i`` gives
_LINKS = """
 CASE WHEN p IS NULL THEN array() ELSE concat(
  array(named_struct('penalty_no', i, 'child', 'penalty', 'child_no', -1)),
  filter(transform(coalesce(p.moderation_analysis.key_quotes, array()), (k, j) -> CASE WHEN k IS NOT NULL THEN
    named_struct('penalty_no', i, 'child', 'key_quote', 'child_no', j) END), x -> x IS NOT NULL),
  filter(transform(coalesce(p.moderation_analysis.factors, array()), (f, j) -> CASE WHEN f IS NOT NULL THEN
    named_struct('penalty_no', i, 'child', 'factor', 'child_no', j) END), x -> x IS NOT NULL)) END"""

_PENALTY = """
 CASE WHEN p IS NULL THEN array() ELSE array(named_struct(
  'penalty_no', i, 'penalty_id', p.penalty_id, 'related_claim_ref', p.related_claim_ref,
  'breach_type', p.breach_type.value, 'rate_type', p.rate_definition.type, 'rate_value_raw', p.rate_definition.value_raw,
  'currency', p.amounts.currency, 'secured_principal', p.amounts.secured_principal.value,
  'original_claimed', p.amounts.original_claimed.value, 'final_awarded', p.amounts.final_awarded.value,
  'interest_awarded', p.associated_interest.awarded, 'interest_rate', p.associated_interest.rate_value,
  'decision', p.moderation_analysis.decision.value, 'dismissal_reason', p.moderation_analysis.decision.dismissal_reason,
  'legal_reasoning_summary', p.moderation_analysis.legal_reasoning_summary)) END"""

_QUOTES = """
 filter(transform(coalesce(p.moderation_analysis.key_quotes, array()), (k, j) -> CASE WHEN k IS NOT NULL THEN
  named_struct('penalty_no', i, 'penalty_id', p.penalty_id, 'quote_no', j, 'quote', k.quote, 'chunk_id', k.chunk_id) END), x -> x IS NOT NULL)"""

_FACTORS = """
 filter(transform(coalesce(p.moderation_analysis.factors, array()), (f, j) -> CASE WHEN f IS NOT NULL THEN
  named_struct('penalty_no', i, 'penalty_id', p.penalty_id, 'factor_no', j, 'label', f.label, 'sentiment', f.sentiment,
   'quote', f.evidence.quote, 'chunk_id', f.evidence.chunk_id) END), x -> x IS NOT NULL)"""


def _emit(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    flat = df.selectExpr("extraction_id", f"inline(flatten(transform({_PENS}, (p, i) -> {body})))")
    return flat.dropDuplicates(["extraction_id", *keys])


def links(df: DataFrame) -> DataFrame:
    """(extraction_id, penalty_no, child, child_no): every penalty, key quote and factor with its place."""
    return _emit(df, _LINKS, ["penalty_no", "child", "child_no"])


def penalties(df: DataFrame) -> DataFrame:
    """One row per non-null penalty with its scalar members and those of its moderation analysis."""
    return _emit(df, _PENALTY, ["penalty_no"])


def key_quotes(df: DataFrame) -> DataFrame:
    """One row per non-null key quote, naming record and penalty."""
    return _emit(df, _QUOTES, ["penalty_no", "quote_no"])


def factors(df: DataFrame) -> DataFrame:
    """One row per non-null factor, naming record and penalty."""
    return _emit(df, _FACTORS, ["penalty_no", "factor_no"])


def tables(df: DataFrame) -> dict[str, DataFrame]:
    """All target tables by name."""
    return {"penalties": penalties(df), "key_quotes": key_quotes(df), "factors": factors(df)}


def summary(df: DataFrame) -> DataFrame:
    """Rows per child kind, a check that no child was lost."""
    return links(df).groupBy("child").agg(F.count("*").alias("n_rows"), F.countDistinct("extraction_id").alias("n_records"))
