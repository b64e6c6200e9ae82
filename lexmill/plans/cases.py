"""Queries of extraction records and the case base, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read
from ..functions.catalog import DECISION_LABELS, FACTOR_LABELS, FACTOR_NAMES
from ..operators import casebase as C
from ..operators import extraction as X
from ..operators import nested
from ..sources import io
from .data_quality import _PENS

INTENT = C.Intent(contract_type="dielo", breach_type="late_payment", decision="moderated_301", factors=("dobre_mravy", "pomer_k_istine"), amount=50_000.0)


def _records(s: SparkSession, d: str) -> DataFrame:
    return C.penalties(read(s, d, "extractions"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "processed_json").groupBy(F.col("filename").alias("source_file")).agg(F.max_by("reasoning_full", "ingested_at").alias("text"))


def j6_evidence(s: SparkSession, d: str) -> DataFrame:
    return X.evidence(read(s, d, "extractions"))


def j8_grounding(s: SparkSession, d: str) -> DataFrame:
    return X.grounded(X.evidence(read(s, d, "extractions")), X.lookup(read(s, d, "chunks"), read(s, d, "processed_json")))


def j10_repaired(s: SparkSession, d: str) -> DataFrame:
    return X.repaired(j8_grounding(s, d))


def j11_checks(s: SparkSession, d: str) -> DataFrame:
    return X.checks(read(s, d, "extractions"))


def j11_currency(s: SparkSession, d: str) -> DataFrame:
    return X.currency_doubts(read(s, d, "extractions"), _texts(s, d))


def j1_merged_calls(s: SparkSession, d: str) -> DataFrame:
    """Facts of every record joined with the moderation given to the same penalty id in it; repeated ids take the last."""
    p = nested.penalties(read(s, d, "extractions")).withColumnRenamed("extraction_id", "doc")
    facts = p.select("doc", "penalty_no", "penalty_id")
    return X.merged_calls(facts, p.where("decision IS NOT NULL").select("doc", F.col("penalty_no").alias("no"), "penalty_id", "decision", F.col("legal_reasoning_summary").alias("summary")))


def l1_prompts(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "chunks").where("source_file IS NOT NULL AND page_content IS NOT NULL").select("source_file", "chunk_index", "chunk_id", F.col("page_content").alias("text")).distinct()
    by = c.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("c"))
    return by.select("source_file", X.prompt("Dokument {doc}\n\n{chunks}", doc=F.col("source_file"), chunks=X.rendered("c")).alias("prompt"))


def l8_parsed(s: SparkSession, d: str) -> DataFrame:
    """The payload out of responses as models wrap them: bare, fenced, or amid prose."""
    f = read(s, d, "extraction_files").select("file_id", "payload").dropDuplicates(["file_id"])
    pick = F.pmod(F.char_length("file_id"), F.lit(3))
    wrapped = F.when(pick == 0, F.col("payload")).when(pick == 1, F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))).otherwise(F.concat(F.lit("Výsledok: "), "payload", F.lit(" Koniec.")))
    return f.select("file_id", F.get_json_object(X.json_of(wrapped), "$.meta.doc_id").alias("doc_id"))


def l10_meta(s: SparkSession, d: str) -> DataFrame:
    return X.meta_override(read(s, d, "extractions"), read(s, d, "processed_json"))


def l11_totals(s: SparkSession, d: str) -> DataFrame:
    return X.run_totals(read(s, d, "extractions"))


def case_records(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select("extraction_id", "penalty_no", "penalty_id", "contract_type", "breach_type", "rate_type", "currency", "decision", "secured_principal", F.size("flags").alias("n_flags"), "authority_level", "card")


def case_columns(s: SparkSession, d: str) -> DataFrame:
    """The other columns of the records."""
    r = _records(s, d)
    said = F.array_join(F.transform("factors", lambda f: F.concat_ws(":", f["label"], f["sentiment"])), ",")
    return r.select("extraction_id", "penalty_no", "relationship_type", "rate_value_raw", "original_claimed", "final_awarded", "dismissal_reason", "reasoning", said.alias("factors"), F.array_join("flags", ",").alias("flags"), "court_name", "case_number", "decision_date")


def case_filter(s: SparkSession, d: str) -> DataFrame:
    return C.filter_counts(_records(s, d), INTENT)


def case_fallback(s: SparkSession, d: str) -> DataFrame:
    return C.filter_counts(_records(s, d), C.Intent(contract_type="no_such_type"))


def case_ranking(s: SparkSession, d: str) -> DataFrame:
    return C.cards(C.ranked(C.filtered(_records(s, d), INTENT), INTENT))


def case_statistics(s: SparkSession, d: str) -> DataFrame:
    return C.statistics(_records(s, d))


def case_factors(s: SparkSession, d: str) -> DataFrame:
    return C.factor_counts(_records(s, d))


def case_report(s: SparkSession, d: str) -> DataFrame:
    return C.report(_records(s, d))


def case_profile(s: SparkSession, d: str) -> DataFrame:
    return C.profile(_records(s, d))


def case_repeats(s: SparkSession, d: str) -> DataFrame:
    return C.repeated_cases(_records(s, d))


def s17_upserted(s: SparkSession, d: str) -> DataFrame:
    """Chunks as a store, late deliveries upserted by id: the newest row of each id."""
    c = read(s, d, "chunks").select("chunk_id", "source_file", "char_len", "ingested_at")
    old, new = c.where("ingested_at < TIMESTAMP '2024-01-01'").dropDuplicates(["chunk_id"]), c.where("ingested_at >= TIMESTAMP '2024-01-01'")
    return io.upserted(old, new, "chunk_id", "ingested_at").select("chunk_id", "source_file", "char_len")


def s20_documents(s: SparkSession, d: str) -> DataFrame:
    return io.distinct_documents(read(s, d, "chunks"))


def s22_unfinished(s: SparkSession, d: str) -> DataFrame:
    """Decisions without an extraction yet."""
    done = read(s, d, "extraction_files").select(F.regexp_replace("source_file", r"\.pdf$", "").alias("k")).where("k IS NOT NULL")
    return io.unfinished(read(s, d, "processed_json").select("filename", F.regexp_replace("filename", r"\.pdf$", "").alias("k")).distinct(), done, "k").select("filename")


def s6_alignment(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "chunks").where("source_file IS NOT NULL").select("source_file").distinct()
    return io.misaligned(c, read(s, d, "pipeline_data").select(F.col("filename").alias("source_file")).distinct(), "source_file")


QUERIES = {f.__name__: f for f in (
    j6_evidence, j8_grounding, j10_repaired, j11_checks, j11_currency, j1_merged_calls, l1_prompts, l8_parsed, l10_meta, l11_totals, case_records, case_columns, case_filter, case_fallback, case_ranking, case_statistics,
    case_factors, case_report, case_profile, case_repeats, s17_upserted, s20_documents, s22_unfinished, s6_alignment,
)}

_FLAT = _PENS + """, meta AS (SELECT extraction_id, any_value(result.case_context) AS cc, any_value(result.meta) AS m, any_value(result.quality_control) AS qc FROM extractions GROUP BY extraction_id),
 r0 AS (SELECT extraction_id, CAST(penalty_no AS INTEGER) AS penalty_no, p.penalty_id AS penalty_id, coalesce(cc.contract_type, 'nezname') AS contract_type, coalesce(cc.relationship_type, '') AS relationship_type, coalesce(p.breach_type.value, 'other') AS breach_type,
  coalesce(p.rate_definition.type, 'ine') AS rate_type, coalesce(p.rate_definition.value_raw, '') AS rate_value_raw, coalesce(p.amounts.currency, 'unknown') AS currency, p.amounts.secured_principal.value AS secured_principal, p.amounts.original_claimed.value AS original_claimed,
  p.amounts.final_awarded.value AS final_awarded, coalesce(p.moderation_analysis.decision.value, 'unclear') AS decision, coalesce(p.moderation_analysis.legal_reasoning_summary, '') AS reasoning, list_filter(coalesce(p.moderation_analysis.factors, []), lambda f: f IS NOT NULL) AS factors,
  list_filter(coalesce(qc.flags, []), lambda f: contains(f, coalesce(p.penalty_id, 'pokuta_')) OR NOT contains(f, 'pokuta_')) AS flags, coalesce(m.court_name, '') AS court_name, coalesce(m.case_number, '') AS case_number FROM pens JOIN meta USING (extraction_id)),
 r AS (SELECT *, CAST(CASE WHEN contains(lower(court_name), 'najvy') THEN 3 WHEN contains(lower(court_name), 'krajsk') THEN 2 ELSE 1 END AS INTEGER) AS authority_level FROM r0)"""
_MENTIONED = "list_filter(factors, lambda f: f.sentiment IS NOT NULL AND f.sentiment <> 'not_mentioned')"
_NUM = lambda c: f"replace(format('{{:,.0f}}', {c}), ',', ' ')"
_EV = " UNION ALL ".join(f"SELECT extraction_id, n, '{path}' AS field_path, p.{path2}.evidence.quote AS quote, p.{path2}.evidence.chunk_id AS chunk_id FROM e" for path, path2 in (
    ("breach_type", "breach_type"), ("rate_definition", "rate_definition"), ("amounts.secured_principal", "amounts.secured_principal"), ("amounts.original_claimed", "amounts.original_claimed"),
    ("amounts.final_awarded", "amounts.final_awarded"), ("associated_interest", "associated_interest"), ("decision", "moderation_analysis.decision")))
_ID = "coalesce(p.penalty_id, 'unknown')"
_RULES = [
    ("flag", "p.amounts.final_awarded.value > p.amounts.original_claimed.value", f"'MATH_ERROR_AWARDED_EXCEEDS_CLAIMED_' || {_ID}"),
    ("flag", "p.moderation_analysis.decision.value = 'moderated_301' AND p.amounts.final_awarded.value = p.amounts.original_claimed.value", f"'LOGIC_ERROR_MODERATION_BUT_SAME_AMOUNT_' || {_ID}"),
    ("flag", "p.moderation_analysis.decision.value = 'dismissed' AND p.moderation_analysis.decision.dismissal_reason IS NULL", f"'MISSING_DISMISSAL_REASON_' || {_ID}"),
    *[("flag", f"p.amounts.{a}.value IS NOT NULL AND regexp_matches(p.amounts.{a}.evidence.quote, 'X{{2,}}')", f"'ANONYMIZED_AMOUNT_{a}_' || {_ID}") for a in ("secured_principal", "original_claimed", "final_awarded")],
    ("missing", "coalesce(p.breach_type.value, '') = ''", f"{_ID} || '.breach_type'"), ("missing", "coalesce(p.rate_definition.type, '') = ''", f"{_ID} || '.rate_definition'"), ("missing", "p.amounts.original_claimed.value IS NULL", f"{_ID} || '.amounts.original_claimed'"),
]
_MATCH = "contract_type IN ('dielo', 'dodavka_sluzieb') AND breach_type = 'late_payment'"
_LABELS = "(VALUES " + ", ".join(f"('{k}', {i}, '{FACTOR_NAMES[k]}')" for i, k in enumerate(FACTOR_LABELS)) + ") AS l(label, ord, name)"
_BAD = f"bad AS (SELECT label, ord, name, coalesce(n, 0) AS n_negative, (SELECT count(*) FROM r WHERE decision = 'moderated_301') AS n_moderated FROM {_LABELS} LEFT JOIN (SELECT f.label AS label, count(*) AS n FROM (SELECT unnest(factors) AS f FROM r WHERE decision = 'moderated_301') WHERE f.sentiment = 'negative' GROUP BY 1) USING (label))"

SQL = {
    "j6_evidence": _PENS + f""", e AS (SELECT extraction_id, CAST(row_number() OVER (PARTITION BY extraction_id ORDER BY penalty_no) - 1 AS INTEGER) AS n, p FROM pens), a AS ({_EV}
      UNION ALL SELECT extraction_id, n, 'key_quotes.' || (i - 1), k.quote, k.chunk_id FROM (SELECT extraction_id, n, unnest(range(1, len(p.moderation_analysis.key_quotes) + 1)) AS i, unnest(p.moderation_analysis.key_quotes) AS k FROM e)
      UNION ALL SELECT extraction_id, n, 'factors.' || (i - 1), k.evidence.quote, k.evidence.chunk_id FROM (SELECT extraction_id, n, unnest(range(1, len(p.moderation_analysis.factors) + 1)) AS i, unnest(p.moderation_analysis.factors) AS k FROM e)),
      d AS (SELECT extraction_id, any_value(result.meta.doc_id) || '.pdf' AS source_file FROM extractions GROUP BY extraction_id)
      SELECT extraction_id, source_file, n AS penalty_no, field_path, quote, chunk_id FROM a JOIN d USING (extraction_id) WHERE coalesce(quote, '') <> '' AND coalesce(chunk_id, '') <> ''""",
    "j11_checks": _PENS + " SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT extraction_id, '{k}' AS kind, {code} AS code FROM pens WHERE {test}" for k, test, code in _RULES) + " UNION ALL SELECT extraction_id, 'flag', 'NO_PENALTIES_EXTRACTED' FROM extractions WHERE extraction_id NOT IN (SELECT extraction_id FROM pens))",
    "j1_merged_calls": _PENS + """, mod AS (SELECT extraction_id AS doc, p.penalty_id AS penalty_id, p.moderation_analysis.decision.value AS decision, p.moderation_analysis.legal_reasoning_summary AS summary, row_number() OVER (PARTITION BY extraction_id, p.penalty_id ORDER BY penalty_no DESC) AS k FROM pens WHERE p.moderation_analysis.decision.value IS NOT NULL)
      SELECT f.extraction_id AS doc, CAST(penalty_no AS INTEGER) AS penalty_no, p.penalty_id AS penalty_id, coalesce(m.decision, 'unclear') AS decision, coalesce(m.summary, '') AS summary, m.doc IS NOT NULL AS matched FROM pens f LEFT JOIN (SELECT * FROM mod WHERE k = 1) m ON m.doc = f.extraction_id AND m.penalty_id = f.p.penalty_id""",
    "l1_prompts": "WITH c AS (SELECT DISTINCT source_file, chunk_index, chunk_id, page_content FROM chunks WHERE source_file IS NOT NULL AND page_content IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, chunk_id, page_content) AS i FROM c) SELECT source_file, 'Dokument ' || source_file || chr(10) || chr(10) || string_agg('[CHUNK ' || i || '] (' || chunk_id || ')' || chr(10) || page_content, chr(10) || chr(10) ORDER BY i) AS prompt FROM n GROUP BY source_file",
    "l8_parsed": "SELECT DISTINCT file_id, json_extract_string(payload, '$.meta.doc_id') AS doc_id FROM extraction_files",
    "l10_meta": "WITH m AS (SELECT regexp_replace(filename, '\\.pdf$', '') AS doc_id, arg_max(metadata, ingested_at) AS m FROM processed_json WHERE metadata IS NOT NULL GROUP BY 1), e AS (SELECT extraction_id, any_value(result.meta) AS x FROM extractions WHERE result.meta IS NOT NULL GROUP BY 1) SELECT extraction_id, x.doc_id AS doc_id, coalesce(m.court, x.court_name) AS court_name, coalesce(m.case_id, x.case_number) AS case_number, coalesce(m.ecli, x.ecli) AS ecli, coalesce(m.document_type, x.document_type) AS document_type FROM e LEFT JOIN m ON m.doc_id = x.doc_id",
    "l11_totals": "WITH e AS (SELECT extraction_id, any_value(extraction_config) AS c, any_value(api_metadata) AS a, any_value(result) AS r FROM extractions GROUP BY 1) SELECT c.model AS model, c.mode AS mode, count(*) AS n_runs, sum(a.prompt_tokens) AS prompt_tokens, sum(a.completion_tokens) AS completion_tokens, round_even(avg(a.latency_seconds), 6) AS mean_latency, count(*) FILTER (len(r.quality_control.flags) > 0) AS n_flagged FROM e GROUP BY 1, 2",
    "case_records": _FLAT + f""" SELECT extraction_id, penalty_no, penalty_id, contract_type, breach_type, rate_type, currency, decision, secured_principal, CAST(len(flags) AS INTEGER) AS n_flags, authority_level,
      array_to_string(list_filter(['Zmluva: ' || contract_type || CASE WHEN relationship_type <> '' THEN ', ' || relationship_type ELSE '' END || '.', CASE WHEN breach_type <> '' THEN 'Porusenie: ' || breach_type || '.' END, CASE WHEN rate_value_raw <> '' THEN 'Sadzba: ' || rate_value_raw || '.' END,
       CASE WHEN secured_principal IS NOT NULL THEN 'Istina: ' || {_NUM('secured_principal')} || ' ' || currency || '.' END, CASE WHEN original_claimed IS NOT NULL AND final_awarded IS NOT NULL THEN 'Pozadovane: ' || {_NUM('original_claimed')} || ', priznane: ' || {_NUM('final_awarded')} || ' ' || currency || '.' END,
       CASE WHEN decision <> '' THEN 'Rozhodnutie: ' || CASE decision {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DECISION_LABELS.items())} ELSE decision END || '.' END,
       CASE WHEN len({_MENTIONED}) > 0 THEN 'Faktory: ' || array_to_string(list_transform({_MENTIONED}, lambda f: coalesce(f.label, '') || ' (' || f.sentiment || ')'), ', ') || '.' END,
       CASE WHEN reasoning <> '' THEN CASE WHEN length(reasoning) <= 200 THEN reasoning WHEN instr(left(reasoning, 200), ' ') > 1 THEN regexp_extract(left(reasoning, 200), '(?s)^(.*) [^ ]*$', 1) ELSE left(reasoning, 200) END END], lambda x: x IS NOT NULL), ' ') AS card FROM r""",
    "case_columns": _FLAT + """ SELECT r.extraction_id, r.penalty_no, relationship_type, rate_value_raw, original_claimed, final_awarded, pp.p.moderation_analysis.decision.dismissal_reason AS dismissal_reason, reasoning,
      array_to_string(list_transform(factors, lambda f: array_to_string(list_filter([f.label, f.sentiment], lambda x: x IS NOT NULL), ':')), ',') AS factors, array_to_string(flags, ',') AS flags, court_name, case_number, mm.m.decision_date AS decision_date
      FROM r JOIN pens pp ON pp.extraction_id = r.extraction_id AND pp.penalty_no = r.penalty_no JOIN meta mm ON mm.extraction_id = r.extraction_id""",
    "case_filter": _FLAT + f", n AS (SELECT count(*) AS k FROM r WHERE {_MATCH}) SELECT CASE WHEN k = 0 THEN 'none_fallback' ELSE 'strict' END AS filter_type, count(*) AS n_filtered, (SELECT count(*) FROM r) AS n_total FROM r, n WHERE k = 0 OR ({_MATCH}) GROUP BY 1",
    "case_fallback": _FLAT + " SELECT 'none_fallback' AS filter_type, count(*) AS n_filtered, count(*) AS n_total FROM r",
    "case_ranking": _FLAT + f""", n AS (SELECT count(*) AS k FROM r WHERE {_MATCH}), c AS (SELECT r.*, coalesce(secured_principal, original_claimed) AS own, list_transform({_MENTIONED}, lambda f: f.label) AS told FROM r, n WHERE k = 0 OR ({_MATCH})),
      s AS (SELECT *, round_even(0.25 * CASE WHEN own IS NULL OR own <= 0 THEN 0.5 ELSE least(own, 50000.0::DOUBLE) / greatest(own, 50000.0::DOUBLE) END + 0.2 * ((CASE WHEN decision = 'moderated_301' THEN 2 ELSE 0 END + coalesce(list_contains(told, 'dobre_mravy'), false)::INTEGER + coalesce(list_contains(told, 'pomer_k_istine'), false)::INTEGER) / 4.0::DOUBLE) + 0.15 * authority_level / 3, 6) AS sc FROM c)
      SELECT CAST(row_number() OVER (ORDER BY sc DESC, extraction_id, penalty_no) AS INTEGER) AS rank, extraction_id, penalty_id, case_number, court_name, contract_type, breach_type, decision, currency, secured_principal, round_even(sc, 3) AS score, authority_level FROM s ORDER BY sc DESC, extraction_id, penalty_no LIMIT 5""",
    "case_statistics": _FLAT + " SELECT count(*) AS n, count(*) FILTER (decision IN ('moderated_301', 'awarded_full')) AS n_decided, count(*) FILTER (decision = 'moderated_301') AS n_moderated, CASE WHEN count(*) >= 5 AND count(*) FILTER (decision IN ('moderated_301', 'awarded_full')) >= 3 THEN round_even(100 * count(*) FILTER (decision = 'moderated_301') / count(*) FILTER (decision IN ('moderated_301', 'awarded_full')), 1) END AS moderation_rate_pct FROM r",
    "case_factors": _FLAT + f", {_BAD} SELECT label, n_negative, n_moderated FROM bad",
    "case_report": _FLAT + f", {_BAD} SELECT CAST(row_number() OVER (ORDER BY n_negative DESC, ord) AS INTEGER) AS line_no, '  - ' || rpad(name, 35, '.') || ' ' || n_negative || ' z ' || n_moderated || ' pripadov' AS line FROM bad WHERE n_negative > 0",
    "case_profile": _FLAT + " SELECT field, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM r" for f in ("contract_type", "breach_type", "decision", "currency", "rate_type"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 'has_amount', '{a}' FROM r WHERE {a} IS NOT NULL" for a in ("secured_principal", "original_claimed", "final_awarded")) + " UNION ALL SELECT 'flags', 'any' FROM r WHERE len(flags) > 0) WHERE value IS NOT NULL GROUP BY 1, 2",
    "case_repeats": _FLAT + " SELECT extraction_id, penalty_no, case_number, n_same FROM (SELECT *, count(*) OVER (PARTITION BY case_number) AS n_same FROM r) WHERE n_same > 1",
    "s17_upserted": "SELECT chunk_id, any_value(source_file) AS source_file, any_value(char_len) AS char_len FROM chunks GROUP BY chunk_id",
    "s20_documents": "SELECT DISTINCT source_file FROM chunks WHERE source_file IS NOT NULL",
    "s22_unfinished": "SELECT DISTINCT filename FROM processed_json WHERE regexp_replace(filename, '\\.pdf$', '') NOT IN (SELECT regexp_replace(source_file, '\\.pdf$', '') FROM extraction_files WHERE source_file IS NOT NULL)",
    "s6_alignment": "SELECT count(c.source_file) AS n_records, count(p.filename) AS n_vectors, count(*) FILTER (c.source_file IS NULL OR p.filename IS NULL) AS n_unmatched FROM (SELECT DISTINCT source_file FROM chunks WHERE source_file IS NOT NULL) c FULL JOIN (SELECT DISTINCT filename FROM pipeline_data) p ON c.source_file = p.filename",
}
