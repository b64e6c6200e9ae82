"""Queries of embeddings, and of the search by question in the case base, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, read
from ..functions.catalog import SIMILAR_CONTRACTS
from ..operators import casebase as C
from ..operators import embedding as E
from ..operators import extraction as X
from . import cases
from .documents import q, re2, sql_plain, sql_tokens

QUESTIONS = [
    ("q1", "Aká sadzba zmluvnej pokuty pri zmluve o dielo za 50 000 eur je bezpečná, keď zhotoviteľ mešká s odovzdaním?"),
    ("q2", "Argumenty na obranu nájomcu: pokuta za predčasnú výpoveď nájmu odporuje dobrým mravom a súd ju má znížiť"),
    ("q3", "Kúpna zmluva, nezaplatená faktúra 12000 €, pomer pokuty k istine"),
    ("q4", "Porušenie mlčanlivosti pri preprave"),
    ("q5", "Podobné rozhodnutia"),
    ("q6", " "),
    ("q7", None),
]


def _questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(QUESTIONS, "query_id string, question string")


def v1_passages(s: SparkSession, d: str) -> DataFrame:
    """Non-zero members of the vectors of all chunks."""
    c = read(s, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "page_content").distinct()
    v = E.embedded(c, "page_content").select("chunk_id", F.posexplode("vector").alias("bucket", "weight"))
    return v.where("weight > 0").select("chunk_id", "bucket", F.bround("weight", 6).alias("weight"))


def v6_metadata(s: SparkSession, d: str) -> DataFrame:
    kinds = {"case_id": ("string", ""), "court": ("string", ""), "chunk_index": ("int", -1), "char_len": ("double", 0.0), "strategy": ("string", "unknown")}
    c = read(s, d, "chunks").select("chunk_id", *kinds).distinct()
    return E.clean_metadata(c, kinds)


def l9_intents(s: SparkSession, d: str) -> DataFrame:
    i = C.intents(_questions(s))
    return i.select("query_id", "intent", "contract_type", "breach_type", "decision_interest", F.array_join("factor_interest", ",").alias("factors"), "amount_hint", "semantic_query")


def _near(s: SparkSession, records: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, extraction_id, penalty_no, likeness) of the questions and the cards of all records."""
    cards = E.embedded(records.select("extraction_id", "penalty_no", "card"), "card").select("extraction_id", "penalty_no", F.col("vector").alias("v"))
    of = E.embedded(asked.select("query_id", "semantic_query"), "semantic_query", prefix=E.QUERY).select("query_id", F.col("vector").alias("u"))
    return cards.crossJoin(F.broadcast(of)).select("query_id", "extraction_id", "penalty_no", E.likeness("v", "u").alias("likeness"))  # the stated questions


def _found(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records, asked = checkpointed(cases._records(s, d)), checkpointed(C.intents(_questions(s)))
    return asked, C.search_all(records, asked, 5, _near(s, records, asked))


def v4_likeness(s: SparkSession, d: str) -> DataFrame:
    records, asked = cases._records(s, d), C.intents(_questions(s))
    near = _near(s, records, asked)
    return near.select("query_id", "extraction_id", "penalty_no", F.bround("likeness", 6).alias("likeness"))


def case_search(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d)[1]


def p16_intent_summary(s: SparkSession, d: str) -> DataFrame:
    return C.intent_summary(*_found(s, d))


def case_gated(s: SparkSession, d: str) -> DataFrame:
    """Statistics of the records that suit a question, and of one that few suit."""
    r = cases._records(s, d)
    some = C.gated_statistics(r, cases.INTENT).withColumn("question", F.lit("suited"))
    return some.unionByName(C.gated_statistics(r.where("currency = 'no such'"), cases.INTENT).withColumn("question", F.lit("none")))


def j7_grounding(s: SparkSession, d: str) -> DataFrame:
    """Evidence looked up in the chunk that it names."""
    e = X.evidence(read(s, d, "extractions"))
    return X.looked_up(e, X.lookup(read(s, d, "chunks"), read(s, d, "processed_json"))).select("extraction_id", "source_file", "penalty_no", "field_path", "chunk_id", F.coalesce("flag", F.lit("")).alias("flag"), F.char_length("text").alias("n_chars"))


QUERIES = {f.__name__: f for f in (v1_passages, v4_likeness, v6_metadata, l9_intents, case_search, case_gated, j7_grounding)} | {"search_intents": p16_intent_summary}

_VALUES = "(VALUES " + ", ".join(f"({q(a)}, {q(b) if b is not None else 'NULL::VARCHAR'})" for a, b in QUESTIONS) + ") AS v(query_id, question)"


def _first(bank: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {re2(p)}) THEN {q(n)}" for n, p in C._ASKED[bank].items()) + " END"


_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {re2(p)}) THEN {q(n)} END" for n, p in C._ASKED["factors"].items()) + "], lambda x: x IS NOT NULL)"
_INTENTS = f"""ask AS (SELECT query_id, coalesce({_first('intent')}, 'general_precedent') AS intent, {_first('contract_type')} AS contract_type, {_first('breach_type')} AS breach_type, {_first('decision')} AS decision_interest, {_NAMED} AS factor_interest,
 try_cast(nullif(replace(regexp_extract(t, '([0-9][0-9 ]*)[ ]*(eur|€)', 1), ' ', ''), '') AS DOUBLE) AS amount_hint, coalesce(trim(question), '') AS semantic_query FROM (SELECT *, {sql_plain('question')} AS t FROM {_VALUES}))"""
_BAG = lambda rows, key, text: f"SELECT {key}, b, CAST(count(*) AS DOUBLE) AS w FROM (SELECT {key}, CAST('0x' || left(md5(term), 7) AS BIGINT) % 64 AS b FROM (SELECT {key}, unnest({sql_tokens(text)}) AS term FROM {rows})) GROUP BY ALL"
_CARDS = cases.SQL["case_records"].removeprefix(cases._FLAT).strip().replace("SELECT extraction_id, penalty_no, penalty_id, contract_type, breach_type, rate_type, currency, decision, secured_principal, CAST(len(flags) AS INTEGER) AS n_flags, authority_level,", "SELECT extraction_id, penalty_no,")
_NEAR = f"""cd AS ({_CARDS}), cb AS ({_BAG('cd', 'extraction_id, penalty_no', 'card')}), cn AS (SELECT extraction_id, penalty_no, sqrt(sum(w * w)) AS s FROM cb GROUP BY ALL),
 ab AS ({_BAG('ask', 'query_id', 'semantic_query')}), an AS (SELECT query_id, sqrt(sum(w * w)) AS s FROM ab GROUP BY ALL),
 dp AS (SELECT query_id, extraction_id, penalty_no, sum(cb.w * ab.w) / (any_value(cn.s) * any_value(an.s)) AS likeness FROM cb JOIN ab USING (b) JOIN cn USING (extraction_id, penalty_no) JOIN an USING (query_id) GROUP BY ALL),
 nr AS (SELECT query_id, r.extraction_id, r.penalty_no, greatest(0, least(1, coalesce(likeness, 0))) AS likeness FROM r CROSS JOIN ask LEFT JOIN dp USING (query_id, extraction_id, penalty_no))"""
_LIKE = " OR ".join(f"(ask.contract_type = {q(a)} AND r.contract_type IN ({', '.join(map(q, b))}))" for a, b in SIMILAR_CONTRACTS.items())
_SEARCH = cases._FLAT + f""", {_INTENTS}, {_NEAR},
 b AS (SELECT ask.query_id AS query_id, r.extraction_id AS extraction_id, r.penalty_no AS penalty_no, r.penalty_id AS penalty_id, (ask.contract_type IS NULL OR r.contract_type = ask.contract_type OR {_LIKE}) AND (ask.breach_type IS NULL OR r.breach_type = ask.breach_type) AS suits,
  CASE WHEN amount_hint IS NULL OR amount_hint <= 0 OR coalesce(secured_principal, original_claimed) IS NULL OR coalesce(secured_principal, original_claimed) <= 0 THEN 0.5 ELSE least(coalesce(secured_principal, original_claimed), amount_hint) / greatest(coalesce(secured_principal, original_claimed), amount_hint) END AS amount,
  CASE WHEN decision_interest IS NULL AND len(factor_interest) = 0 THEN 0.5::DOUBLE ELSE (CASE WHEN r.decision = decision_interest THEN 2 ELSE 0 END + len(list_intersect(factor_interest, list_transform({cases._MENTIONED}, lambda f: f.label)))) / (CASE WHEN decision_interest IS NOT NULL THEN 2 ELSE 0 END + len(factor_interest))::DOUBLE END AS bonus, authority_level / 3 AS authority FROM r CROSS JOIN ask),
 c AS (SELECT query_id, count(*) FILTER (suits) AS n_suit, count(*) AS n_all FROM b GROUP BY query_id),
 s AS (SELECT b.*, likeness, CASE WHEN n_suit = 0 THEN 'none_fallback' ELSE 'strict' END AS filter_type, CASE WHEN n_suit = 0 THEN n_all ELSE n_suit END AS n_filtered, round_even(0.4 * likeness + 0.25 * amount + 0.2 * bonus + 0.15 * authority, 6) AS score FROM b JOIN c USING (query_id) JOIN nr USING (query_id, extraction_id, penalty_no) WHERE suits OR n_suit = 0),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, extraction_id, penalty_no) AS rank FROM s) WHERE rank <= 5)"""

SQL = {
    "v1_passages": f"WITH rows AS (SELECT DISTINCT chunk_id, page_content FROM chunks WHERE chunk_id IS NOT NULL), bag AS ({_BAG('rows', 'chunk_id, page_content', 'page_content')}) SELECT chunk_id, CAST(b AS INTEGER) AS bucket, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id, page_content)), 6) AS weight FROM bag",
    "v6_metadata": "SELECT DISTINCT chunk_id, coalesce(case_id, '') AS case_id, coalesce(court, '') AS court, coalesce(chunk_index, -1) AS chunk_index, coalesce(CAST(char_len AS DOUBLE), 0.0::DOUBLE) AS char_len, coalesce(strategy, 'unknown') AS strategy FROM chunks",
    "l9_intents": f"WITH {_INTENTS} SELECT query_id, intent, contract_type, breach_type, decision_interest, array_to_string(factor_interest, ',') AS factors, amount_hint, semantic_query FROM ask",
    "v4_likeness": cases._FLAT + f", {_INTENTS}, {_NEAR} SELECT query_id, extraction_id, penalty_no, round_even(likeness, 6) AS likeness FROM nr",
    "case_search": _SEARCH + " SELECT query_id, filter_type, n_filtered, rank, extraction_id, penalty_no, penalty_id, round_even(likeness, 6) AS likeness, score FROM best",
    "search_intents": _SEARCH + " SELECT ask.query_id, ask.intent, any_value(filter_type) AS filter_type, coalesce(max(n_filtered), 0) AS n_filtered, count(best.query_id) AS n_shown FROM ask LEFT JOIN best USING (query_id) GROUP BY ALL",
    "case_gated": cases._FLAT + f""", n AS (SELECT count(*) AS k FROM r WHERE {cases._MATCH}), f AS (SELECT r.* FROM r, n WHERE k = 0 OR ({cases._MATCH})), a AS (SELECT count(*) AS n, count(*) FILTER (decision IN ('moderated_301', 'awarded_full')) AS n_decided, count(*) FILTER (decision = 'moderated_301') AS n_moderated FROM f)
      SELECT n, n_decided, n_moderated, CASE WHEN n >= 5 AND n_decided >= 3 THEN round_even(100 * n_moderated / n_decided, 1) END AS moderation_rate_pct, CASE WHEN n < 5 THEN 'menej ako 5 zaznamov: ' || n END AS note, 'suited' AS question FROM a
      UNION ALL SELECT 0, 0, 0, NULL, 'menej ako 5 zaznamov: 0', 'none'""",
    "j7_grounding": cases.SQL["j6_evidence"].replace("SELECT extraction_id, source_file, n AS penalty_no, field_path, quote, chunk_id FROM a JOIN d USING (extraction_id) WHERE", """, lk AS (SELECT source_file, 'chunk_' || chunk_index AS chunk_id, arg_max(page_content, ingested_at) AS text FROM chunks WHERE page_content IS NOT NULL AND source_file IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT filename, k, arg_max(t, ingested_at) FROM (SELECT filename, ingested_at, unnest(['header', 'verdict', 'full_doc']) AS k, unnest([header, segments.verdict, reasoning_full]) AS t FROM processed_json) WHERE t IS NOT NULL GROUP BY 1, 2)
      SELECT extraction_id, d.source_file AS source_file, n AS penalty_no, field_path, a.chunk_id AS chunk_id, CASE WHEN lk.text IS NULL THEN 'CHUNK_NOT_FOUND' ELSE '' END AS flag, length(lk.text) AS n_chars FROM a JOIN d USING (extraction_id) LEFT JOIN lk ON lk.source_file = d.source_file AND lk.chunk_id = regexp_replace(a.chunk_id, '^.*_(chunk_[0-9]+)$', '\\1') WHERE""").replace("coalesce(chunk_id, '') <> ''", "coalesce(a.chunk_id, '') <> ''"),
}
