"""Queries of text cleaning, extraction, tokens and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read, spread
from ..functions import text as T
from ..functions.catalog import CHUNK_PRESETS, CONTRACTS, FEATURES, STOPWORDS
from ..functions.text import WS
from ..operators import chunking


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "chunks").select("chunk_id", "page_content")).distinct()


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "pipeline_data").select("filename", "raw_pages")).select("filename", T.join_pages("raw_pages").alias("text")).distinct()


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "processed_json").select("filename", "court", F.col("segments.reasoning").alias("reasoning")).distinct()


def t1_clean_light(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", T.clean_light("page_content").alias("text"))


def t2_pages_without_pagination(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("filename", T.drop_pagination("text").alias("text"))


def t4_header_and_body(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("filename", T.split_header("text").alias("x")).select("filename", "x.header", F.char_length("x.body").alias("n_body"))


def t7_layout(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("filename", T.normalize_layout(T.drop_pagination(T.clean_light("text"))).alias("text"))


def t8_punctuation_and_space(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", T.advanced_unicode("page_content").alias("unicode"), T.squash("page_content").alias("squashed"), T.tight_punctuation("page_content").alias("tight"))


def t11_plain(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", T.plain("text").alias("plain"))


def t13_names_and_numbers(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", T.safe_filename(F.col("o_orderpriority")).alias("safe"), T.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"), T.spaced_number("o_totalprice").alias("price"), F.format_string("o_%03d", "o_custkey").alias("padded"), F.col("o_orderpriority").try_cast("double").alias("number"))


def t18_cut(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", T.cut_at_blank(F.regexp_replace("text", r"\s", " ")).alias("cut"))


def x1_header_meta(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "processed_json").select("filename", "header").distinct().select("filename", T.header_meta("header").alias("m")).select("filename", "m.*")


def x2_segments(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("filename", T.segments("text").alias("x")).select("filename", "x.verdict", F.char_length("x.reasoning").alias("n_reasoning"), "x.instruction")


def x5_features(s: SparkSession, d: str) -> DataFrame:
    flat = spread(read(s, d, "documents")).select("doc_id", T.plain("text").alias("plain"))
    return flat.select("doc_id", *T.pattern_counts(F.col("plain"), FEATURES)).withColumn("label", T.relevance_label())


def x6_contract_kinds(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select(F.explode(T.contract_kinds("text")).alias("contract_kind")).groupBy("contract_kind").agg(F.count("*").alias("n"))


def x7_proximity(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", T.near(T.plain("text"), r"zmluvn\w*\s+pokut\w*", r"(zniz\w*|neprimeran\w*)", 250).alias("near"))


def x8_in_context(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", T.keyword_in_context("text", r"pokut\w*", 40).alias("context")).where("context IS NOT NULL")


def x9_section(s: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    status = F.pandas_udf(lambda t: pd.DataFrame([T.section_status(x) for x in t], columns=["status", "snippet"]), "status string, snippet string")
    return spread(read(s, d, "documents")).select("doc_id", status("text").alias("x")).select("doc_id", "x.*")


def x13_courts(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "processed_json").select("court").distinct()
    return c.select("court", T.court_tier("court").alias("court_tier"), T.authority_level("court").alias("authority_level"))


def x10_commercial(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", T.is_commercial(F.lit(None).cast("string"), F.col("domain"), F.col("case_id")).alias("commercial"), F.exists(F.array(F.lit("obdo"), F.lit("cob")), lambda m: F.contains(F.lower(F.coalesce("case_id", F.lit(""))), m)).alias("register"))


def x17_health(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", T.text_health("text").alias("health"), F.char_length("text").alias("n_chars"))


def x19_variants(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "processed_json").where("metadata.case_id IS NOT NULL").select(F.col("metadata.case_id").alias("case_id")).distinct().select("case_id", F.explode(T.case_variants("case_id")).alias("variant"))


def x20_case_match(s: SparkSession, d: str) -> DataFrame:
    """Decisions found for the extractions' docket numbers in any spelling; of several the first by name."""
    docs = read(s, d, "extractions").where("result.meta.case_number IS NOT NULL").select("extraction_id", F.explode(T.case_variants("result.meta.case_number")).alias("variant"))
    files = read(s, d, "processed_json").where("metadata.case_id IS NOT NULL").select("filename", F.explode(T.case_variants("metadata.case_id")).alias("variant"))
    return docs.join(files, "variant").groupBy("extraction_id").agg(F.min("filename").alias("filename"))


def t4_body(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("filename", T.split_header("text").alias("x")).select("filename", "x.body")


def x2_reasoning(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("filename", T.segments("text").alias("x")).select("filename", "x.reasoning")


def x6_kinds(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", F.array_join(T.contract_kinds("text"), ",").alias("kinds"))


def j13_features(s: SparkSession, d: str) -> DataFrame:
    """Decisions with the features of their courts, those without any kept."""
    files = read(s, d, "processed_json").select("filename", "court").distinct()
    return files.join(F.broadcast(read(s, d, "courts")), "court", "left").select("filename", "court", "court_code", "tier", "town")  # the fixed table of courts


def j14_metadata(s: SparkSession, d: str) -> DataFrame:
    """Metadata by the first source that has them: the row, the metadata, the file's name, a word for unknown."""
    p = read(s, d, "processed_json").select("filename", "court", "metadata").distinct()
    parts = F.split("filename", "_")
    docket = F.when(F.size(parts) >= 5, F.concat_ws("/", F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(4))))
    of = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit("Unknown"))
    return p.select("filename", of(F.col("court"), F.col("metadata.court")).alias("court_name"), of(F.col("metadata.case_id"), docket).alias("docket"), of(F.col("metadata.document_type")).alias("kind"), of(F.col("metadata.ecli")).alias("ecli")).distinct()


def t16_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers out of free text: amounts as written, dockets, lengths."""
    return read(s, d, "chunks").select("chunk_id", T.safe_number(F.regexp_extract("page_content", r"(\d+(?:\.\d+)?)", 1)).alias("first"), T.safe_number("case_id").alias("docket")).distinct()


def t21_rounded(s: SparkSession, d: str) -> DataFrame:
    """Halves go to the even neighbour."""
    li = read(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", T.rounded(F.col("l_quantity").cast("double") / 2).alias("half"), T.rounded(F.col("l_quantity").cast("double") / 4, 1).alias("quarter"))


def x4_structure(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", *T.structure_flags("text"))


def x11_register(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", T.is_trade_register("case_id").alias("in_register"))


def x18_courts(s: SparkSession, d: str) -> DataFrame:
    """Official names of the courts, of their codes as short names, and of short names as listed."""
    names = read(s, d, "courts").select(F.col("court").alias("name")).unionByName(read(s, d, "courts").select(F.col("court_code").alias("name")))
    return names.unionByName(s.createDataFrame([(n,) for n in T.COURT_NAMES], "name string")).distinct().select("name", T.official_court("name").alias("official"))


def x20_court_match(s: SparkSession, d: str) -> DataFrame:
    """Decisions whose docket holds the extraction's and whose court agrees; of several the first by name. The serial and year are equal, so they are the join's key and containment is tested within it."""
    asked = read(s, d, "extractions").where("result.meta.case_number IS NOT NULL").select("extraction_id", T.docket_key("result.meta.case_number").alias("a"), F.col("result.meta.court_name").alias("asked"), _SERIAL("result.meta.case_number").alias("k")).distinct()
    files = read(s, d, "processed_json").where("metadata.case_id IS NOT NULL").select("filename", T.docket_key("metadata.case_id").alias("f"), F.col("metadata.court").alias("found"), _SERIAL("metadata.case_id").alias("k")).distinct()
    return asked.join(files, "k").where(F.contains("f", "a") & T.same_court(F.col("asked"), F.col("found"))).groupBy("extraction_id").agg(F.min("filename").alias("filename"))


def x22_experiments(s: SparkSession, d: str) -> DataFrame:
    """Parts of the names of the extractions' retrieval, with a cut-off and window put on."""
    names = read(s, d, "extractions").where("extraction_config.retrieval_config.name IS NOT NULL").select(F.concat(F.col("extraction_config.retrieval_config.name"), F.lit("_w"), F.coalesce(F.col("extraction_config.retrieval_config.window_size"), F.lit(0)).cast("string")).alias("name"))
    return names.distinct().select("name", T.experiment_parts("name").alias("x")).select("name", "x.*")


def x23_entities(s: SparkSession, d: str) -> DataFrame:
    return spread(read(s, d, "documents")).select("doc_id", *[c for n, c in zip(T.ENTITIES, T.entity_counts("text")) if n != "money"])


def x23_money(s: SparkSession, d: str) -> DataFrame:
    """Apart, as its look-arounds have no SQL."""
    return spread(read(s, d, "documents")).select("doc_id", T.entity_counts("text")[0])


def k5_budget(s: SparkSession, d: str) -> DataFrame:
    """Reasonings cut to what a budget leaves beside header and verdict."""
    p = read(s, d, "processed_json").select("filename", "header", "reasoning_full", F.col("segments.verdict").alias("verdict")).distinct()
    return p.select("filename", T.token_length(T.truncated_tokens("reasoning_full", 600, "header", "verdict")).alias("n_kept"), T.truncated_tokens("reasoning_full", 600, "header", "verdict").alias("kept"))


def t6_spaced(s: SparkSession, d: str) -> DataFrame:
    """Lines that are printed letter by letter."""
    lines = read(s, d, "pipeline_data").select("filename", F.explode(F.split(T.join_pages("raw_pages"), "\n")).alias("line")).distinct()
    return lines.where(T.is_spaced_header("line")).select("filename", "line")


def _SERIAL(c: str) -> F.Column:  # noqa: N802
    """The digits of a docket number, which containment of one in the other leaves to be compared where they are equal."""
    return F.regexp_replace(F.col(c), r"[^0-9]", "")


def x21_chunk_number(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").select("chunk_id", T.chunk_number("chunk_id").alias("number")).distinct()


def k1_tokens(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", F.array_join(T.tokens("page_content"), " ").alias("tokens"))


def k2_lengths(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", T.token_length("page_content").alias("n_tokens"), T.rough_tokens("page_content").alias("n_rough"), T.first_tokens("page_content", 12).alias("head"))


def c1_recursive(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, (size, overlap) in CHUNK_PRESETS.items():
        part = chunking.rows(_reasons(s, d), chunking.recursive("reasoning", size, overlap), name, ["filename"])
        out = part if out is None else out.unionByName(part)
    return out


def c3_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(_reasons(s, d), "reasoning", ["filename", "court"])


def c4_parents(s: SparkSession, d: str) -> DataFrame:
    return chunking.parents(_reasons(s, d), "reasoning", "filename")


def c5_children(s: SparkSession, d: str) -> DataFrame:
    return chunking.children(c4_parents(s, d))


def c7_report(s: SparkSession, d: str) -> DataFrame:
    return chunking.report(c3_paragraphs(s, d))


def c8_golden_only(s: SparkSession, d: str) -> DataFrame:
    gold = read(s, d, "golden_dataset_template").select(F.col("document_name").alias("filename")).distinct()
    return c3_paragraphs(s, d).join(gold, "filename", "left_semi").groupBy("filename").agg(F.count("*").alias("n_chunks"), F.sum("token_len").alias("n_tokens"))


def c9_blocks(s: SparkSession, d: str) -> DataFrame:
    return chunking.block_stats(read(s, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (
    t1_clean_light, t2_pages_without_pagination, t4_header_and_body, t7_layout, t8_punctuation_and_space, t11_plain, t13_names_and_numbers, t18_cut, x1_header_meta, x2_segments, x5_features, x6_contract_kinds,
    x7_proximity, x8_in_context, x9_section, x10_commercial, x13_courts, x17_health, x19_variants, x20_case_match, x21_chunk_number, k1_tokens, k2_lengths, c1_recursive, c3_paragraphs, c4_parents, c5_children,
    c7_report, c8_golden_only, c9_blocks, t4_body, x2_reasoning, x6_kinds, j13_features, j14_metadata, t6_spaced, t16_numbers, t21_rounded, x4_structure, x11_register, x18_courts, x20_court_match, x22_experiments, x23_entities, x23_money, k5_budget,
)}


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return q(T.portable(pattern, sql=True))


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def sql_plain(x: str) -> str:
    return sql_squash(f"replace(translate(lower(coalesce({x}, '')), '{T._FROM}', '{T._TO}'), '§', 'ss')")


def sql_tokens(x: str) -> str:
    raw = f"regexp_extract_all(regexp_replace(lower(coalesce({x}, '')), '§[ \\t\\n\\r\\f]*(\\d+)', '§\\1', 'g'), {q(T.TOKEN)})"
    stop = "[" + ", ".join(map(q, STOPWORDS)) + "]"
    return f"list_filter({raw}, lambda w: regexp_matches(w, '^[§\\d]') OR (length(w) > 1 AND NOT list_contains({stop}, w)))"


def sql_token_length(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '[^{WS[1:-1]}]+'))"


_FILES = f"(SELECT DISTINCT filename, array_to_string(list_transform(coalesce(raw_pages, []), lambda p: {sql_strip('coalesce(p, ' + q('') + ')')}), chr(10)) AS text FROM pipeline_data)"
_NOPAGES = f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT (regexp_matches({sql_strip('l')}, '^(?i)strana{WS}+\\d+({WS}*z{WS}*\\d+)?$') OR regexp_matches({sql_strip('l')}, '^-{WS}*\\d+{WS}*-$') OR regexp_matches({sql_strip('l')}, '^(?i)pokračovanie{WS}*\\.{{0,3}}$'))), chr(10))"
_HEAD = q(f"\\n{WS}*(?i:ROZSUDOK|UZNESENIE|ROZSUDOK{WS}+V{WS}+MENE{WS}+SLOVENSKEJ{WS}+REPUBLIKY){WS}*\\n")
_WHY = q(f"(?i)(?:{f'{WS}*'.join(['[oó]', 'd', '[oóô]', *'vodnenie'])}|odôvodnenie)")
_HOW = q(f"(?i)(?:{f'{WS}*'.join('poučenie')}|poučenie)")
_META = lambda p, g=1: f"nullif(regexp_extract(coalesce(header, ''), {q(p)}, {g}), '')"
_REASONS = "(SELECT DISTINCT filename, court, segments.reasoning AS reasoning FROM processed_json)"
_BARE = f"regexp_replace(coalesce(reasoning, ''), '^(?i)[oó]d[oôó]vodnenie{WS}*:?{WS}*', '')"
_POINTS = f"""(SELECT filename, court, CASE WHEN regexp_matches(t, '(?m)^{WS}*\\d+\\.{WS}+') THEN list_filter(list_transform(string_split(regexp_replace(t, '(?m)^({WS}*\\d+\\.{WS}+)', chr(1) || '\\1', 'g'), chr(1)), lambda p: {sql_strip('p')}), lambda p: p <> '')
  ELSE list_filter(list_transform(string_split_regex(t, '\\n\\n+'), lambda p: {sql_strip('p')}), lambda p: p <> '' AND NOT ({sql_token_length('p')} <= 1 AND length(p) <= 2)) END AS parts
  FROM (SELECT filename, court, {_BARE} AS t FROM {_REASONS} WHERE {sql_strip("coalesce(reasoning, '')")} <> ''))"""
_PARAS = f"(SELECT filename, court, CAST(i - 1 AS INTEGER) AS chunk_index, p AS page_content, 'paragraph' AS strategy, CAST(length(p) AS INTEGER) AS char_len, CAST({sql_token_length('p')} AS INTEGER) AS token_len FROM (SELECT filename, court, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS p FROM {_POINTS}))"
_VARIANTS = lambda c: f"""list_distinct([replace(trim({c}), '\\', '/'), replace(replace(trim({c}), '\\', '/'), ' ', ''), replace(replace(trim({c}), '\\', '/'), '/ ', '/'),
 CASE WHEN regexp_matches({c}, {_SPLIT}) THEN regexp_extract({c}, {_SPLIT}, 1) || regexp_extract({c}, {_SPLIT}, 2) || '/' || regexp_extract({c}, {_SPLIT}, 3) ELSE {c} END,
 CASE WHEN regexp_matches({c}, {_SPLIT}) THEN regexp_extract({c}, {_SPLIT}, 1) || ' ' || regexp_extract({c}, {_SPLIT}, 2) || ' ' || regexp_extract({c}, {_SPLIT}, 3) ELSE {c} END,
 CASE WHEN regexp_matches({c}, {_SPLIT}) THEN regexp_extract({c}, {_SPLIT}, 1) || ' ' || regexp_extract({c}, {_SPLIT}, 2) || ' ' || replace(regexp_extract({c}, {_SPLIT}, 3), '/', ' ') ELSE {c} END,
 CASE WHEN regexp_matches({c}, {_SPLIT}) THEN regexp_extract({c}, {_SPLIT}, 1) || regexp_extract({c}, {_SPLIT}, 2) || ' ' || regexp_extract({c}, {_SPLIT}, 3) ELSE {c} END])"""  # noqa: E731
_SPLIT = r"'^(\d+)\s*([a-zA-Z]+)\s*[/\s]*\s*(.+)$'"
_TIER = " ".join(f"WHEN starts_with(n, '{a.lower()}') OR contains(n, '{b}') THEN '{a}'" for a, b in (("NS", "najvyšší súd"), ("KS", "krajský súd"), ("OS", "okresný súd"), ("MS", "mestský súd"), ("US", "ústavný súd")))

SQL = {
    "t1_clean_light": "SELECT DISTINCT chunk_id, replace(replace(translate(nfc_normalize(coalesce(page_content, '')), chr(8203) || chr(173), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM chunks",
    "t2_pages_without_pagination": f"SELECT filename, {_NOPAGES} AS text FROM {_FILES}",
    "t4_header_and_body": f"""SELECT filename, CASE WHEN h <> '' THEN {sql_strip("left(text, instr(text, h) - 1)")} WHEN e <> '' THEN {sql_strip("left(text, instr(text, e) - 1 + length(e))")} ELSE left(text, 1000) END AS header,
      length(CASE WHEN h <> '' THEN {sql_strip("substr(text, instr(text, h))")} WHEN e <> '' THEN {sql_strip("substr(text, instr(text, e) + length(e))")} ELSE substr(text, 1001) END) AS n_body
      FROM (SELECT filename, text, regexp_extract(text, {_HEAD}) AS h, regexp_extract(text, 'ECLI:[^\\n]+\\n') AS e FROM {_FILES})""",
    "t8_punctuation_and_space": f"SELECT DISTINCT chunk_id, regexp_replace(translate(coalesce(page_content, ''), '–—„“”', '--\"\"\"'), '{WS}+([.,;:!?)])', '\\1', 'g') AS unicode, {sql_squash('page_content')} AS squashed, regexp_replace(coalesce(page_content, ''), '{WS}+([.,;:!?)\\]])', '\\1', 'g') AS tight FROM chunks",
    "t11_plain": f"SELECT doc_id, {sql_plain('text')} AS plain FROM documents",
    "t13_names_and_numbers": "SELECT o_orderkey, regexp_replace(o_orderpriority, '[<>:\"/\\\\|?*\\s]+', '_', 'g') AS safe, CAST(year(o_orderdate) AS INTEGER) AS year, replace(format('{:,.0f}', o_totalprice), ',', ' ') AS price, format('o_{:03d}', o_custkey) AS padded, CAST(NULL AS DOUBLE) AS number FROM orders",
    "t18_cut": "SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN instr(left(t, 200), ' ') > 1 THEN regexp_extract(left(t, 200), '(?s)^(.*) [^ ]*$', 1) ELSE left(t, 200) END AS cut FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]', ' ', 'g') AS t FROM documents)",
    "x1_header_meta": f"""SELECT DISTINCT filename, replace({_META(rf'(\d{{1,2}}\.{WS}*\d{{1,2}}\.{WS}*\d{{4}})')}, ' ', '') AS date_raw, {_META(rf'(?i)Spisová{WS}*značka:?{WS}*([\p{{L}}\p{{N}}_/]+)')} AS case_id, {_META(r'(ECLI:[A-Z0-9:.]+)')} AS ecli,
      coalesce({sql_strip(_META(rf'Súd:{WS}*([^\n]+)'))}, '') AS court, upper(left(k, 1)) || lower(substr(k, 2)) AS document_type FROM (SELECT *, nullif(regexp_extract(coalesce(header, ''), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(ROZSUDOK|UZNESENIE)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') AS k FROM processed_json)""",
    "x2_segments": f"""SELECT filename, CASE WHEN r <> '' THEN {sql_strip("left(text, instr(text, r) - 1)")} ELSE text END AS verdict, length(CASE WHEN r <> '' AND i <> '' THEN {sql_strip("left(rest, instr(rest, i) - 1)")} WHEN r <> '' THEN rest ELSE '' END) AS n_reasoning,
      CASE WHEN r <> '' AND i <> '' THEN {sql_strip("substr(rest, instr(rest, i))")} ELSE '' END AS instruction FROM (SELECT *, regexp_extract(rest, {_HOW}) AS i FROM (SELECT *, {sql_strip("substr(text, instr(text, r))")} AS rest FROM (SELECT filename, text, regexp_extract(text, {_WHY}) AS r FROM {_FILES})))""",
    "x5_features": "SELECT *, CASE WHEN has_oz_545a > 0 THEN '4_CIVIL_NOISE_LIKELY' WHEN has_penalty > 0 AND has_301 > 0 AND has_moder_trig > 0 THEN '1_GOLD_MODERATION' WHEN has_penalty > 0 AND has_301 > 0 THEN '2_STRONG_CANDIDATE' WHEN has_penalty > 0 THEN '3_PENALTY_NO_MODERATION' ELSE '5_IRRELEVANT' END AS label FROM (SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(t, {re2(p)})) AS {n}" for n, p in FEATURES.items()) + f" FROM (SELECT doc_id, {sql_plain('text')} AS t FROM documents))",
    "x6_contract_kinds": "SELECT contract_kind, count(*) AS n FROM (SELECT unnest(CASE WHEN len(h) > 0 THEN h ELSE ['unknown/other'] END) AS contract_kind FROM (SELECT list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {re2(p)}) THEN '{n}' END" for n, p in CONTRACTS.items()) + f"], lambda x: x IS NOT NULL) AS h FROM (SELECT {sql_plain('text')} AS t FROM documents))) GROUP BY contract_kind",
    "x8_in_context": f"SELECT doc_id, substr(text, greatest(instr(text, h) - 40, 1), instr(text, h) - greatest(instr(text, h) - 40, 1)) || '>>>' || h || '<<<' || substr(text, instr(text, h) + length(h), 40) AS context FROM (SELECT doc_id, coalesce(text, '') AS text, nullif(regexp_extract(coalesce(text, ''), {re2('pokut' + chr(92) + 'w*')}), '') AS h FROM documents) WHERE h IS NOT NULL",
    "x10_commercial": "SELECT doc_id, contains(lower(coalesce(domain, '')), 'obchod') OR contains(lower(coalesce(case_id, '')), 'obdo') OR contains(lower(coalesce(case_id, '')), 'obo') OR contains(lower(coalesce(case_id, '')), 'cob') AS commercial, contains(lower(coalesce(case_id, '')), 'obdo') OR contains(lower(coalesce(case_id, '')), 'cob') AS register FROM documents",
    "x13_courts": f"SELECT court, CASE {_TIER} ELSE 'OTHER' END AS court_tier, CAST(CASE WHEN contains(n, 'najvy') THEN 3 WHEN contains(n, 'krajsk') THEN 2 ELSE 1 END AS INTEGER) AS authority_level FROM (SELECT DISTINCT court, lower(coalesce(court, '')) AS n FROM processed_json)",
    "x17_health": f"SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'short' WHEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) / length(text) < 0.4 THEN 'garbled' ELSE 'passed' END AS health, length(text) AS n_chars FROM (SELECT doc_id, text, length({sql_strip("coalesce(text, '')")}) AS n FROM documents)",
    "x19_variants": f"SELECT case_id, unnest({_VARIANTS('case_id')}) AS variant FROM (SELECT DISTINCT metadata.case_id AS case_id FROM processed_json WHERE metadata.case_id IS NOT NULL)",
    "x20_case_match": f"SELECT extraction_id, min(filename) AS filename FROM (SELECT extraction_id, unnest({_VARIANTS('result.meta.case_number')}) AS v FROM extractions WHERE result.meta.case_number IS NOT NULL) a JOIN (SELECT filename, unnest({_VARIANTS('metadata.case_id')}) AS v FROM processed_json WHERE metadata.case_id IS NOT NULL) b USING (v) GROUP BY extraction_id",
    "x21_chunk_number": "SELECT DISTINCT chunk_id, coalesce(try_cast(regexp_extract(chunk_id, '_chunk_(\\d+)$', 1) AS INTEGER), -1) AS number FROM chunks",
    "k1_tokens": f"SELECT DISTINCT chunk_id, array_to_string({sql_tokens('page_content')}, ' ') AS tokens FROM chunks",
    "k2_lengths": f"SELECT DISTINCT chunk_id, {sql_token_length('page_content')} AS n_tokens, CAST(floor(length(coalesce(page_content, '')) / 4) AS INTEGER) AS n_rough, array_to_string(string_split({sql_squash('page_content')}, ' ')[1:12], ' ') AS head FROM chunks",
    "c3_paragraphs": f"SELECT * FROM {_PARAS}",
    "c4_parents": f"""SELECT filename AS source_file, format('{{}}_parent_{{:03d}}', regexp_replace(filename, '\\.[\\p{{L}}\\p{{N}}_]+$', ''), chunk_index) AS parent_id, chunk_index AS parent_index, coalesce(try_cast(regexp_extract(page_content, '^{WS}*(\\d+)\\.', 1) AS INTEGER), -1) AS point_number,
      round_even((chunk_index + 0.5) / count(*) OVER (PARTITION BY filename, court), 4) AS position_ratio, char_len, token_len, page_content FROM {_PARAS}""",
    "c7_report": f"SELECT strategy, count(*) AS n_chunks, count(DISTINCT filename) AS n_docs, round_even(count(*) / count(DISTINCT filename), 6) AS per_doc FROM {_PARAS} GROUP BY strategy",
    "c8_golden_only": f"SELECT filename, count(*) AS n_chunks, sum(token_len) AS n_tokens FROM {_PARAS} WHERE filename IN (SELECT document_name FROM golden_dataset_template) GROUP BY filename",
    "c9_blocks": f"SELECT doc_id, count(*) AS n_blocks, max(n) AS longest, round_even(quantile_cont(n, 0.95), 6) AS p95 FROM (SELECT doc_id, length({sql_squash('b')}) AS n FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n{WS}*\\n')) AS b FROM documents)) WHERE n > 0 GROUP BY doc_id",
    "t4_body": f"""SELECT filename, CASE WHEN h <> '' THEN {sql_strip("substr(text, instr(text, h))")} WHEN e <> '' THEN {sql_strip("substr(text, instr(text, e) + length(e))")} ELSE substr(text, 1001) END AS body FROM (SELECT filename, text, regexp_extract(text, {_HEAD}) AS h, regexp_extract(text, 'ECLI:[^\\n]+\\n') AS e FROM {_FILES})""",
    "x2_reasoning": f"""SELECT filename, CASE WHEN r <> '' AND i <> '' THEN {sql_strip("left(rest, instr(rest, i) - 1)")} WHEN r <> '' THEN rest ELSE '' END AS reasoning FROM (SELECT *, regexp_extract(rest, {_HOW}) AS i FROM (SELECT *, {sql_strip("substr(text, instr(text, r))")} AS rest FROM (SELECT filename, text, regexp_extract(text, {_WHY}) AS r FROM {_FILES})))""",
    "x6_kinds": "SELECT doc_id, CASE WHEN len(h) > 0 THEN array_to_string(h, ',') ELSE 'unknown/other' END AS kinds FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {re2(p)}) THEN '{n}' END" for n, p in CONTRACTS.items()) + f"], lambda x: x IS NOT NULL) AS h FROM (SELECT doc_id, {sql_plain('text')} AS t FROM documents))",
    "j13_features": "SELECT DISTINCT filename, p.court AS court, court_code, tier, town FROM processed_json p LEFT JOIN courts c ON c.court = p.court",
    "j14_metadata": "SELECT DISTINCT filename, coalesce(nullif(trim(court), ''), nullif(trim(metadata.court), ''), 'Unknown') AS court_name, coalesce(nullif(trim(metadata.case_id), ''), CASE WHEN len(string_split(filename, '_')) >= 5 THEN array_to_string(string_split(filename, '_')[3:5], '/') END, 'Unknown') AS docket, coalesce(nullif(trim(metadata.document_type), ''), 'Unknown') AS kind, coalesce(nullif(trim(metadata.ecli), ''), 'Unknown') AS ecli FROM processed_json",
    "t6_spaced": f"SELECT DISTINCT filename, line FROM (SELECT filename, unnest(string_split(text, chr(10))) AS line FROM {_FILES}) WHERE length(trim(regexp_replace(line, '[.:]+$', ''))) >= 5 AND regexp_matches(trim(regexp_replace(line, '[.:]+$', '')), '^{WS}*(?:[a-zA-ZÁ-Žá-ž]{WS}+){{3,}}[a-zA-ZÁ-Žá-ž]{WS}*$')",
    "t16_numbers": "SELECT DISTINCT chunk_id, try_cast(nullif(regexp_extract(page_content, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS first, try_cast(case_id AS DOUBLE) AS docket FROM chunks",
    "t21_rounded": "SELECT l_orderkey, l_linenumber, round_even(l_quantity::DOUBLE / 2, 0) AS half, round_even(l_quantity::DOUBLE / 4, 1) AS quarter FROM lineitem",
    "x4_structure": "SELECT doc_id, " + ", ".join(f"CAST(regexp_matches(t, {re2(p)}) AS INTEGER) AS {n}" for n, p in T.STRUCTURE.items()) + f" FROM (SELECT doc_id, {sql_plain('text')} AS t FROM documents)",
    "x11_register": "SELECT doc_id, len(list_filter([" + ", ".join(map(q, T.TRADE)) + "], lambda m: contains(lower(coalesce(case_id, '')), m))) > 0 AS in_register FROM documents",
    "x18_courts": "WITH n AS (SELECT court AS name FROM courts UNION SELECT court_code FROM courts UNION SELECT * FROM (VALUES " + ", ".join(f"({q(n)})" for n in T.COURT_NAMES) + ")), m(name, official) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in T.COURT_NAMES.items()) + ") SELECT n.name AS name, coalesce(m.official, n.name) AS official FROM n LEFT JOIN m ON m.name = n.name",
    "x20_court_match": """WITH a AS (SELECT DISTINCT extraction_id, lower(replace(replace(result.meta.case_number, ' ', ''), '/', '')) AS a, coalesce(result.meta.court_name, '') AS asked, regexp_replace(result.meta.case_number, '[^0-9]', '', 'g') AS k FROM extractions WHERE result.meta.case_number IS NOT NULL),
      f AS (SELECT DISTINCT filename, lower(replace(replace(metadata.case_id, ' ', ''), '/', '')) AS f, lower(coalesce(metadata.court, '')) AS found, regexp_replace(metadata.case_id, '[^0-9]', '', 'g') AS k FROM processed_json WHERE metadata.case_id IS NOT NULL)
      SELECT extraction_id, min(filename) AS filename FROM a JOIN f ON a.k = f.k WHERE contains(f, a) AND ((contains(lower(asked), 'najvyšší') AND contains(found, 'najvyšší')) OR contains(found, lower(replace(asked, 'Krajský súd ', '')))) GROUP BY extraction_id""",
    "x22_experiments": "SELECT DISTINCT name, regexp_replace(regexp_replace(name, '_top[0-9]+_w[0-9]+$', ''), '_fk[0-9]+_c1p[0-9]+_c2p[0-9]+$', '') AS family, try_cast(nullif(regexp_extract(name, 'top([0-9]+)', 1), '') AS INTEGER) AS k, try_cast(nullif(regexp_extract(name, 'w([0-9]+)', 1), '') AS INTEGER) AS \"window\" FROM (SELECT extraction_config.retrieval_config.name || '_w' || coalesce(extraction_config.retrieval_config.window_size, 0) AS name FROM extractions) WHERE name IS NOT NULL",
    "x23_entities": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), {re2(p)})) AS {n}" for n, p in T.ENTITIES.items() if n != "money") + " FROM documents",
    "k5_budget": f"SELECT DISTINCT filename, {sql_token_length('kept')} AS n_kept, kept FROM (SELECT filename, array_to_string(string_split({sql_squash('reasoning_full')}, ' ')[1:greatest(600 - {sql_token_length('header')} - {sql_token_length('segments.verdict')}, 0)], ' ') AS kept FROM processed_json)",
}
