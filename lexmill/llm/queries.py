"""Queries of the subpackage and, where SQL can state them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, read, spread
from . import leakage, lookalike, packing, scans, sentences, site_lines, token_budget


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = site_lines.found_lines(read(spark, sf_dir, "processed_json"), "court", "filename", "header")
    return lines.select(F.col("doc").alias("filename"), "line_no")


def p3_heavy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = site_lines.heavy_lines(read(spark, sf_dir, "processed_json"), "court", "filename", "header")
    return heavy.select(F.col("source").alias("court"), F.col("norm").alias("line"), "n_docs", "n_all")


def p3_clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = read(spark, sf_dir, "processed_json").select("filename", "court", "header").distinct()
    return site_lines.cleaned(once, "court", "filename", "header").select("filename", "court", "clean_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = lookalike.same_look_pairs(spread(read(spark, sf_dir, "chunks").select("chunk_id", "page_content")), "chunk_id", F.col("page_content"))
    pages = lookalike.same_look_pairs(spread(read(spark, sf_dir, "pipeline_data").select("filename", "raw_pages")), "filename", lookalike.pages_text("raw_pages"))
    named = lambda df, f: df.select(F.lit(f).alias("field_name"), "key_a", "key_b")
    return named(chunks, "page_content").unionByName(named(pages, "raw_pages"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.groups(read(spark, sf_dir, "chunks"), "chunk_id", F.col("page_content"))


def p5_form_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.form_pairs(read(spark, sf_dir, "chunks"), "chunk_id", F.col("page_content"))


def p5_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of both fields in their one form, each key once per form."""
    chunks = lookalike.with_one_form(read(spark, sf_dir, "chunks").select(F.lit("page_content").alias("field_name"), F.col("chunk_id").alias("key"), F.col("page_content").alias("text")), "text")
    pages = lookalike.with_one_form(read(spark, sf_dir, "pipeline_data").select(F.lit("raw_pages").alias("field_name"), F.col("filename").alias("key"), F.array_join("raw_pages", "\n", "").alias("text")), "text")
    return chunks.unionByName(pages).where("key IS NOT NULL AND one_form IS NOT NULL").select("field_name", "key", "one_form").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "eval_items"))


def p9_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.reparameterised(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_heavy_lines, p3_clean_headers, p5_found, p5_groups, p5_form_pairs, p5_one_form, p9_found, p9_reparameterised, p10_found)
}

_LINES = """WITH l AS (SELECT court, filename, x.i - 1 AS line_no, x.line AS line FROM (
   SELECT court, filename, unnest(list_zip(range(1, len(string_split(header, chr(10))) + 1), string_split(header, chr(10)))) AS y
   FROM (SELECT DISTINCT court, filename, header FROM processed_json WHERE court IS NOT NULL AND header IS NOT NULL)) t, LATERAL (SELECT y[1] AS i, y[2] AS line) x),
 n AS (SELECT court, filename, line_no, regexp_replace(regexp_replace(lower(line), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x0B]+', ' ', 'g'), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS norm FROM l
   WHERE NOT (starts_with(line, 'Súd:') OR starts_with(line, 'Spisová značka:') OR starts_with(line, 'Identifikačné číslo súdneho spisu:')
     OR starts_with(line, 'Dátum vydania rozhodnutia:') OR starts_with(line, 'Meno a priezvisko sudcu, VSÚ:') OR starts_with(line, 'ECLI:'))),
 a AS (SELECT court, count(DISTINCT filename) AS n_all FROM processed_json WHERE court IS NOT NULL GROUP BY court),
 h AS (SELECT n.court, norm, count(DISTINCT filename) AS n_docs, any_value(n_all) AS n_all FROM n JOIN a USING (court) WHERE norm <> ''
   GROUP BY n.court, norm HAVING count(DISTINCT filename) >= 3 AND count(DISTINCT filename) >= 0.2 * any_value(n_all))
"""

SQL: dict[str, str] = {
    "p3_found": _LINES + "SELECT DISTINCT filename, CAST(line_no AS INTEGER) AS line_no FROM n JOIN h ON n.court = h.court AND n.norm = h.norm",
    "p3_heavy_lines": _LINES + "SELECT court, norm AS line, n_docs, n_all FROM h",
}


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "pipeline_data").select("filename", "court", "raw_pages", "ingested_at")
    return scans.inputs(spread(raw), spread(read(spark, sf_dir, "processed_json").select("filename", "court", "header", "ingested_at")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(_scans(spark, sf_dir))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.restored(_scans(spark, sf_dir))


QUERIES |= {"p1_found": p1_found, "p1_restored": p1_restored}


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = token_budget.units("decision", spread(read(spark, sf_dir, "processed_json").select("filename", "reasoning_full", "ingested_at", "court", "lang", "domain")), "filename", "reasoning_full", "ingested_at", "court", "lang", "domain")
    b = token_budget.units("document", spread(read(spark, sf_dir, "documents").select("doc_id", "text", "loaded_at", "source", "lang", "domain")), "doc_id", "text", "loaded_at", "source", "lang", "domain")
    return a.unionByName(b)


def p7_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir)
    change = token_budget.deltas(None, token_budget.documents(rows), token_budget.new_counts(rows))
    return token_budget.updated(None, change)


def p7_token_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed deltas that bring the slices of the older half of the time span to those of the whole tables; contents of the older half are not encoded again."""
    rows = _units(spark, sf_dir)
    span = rows.agg(F.min("at").cast("double").alias("a"), F.max("at").cast("double").alias("b")).first()
    half = F.timestamp_seconds(F.lit(((span["a"] or 0.0) + (span["b"] or 0.0)) / 2))
    before, _ = token_budget.State().update(rows.where(F.col("at") < half))
    return before.update(rows)[1]


def p7_token_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget.cube(p7_token_totals(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", token_budget.token_count("text").alias("n_tokens"))
    return packing.placed(checkpointed(sized), read(spark, sf_dir, "containers"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


def _instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as instruction data: verdict and instruction are given, the reasoning bears the loss; the latest delivery of each."""
    given = F.concat_ws("\n", "segments.verdict", "segments.instruction")
    sized = read(spark, sf_dir, "processed_json").select("filename", "ingested_at", token_budget.token_count(given).alias("given"), token_budget.token_count("reasoning_full").alias("loss"))
    once = sized.groupBy("filename").agg(F.max(F.struct("ingested_at", "given", "loss")).alias("x"))
    return once.select("filename", (F.col("x.given") + F.col("x.loss")).alias("n_tokens"), F.col("x.loss").alias("loss"))


#: tokens of capacity per segment, and share of the capacity that may bear loss, for instruction data
INSTRUCTION = {"tokens_a_segment": 160.0, "loss_share": 0.8}


def p8_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed(checkpointed(_instructions(spark, sf_dir)), read(spark, sf_dir, "containers"), key="filename", loss="loss", **INSTRUCTION)


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of both placements is not as it should be, by kind of container."""
    kinds = read(spark, sf_dir, "containers")
    docs = checkpointed(spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", token_budget.token_count("text").alias("n_tokens")))
    told = checkpointed(_instructions(spark, sf_dir))
    a = packing.audit(checkpointed(packing.placed(docs, kinds)), docs, kinds)
    b = packing.audit(checkpointed(packing.placed(told, kinds, key="filename", loss="loss", **INSTRUCTION)), told, kinds, key="filename", **INSTRUCTION)
    return a.withColumn("data", F.lit("documents")).unionByName(b.withColumn("data", F.lit("instructions")))


def p8_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.utilisation(_placed(spark, sf_dir), read(spark, sf_dir, "containers"))


QUERIES |= {f.__name__: f for f in (p7_token_totals, p7_token_updates, p7_token_cube, p8_containers, p8_instructions, p8_audit, p8_utilisation)}
