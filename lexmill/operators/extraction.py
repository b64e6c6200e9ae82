"""Around structured extraction: prompts, tolerant parsing, merging, grounding of quotes, rule checks.

The model call itself is a plug-in: a function over pandas batches given to ``answers``; the default
replays stored responses by a join.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import FACTOR_LABELS
from ..functions.text import WS, squash, tight_punctuation, tokens


def rendered(chunks: Column | str) -> Column:
    """Chunks (chunk_id, text) as a numbered list."""
    c = F.col(chunks) if isinstance(chunks, str) else chunks
    return F.array_join(F.transform(c, lambda x, i: F.concat(F.lit("[CHUNK "), i + 1, F.lit("] ("), x["chunk_id"], F.lit(")\n"), x["text"])), "\n\n")


def prompt(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places filled by columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def answers(prompts: DataFrame, stored: DataFrame | None = None, client: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """(doc, response): of a client over batches (doc, prompt), or of stored responses."""
    if client is None:
        return prompts.select("doc").join(stored, "doc", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(client, batches)

    return prompts.select("doc", "prompt").mapInPandas(run, "doc string, response string")


def json_of(text: Column | str) -> Column:
    """The JSON object in a response: the whole, a fenced block, or from the first brace to the last; null if none parses."""
    t = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    good = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x)
    return F.coalesce(good(t), good(fenced), good(braces))


def without_evidence(penalties: Column | str) -> Column:
    """Penalties without the evidence members, as the second call sees them."""
    p = F.col(penalties) if isinstance(penalties, str) else penalties
    bare = lambda x: x.withField("breach_type", x["breach_type"].dropFields("evidence")).withField("rate_definition", x["rate_definition"].dropFields("evidence"))
    amounts = lambda x: x.withField(
        "amounts", F.struct(x["amounts"]["currency"].alias("currency"), *[x["amounts"][n]["value"].alias(n) for n in ("secured_principal", "original_claimed", "final_awarded")])
    )
    return F.transform(p, lambda x: amounts(bare(x)).dropFields("associated_interest", "moderation_analysis"))


def merged_calls(facts: DataFrame, moderation: DataFrame) -> DataFrame:
    """(doc, penalty_no, penalty_id, decision, summary, matched): facts LEFT JOIN moderation; of repeated ids the last counts, unmatched ones are unclear."""
    last = F.row_number().over(Window.partitionBy("doc", "penalty_id").orderBy(F.desc("no")))
    mod = moderation.withColumn("k", last).where("k = 1").select("doc", "penalty_id", "decision", "summary", F.lit(True).alias("matched"))
    out = facts.join(mod, ["doc", "penalty_id"], "left")
    return out.select("doc", "penalty_no", "penalty_id", F.coalesce("decision", F.lit("unclear")).alias("decision"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("matched", F.lit(False)).alias("matched"))


def default_factors() -> Column:
    """The seven factors, none mentioned."""
    return F.array(*[F.struct(F.lit(n).alias("label"), F.lit("not_mentioned").alias("sentiment")) for n in FACTOR_LABELS])


def stripped(json_text: Column | str, members: tuple[str, ...] = ("evidence", "chunk_id")) -> Column:
    """A JSON text of any shape without the named members, at every depth; null for what does not parse."""
    def bare(o: object) -> object:
        if isinstance(o, dict):
            return {k: bare(v) for k, v in o.items() if k not in members}
        return [bare(x) for x in o] if isinstance(o, list) else o

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(bare(json.loads(t)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return F.pandas_udf(lambda s: s.map(one), "string")(F.col(json_text) if isinstance(json_text, str) else json_text)


# Parts of the prompts of each call, by the places that they fill.
TEMPLATES = {
    "system": "Odpovedaj len platným JSON podľa schémy.", "call1": "HLAVIČKA\n{header}\n\nVÝROK\n{verdict}\n\nÚRYVKY\n{chunks}",
    "call2": "ZISTENÉ\n{prefilled}\n\nVÝROK\n{verdict}\n\nÚRYVKY\n{chunks}", "fulldoc": "HLAVIČKA\n{header}\n\nVÝROK\n{verdict}\n\nODÔVODNENIE\n{reasoning}",
}


def templates(folder: str | None = None) -> dict[str, str]:
    """The templates, those of a folder (``<name>.txt``) before the own ones; read once by the driver, as they are literals of the plan."""
    if folder is None:
        return dict(TEMPLATES)
    own = {}
    for name, text in TEMPLATES.items():
        path = os.path.join(folder, f"{name}.txt")
        own[name] = open(path, encoding="utf-8").read() if os.path.exists(path) else text  # noqa: SIM115
    return own


def prompts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc, system, call1, call2, fulldoc): the four prompts of each document. ``docs``: (doc, header, verdict, reasoning, call1_chunks, call2_chunks, facts); ``facts``: the first call's JSON, of which the second sees all but the evidence."""
    t = templates(folder)
    c = F.col
    return docs.select(
        "doc", F.lit(t["system"]).alias("system"), prompt(t["call1"], header=c("header"), verdict=c("verdict"), chunks=rendered("call1_chunks")).alias("call1"),
        prompt(t["call2"], prefilled=stripped("facts"), verdict=c("verdict"), chunks=rendered("call2_chunks")).alias("call2"), prompt(t["fulldoc"], header=c("header"), verdict=c("verdict"), reasoning=c("reasoning")).alias("fulldoc"),
    )


def json_schema(kind: T.DataType, closed: bool = True) -> dict:
    """The JSON schema of a table's type, the single source of both; ``closed``: objects allow no further members."""
    if isinstance(kind, T.StructType):
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType, closed) for f in kind}, "required": [f.name for f in kind]}
        return out | ({"additionalProperties": False} if closed else {})
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, closed)}
    names = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number", T.DecimalType: "number"}
    return {"type": names.get(type(kind), "integer" if isinstance(kind, T.IntegralType) else "string")}


def without_additional(schema: object) -> object:
    """A schema without ``additionalProperties``, at every depth."""
    if isinstance(schema, dict):
        return {k: without_additional(v) for k, v in schema.items() if k != "additionalProperties"}
    return [without_additional(x) for x in schema] if isinstance(schema, list) else schema


def retried(call: Callable[[str], str], times: int = 5, wait: Callable[[int, Exception | None], float | None] = lambda n, e: 30.0 * n, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A model call that is tried up to ``times`` times. ``wait``: seconds before the next try after the n-th failed with an
    exception, or with an empty answer (None); None gives up. The last failure is raised, or the empty answer returned.
    """
    def run(text: str) -> str:
        for n in range(1, times + 1):
            try:
                out, error = call(text), None
            except Exception as e:  # noqa: BLE001 - the policy decides which errors are tried again
                out, error = "", e
            if out:
                return out
            pause = wait(n, error) if n < times else None
            if pause is None:
                if error is not None:
                    raise error
                return out
            sleep(pause)
        return ""

    return run


_EVIDENCE = """inline(flatten(transform(filter(coalesce(result.contractual_penalties, array()), p -> p IS NOT NULL), (p, i) -> filter(concat(
 array(named_struct('penalty_no', i, 'field_path', 'breach_type', 'quote', p.breach_type.evidence.quote, 'chunk_id', p.breach_type.evidence.chunk_id),
  named_struct('penalty_no', i, 'field_path', 'rate_definition', 'quote', p.rate_definition.evidence.quote, 'chunk_id', p.rate_definition.evidence.chunk_id),
  named_struct('penalty_no', i, 'field_path', 'amounts.secured_principal', 'quote', p.amounts.secured_principal.evidence.quote, 'chunk_id', p.amounts.secured_principal.evidence.chunk_id),
  named_struct('penalty_no', i, 'field_path', 'amounts.original_claimed', 'quote', p.amounts.original_claimed.evidence.quote, 'chunk_id', p.amounts.original_claimed.evidence.chunk_id),
  named_struct('penalty_no', i, 'field_path', 'amounts.final_awarded', 'quote', p.amounts.final_awarded.evidence.quote, 'chunk_id', p.amounts.final_awarded.evidence.chunk_id),
  named_struct('penalty_no', i, 'field_path', 'associated_interest', 'quote', p.associated_interest.evidence.quote, 'chunk_id', p.associated_interest.evidence.chunk_id),
  named_struct('penalty_no', i, 'field_path', 'decision', 'quote', p.moderation_analysis.decision.evidence.quote, 'chunk_id', p.moderation_analysis.decision.evidence.chunk_id)),
 transform(coalesce(p.moderation_analysis.key_quotes, array()), (k, j) -> named_struct('penalty_no', i, 'field_path', 'key_quotes.' || j, 'quote', k.quote, 'chunk_id', k.chunk_id)),
 transform(coalesce(p.moderation_analysis.factors, array()), (f, j) -> named_struct('penalty_no', i, 'field_path', 'factors.' || j, 'quote', f.evidence.quote, 'chunk_id', f.evidence.chunk_id))),
 e -> coalesce(e.quote, '') <> '' AND coalesce(e.chunk_id, '') <> ''))))"""


def evidence(extractions: DataFrame) -> DataFrame:
    """(extraction_id, source_file, penalty_no, field_path, quote, chunk_id): every quote with its source; penalties numbered without null ones."""
    flat = extractions.selectExpr("extraction_id", "result.meta.doc_id || '.pdf' AS source_file", _EVIDENCE)
    return flat.dropDuplicates(["extraction_id", "penalty_no", "field_path"])


def _part_name(c: Column | str) -> Column:
    """The name of a document's part: ``chunk_7`` for it and for a chunk id that ends so; header, verdict and full_doc stay."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^.*_(chunk_\d+)$", "$1")


def lookup(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    """(source_file, part, text): the latest text of every chunk, header, verdict and whole reasoning, by the name that evidence gives it."""
    c = chunks.where("page_content IS NOT NULL AND source_file IS NOT NULL").select("source_file", F.concat(F.lit("chunk_"), "chunk_index").alias("part"), F.col("page_content").alias("text"), "ingested_at")
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.col(x).alias("text")) for n, x in (("header", "header"), ("verdict", "segments.verdict"), ("full_doc", "reasoning_full"))])
    p = processed.where("filename IS NOT NULL").select(F.col("filename").alias("source_file"), "ingested_at", F.inline(parts)).where("text IS NOT NULL").select("source_file", "part", "text", "ingested_at")
    return c.unionByName(p).groupBy("source_file", "part").agg(F.max_by("text", "ingested_at").alias("text"))


def looked_up(evidence: DataFrame, parts: DataFrame) -> DataFrame:
    """Evidence with the ``text`` of the part that it names, and ``flag`` CHUNK_NOT_FOUND where there is none."""
    held = evidence.withColumn("part", _part_name("chunk_id")).join(parts, ["source_file", "part"], "left").drop("part")
    return held.withColumn("flag", F.when(F.col("text").isNull(), "CHUNK_NOT_FOUND"))


def grounded(evidence: DataFrame, texts: DataFrame, least: float = 0.65, lemmas: dict[str, str] | None = None) -> DataFrame:
    """Evidence with ``level``: exact, whitespace, case, words, fuzzy, truncated or not_found; the first that holds.

    ``texts``: (source_file, part, text), see ``lookup``: the part that the evidence names is searched, and no other;
    or (source_file, text), the whole document. Without a text the level is no_source. ``lemmas``: word to lemma, for the
    level of words; words that it lacks stay as they are. The cheap levels are decided first; the word windows run on what is left.
    """
    held = looked_up(evidence, texts).drop("flag") if "part" in texts.columns else evidence.join(texts, "source_file", "left")
    of = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv]) if lemmas else None
    words = lambda x: F.concat(F.lit(" "), F.array_join(tokens(x, of), " "), F.lit(" "))
    q, t = F.col("quote"), F.coalesce("text", F.lit(""))
    flat = lambda x: tight_punctuation(squash(x))
    level = (
        F.when(F.col("text").isNull(), "no_source").when(F.contains(t, q), "exact").when(F.contains(flat(t), flat(q)), "whitespace").when(F.contains(F.lower(flat(t)), F.lower(flat(q))), "case")
        .when(F.contains(words(t), words(q)), "words")
    )
    graded = held.withColumn("level", level)
    done = graded.where("level IS NOT NULL").withColumn("best", F.lit(None).cast("string"))
    fuzzy = F.pandas_udf(lambda a, b: pd.DataFrame([best_window(x, y) for x, y in zip(a, b)], columns=["share", "window"]), "share double, window string")
    rest = graded.where("level IS NULL").withColumn("f", fuzzy(q, t))
    late = F.when(F.col("f.share") >= least, "fuzzy").when(F.contains(F.lower(t), F.lower(F.substring(q, 1, 40))), "truncated").otherwise("not_found")
    rest = rest.withColumn("level", late).withColumn("best", F.when(F.col("f.share") >= least, F.col("f.window"))).drop("f")
    return done.unionByName(rest).select("extraction_id", "source_file", "penalty_no", "field_path", "quote", "level", "best")


def best_window(quote: str, text: str) -> tuple[float, str | None]:
    """Share of the quote's distinct words in the best window of the text, and that window; one pass with running counts."""
    q, words = set(quote.lower().split()), text.split()
    low = [w.lower() for w in words]
    w = min(len(quote.split()) + 3, len(low))
    if not q or not w:
        return 0.0, None
    seen: dict[str, int] = {}
    hit, best, at = 0, -1, 0
    for i, x in enumerate(low):
        if x in q:
            seen[x] = seen.get(x, 0) + 1
            hit += seen[x] == 1
        if i >= w and low[i - w] in q:
            seen[low[i - w]] -= 1
            hit -= seen[low[i - w]] == 0
        if i >= w - 1 and hit > best:
            best, at = hit, i - w + 1
    return best / len(q), " ".join(words[at : at + w])


def repaired(grounded: DataFrame) -> DataFrame:
    """Evidence with fuzzy quotes replaced by the window found."""
    return grounded.withColumn("quote", F.when(F.col("level") == "fuzzy", F.col("best")).otherwise(F.col("quote")))


_CHECKS = """inline(flatten(transform(filter(coalesce(result.contractual_penalties, array()), p -> p IS NOT NULL), p -> filter(array(
 CASE WHEN p.amounts.final_awarded.value > p.amounts.original_claimed.value THEN named_struct('kind', 'flag', 'code', 'MATH_ERROR_AWARDED_EXCEEDS_CLAIMED_' || coalesce(p.penalty_id, 'unknown')) END,
 CASE WHEN p.moderation_analysis.decision.value = 'moderated_301' AND p.amounts.final_awarded.value = p.amounts.original_claimed.value THEN named_struct('kind', 'flag', 'code', 'LOGIC_ERROR_MODERATION_BUT_SAME_AMOUNT_' || coalesce(p.penalty_id, 'unknown')) END,
 CASE WHEN p.moderation_analysis.decision.value = 'dismissed' AND p.moderation_analysis.decision.dismissal_reason IS NULL THEN named_struct('kind', 'flag', 'code', 'MISSING_DISMISSAL_REASON_' || coalesce(p.penalty_id, 'unknown')) END,
 CASE WHEN p.amounts.secured_principal.value IS NOT NULL AND p.amounts.secured_principal.evidence.quote RLIKE 'X{2,}' THEN named_struct('kind', 'flag', 'code', 'ANONYMIZED_AMOUNT_secured_principal_' || coalesce(p.penalty_id, 'unknown')) END,
 CASE WHEN p.amounts.original_claimed.value IS NOT NULL AND p.amounts.original_claimed.evidence.quote RLIKE 'X{2,}' THEN named_struct('kind', 'flag', 'code', 'ANONYMIZED_AMOUNT_original_claimed_' || coalesce(p.penalty_id, 'unknown')) END,
 CASE WHEN p.amounts.final_awarded.value IS NOT NULL AND p.amounts.final_awarded.evidence.quote RLIKE 'X{2,}' THEN named_struct('kind', 'flag', 'code', 'ANONYMIZED_AMOUNT_final_awarded_' || coalesce(p.penalty_id, 'unknown')) END,
 CASE WHEN coalesce(p.breach_type.value, '') = '' THEN named_struct('kind', 'missing', 'code', coalesce(p.penalty_id, 'unknown') || '.breach_type') END,
 CASE WHEN coalesce(p.rate_definition.type, '') = '' THEN named_struct('kind', 'missing', 'code', coalesce(p.penalty_id, 'unknown') || '.rate_definition') END,
 CASE WHEN p.amounts.original_claimed.value IS NULL THEN named_struct('kind', 'missing', 'code', coalesce(p.penalty_id, 'unknown') || '.amounts.original_claimed') END), x -> x IS NOT NULL))))"""


def checks(extractions: DataFrame) -> DataFrame:
    """(extraction_id, kind, code): rule violations and missing fields; a record without penalties has one flag alone."""
    rules = extractions.selectExpr("extraction_id", _CHECKS)
    none = extractions.where("coalesce(size(filter(result.contractual_penalties, p -> p IS NOT NULL)), 0) <= 0").select("extraction_id", F.lit("flag").alias("kind"), F.lit("NO_PENALTIES_EXTRACTED").alias("code"))
    return rules.unionByName(none).distinct()


def currency_doubts(extractions: DataFrame, texts: DataFrame) -> DataFrame:
    """(extraction_id, penalty_id) in EUR whose document names old crowns twice or more."""
    pens = extractions.selectExpr("extraction_id", "result.meta.doc_id || '.pdf' AS source_file", "inline(transform(filter(coalesce(result.contractual_penalties, array()), p -> p.amounts.currency = 'EUR'), p -> named_struct('penalty_id', p.penalty_id)))").distinct()
    old = texts.where((F.regexp_count("text", F.lit(rf"\d[\d.,-]*{WS}*Sk(?![\p{{L}}\p{{N}}_])")) >= 2) | F.col("text").rlike(r"(?iu)(?<![\p{L}\p{N}_])SKK(?![\p{L}\p{N}_])")).select("source_file").distinct()
    return pens.join(old, "source_file", "left_semi").select("extraction_id", "penalty_id")


def meta_override(extractions: DataFrame, processed: DataFrame) -> DataFrame:
    """(extraction_id, doc_id, court_name, case_number, ecli, document_type): metadata of the document before those of the model."""
    m = processed.where("metadata IS NOT NULL").groupBy(F.regexp_replace("filename", r"\.pdf$", "").alias("doc_id")).agg(F.max_by("metadata", "ingested_at").alias("m"))
    e = extractions.where("result.meta IS NOT NULL").select("extraction_id", "result.meta.*").dropDuplicates(["extraction_id"])
    c = lambda a, b: F.coalesce(F.col(f"m.{a}"), F.col(b)).alias(b)
    return e.join(m, "doc_id", "left").select("extraction_id", "doc_id", c("court", "court_name"), c("case_id", "case_number"), c("ecli", "ecli"), c("document_type", "document_type"))


def run_totals(extractions: DataFrame) -> DataFrame:
    """Runs, tokens, latency and flagged records by model and mode."""
    once = extractions.dropDuplicates(["extraction_id"])
    flagged = F.coalesce(F.size(F.col("result.quality_control.flags")) > 0, F.lit(False))
    return once.groupBy(F.col("extraction_config.model").alias("model"), F.col("extraction_config.mode").alias("mode")).agg(
        F.count("*").alias("n_runs"), F.sum("api_metadata.prompt_tokens").alias("prompt_tokens"), F.sum("api_metadata.completion_tokens").alias("completion_tokens"),
        F.bround(F.avg("api_metadata.latency_seconds"), 6).alias("mean_latency"), F.sum(flagged.cast("int")).alias("n_flagged"),
    )
