"""The case base: flat penalty records, faceted filter, ranking by several signals, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import DECISION_LABELS, FACTOR_LABELS, FACTOR_NAMES, SIMILAR_CONTRACTS
from ..functions.text import authority_level, cut_at_blank, spaced_number


@dataclass(frozen=True)
class Intent:
    """What is asked: facets that filter, facets that raise the score, an amount."""

    contract_type: str | None = None
    breach_type: str | None = None
    decision: str | None = None
    factors: tuple[str, ...] = field(default_factory=tuple)
    amount: float | None = None


#: weights of likeness, amount, bonus and authority
WEIGHTS = (0.40, 0.25, 0.20, 0.15)
#: records from which statistics are given, and decisions from which the ratio is
LEAST_RECORDS, LEAST_DECISIONS = 5, 3

_FLAT = """inline(filter(transform(coalesce(result.contractual_penalties, array()), (p, i) -> CASE WHEN p IS NOT NULL THEN named_struct(
 'penalty_no', i, 'penalty_id', p.penalty_id, 'contract_type', coalesce(result.case_context.contract_type, 'nezname'), 'relationship_type', coalesce(result.case_context.relationship_type, ''),
 'breach_type', coalesce(p.breach_type.value, 'other'), 'rate_type', coalesce(p.rate_definition.type, 'ine'), 'rate_value_raw', coalesce(p.rate_definition.value_raw, ''),
 'currency', coalesce(p.amounts.currency, 'unknown'), 'secured_principal', p.amounts.secured_principal.value, 'original_claimed', p.amounts.original_claimed.value, 'final_awarded', p.amounts.final_awarded.value,
 'decision', coalesce(p.moderation_analysis.decision.value, 'unclear'), 'dismissal_reason', p.moderation_analysis.decision.dismissal_reason,
 'reasoning', coalesce(p.moderation_analysis.legal_reasoning_summary, ''), 'factors', transform(filter(coalesce(p.moderation_analysis.factors, array()), f -> f IS NOT NULL), f -> named_struct('label', f.label, 'sentiment', f.sentiment)),
 'flags', filter(coalesce(result.quality_control.flags, array()), f -> contains(f, coalesce(p.penalty_id, 'pokuta_')) OR NOT contains(f, 'pokuta_')),
 'court_name', coalesce(result.meta.court_name, ''), 'case_number', coalesce(result.meta.case_number, ''), 'decision_date', result.meta.decision_date) END), x -> x IS NOT NULL))"""


def penalties(extractions: DataFrame) -> DataFrame:
    """Flat records with defaults, the flags that concern them, authority level and card text."""
    flat = extractions.selectExpr("extraction_id", _FLAT).dropDuplicates(["extraction_id", "penalty_no"])
    return flat.withColumn("authority_level", authority_level("court_name")).withColumn("card", card_text())


def card_text() -> Column:
    """A short description of a record; parts without a value are left out."""
    c = F.col
    some = lambda test, *parts: F.when(test, F.concat(*parts))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in DECISION_LABELS.items() for x in kv])[c("decision")], c("decision"))
    told = F.filter("factors", lambda f: f["sentiment"].isNotNull() & (f["sentiment"] != "not_mentioned"))
    return F.concat_ws(
        " ", F.when(c("relationship_type") != "", F.concat(F.lit("Zmluva: "), c("contract_type"), F.lit(", "), c("relationship_type"), F.lit("."))).otherwise(F.concat(F.lit("Zmluva: "), c("contract_type"), F.lit("."))),
        some(c("breach_type") != "", F.lit("Porusenie: "), c("breach_type"), F.lit(".")), some(c("rate_value_raw") != "", F.lit("Sadzba: "), c("rate_value_raw"), F.lit(".")),
        some(c("secured_principal").isNotNull(), F.lit("Istina: "), spaced_number("secured_principal"), F.lit(" "), c("currency"), F.lit(".")),
        some(c("original_claimed").isNotNull() & c("final_awarded").isNotNull(), F.lit("Pozadovane: "), spaced_number("original_claimed"), F.lit(", priznane: "), spaced_number("final_awarded"), F.lit(" "), c("currency"), F.lit(".")),
        some(c("decision") != "", F.lit("Rozhodnutie: "), label, F.lit(".")),
        some(F.size(told) > 0, F.lit("Faktory: "), F.array_join(F.transform(told, lambda f: F.concat(F.coalesce(f["label"], F.lit("")), F.lit(" ("), f["sentiment"], F.lit(")"))), ", "), F.lit(".")), F.when(c("reasoning") != "", cut_at_blank("reasoning")),
    )


def filtered(records: DataFrame, intent: Intent) -> DataFrame:
    """Records of the asked contract type (or one like it) and breach, all if none is; ``filter_type`` says which. One plan, no second job."""
    test = F.lit(True)
    if intent.contract_type:
        test = test & F.col("contract_type").isin([intent.contract_type, *SIMILAR_CONTRACTS.get(intent.contract_type, [])])
    if intent.breach_type:
        test = test & (F.col("breach_type") == intent.breach_type)
    strict = "strict" if intent.contract_type or intent.breach_type else "none"
    marked = records.withColumn("_match", test)
    n = marked.agg(F.count(F.when(F.col("_match"), 1)).alias("_n"))
    kept = marked.crossJoin(F.broadcast(n)).where("_match OR _n = 0")  # one row
    return kept.withColumn("filter_type", F.when(F.col("_n") == 0, "none_fallback").otherwise(strict)).drop("_match", "_n")


def filter_counts(records: DataFrame, intent: Intent) -> DataFrame:
    total = records.agg(F.count("*").alias("n_total"))
    return filtered(records, intent).groupBy("filter_type").agg(F.count("*").alias("n_filtered")).crossJoin(F.broadcast(total))  # one row


def amount_score(amount: float | None) -> Column:
    own = F.coalesce("secured_principal", "original_claimed")
    if not amount or amount <= 0:
        return F.lit(0.5)
    return F.when(own.isNull() | (own <= 0), 0.5).otherwise(F.least(own, F.lit(amount)) / F.greatest(own, F.lit(amount)))


def bonus_score(intent: Intent) -> Column:
    """Two points for the decision, one for each mentioned factor asked, over what could be had; 0.5 if nothing is asked."""
    most = (2 if intent.decision else 0) + len(intent.factors)
    if not most:
        return F.lit(0.5)
    told = F.transform(F.filter("factors", lambda f: f["sentiment"].isNotNull() & (f["sentiment"] != "not_mentioned")), lambda f: f["label"])
    got = F.when(F.col("decision") == (intent.decision or ""), 2).otherwise(0)
    for label in intent.factors:
        got = got + F.coalesce(F.array_contains(told, label), F.lit(False)).cast("int")
    return got / F.lit(float(most))


def ranked(records: DataFrame, intent: Intent, likeness: Column | None = None, n: int = 5) -> DataFrame:
    """The best ``n`` records with their score and rank. ``likeness``: of query and card in [0, 1]; 0 without vectors."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), likeness)) if likeness is not None else F.lit(0.0)
    a, b, c, d = WEIGHTS
    score = a * near + b * amount_score(intent.amount) + c * bonus_score(intent) + d * F.coalesce("authority_level", F.lit(1)) / 3
    best = records.withColumn("score", F.bround(score, 6)).orderBy(F.desc("score"), "extraction_id", "penalty_no").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "extraction_id", "penalty_no")).cast("int"))


def cards(best: DataFrame) -> DataFrame:
    """The records as shown."""
    return best.select("rank", "extraction_id", "penalty_id", "case_number", "court_name", "contract_type", "breach_type", "decision", "currency", "secured_principal", F.bround("score", 3).alias("score"), "authority_level")


def statistics(records: DataFrame) -> DataFrame:
    """(n, n_decided, n_moderated, moderation_rate_pct): nulls below the least numbers of records and decisions."""
    n = lambda d: F.count(F.when(F.col("decision") == d, 1))
    out = records.agg(F.count("*").alias("n"), n("moderated_301").alias("n_moderated"), (n("moderated_301") + n("awarded_full")).alias("n_decided"))
    enough = (F.col("n") >= LEAST_RECORDS) & (F.col("n_decided") >= LEAST_DECISIONS)
    return out.select("n", "n_decided", "n_moderated", F.when(enough, F.bround(100 * F.col("n_moderated") / F.col("n_decided"), 1)).alias("moderation_rate_pct"))


def factor_counts(records: DataFrame) -> DataFrame:
    """(label, n_negative, n_moderated): how often each of the seven factors spoke against the penalty in moderated cases; zeros kept."""
    spark = records.sparkSession
    labels = F.broadcast(spark.createDataFrame([(x,) for x in FACTOR_LABELS], "label string"))
    moderated = records.where("decision = 'moderated_301'")
    bad = moderated.select(F.explode("factors").alias("f")).where("f.sentiment = 'negative'").groupBy(F.col("f.label").alias("label")).agg(F.count("*").alias("n_negative"))
    total = moderated.agg(F.count("*").alias("n_moderated"))
    return labels.join(bad, "label", "left").crossJoin(F.broadcast(total)).select("label", F.coalesce("n_negative", F.lit(0)).alias("n_negative"), "n_moderated")


def report(records: DataFrame) -> DataFrame:
    """(line_no, line): factors that spoke against penalties, most frequent first, dots to a fixed width."""
    names = F.create_map(*[F.lit(x) for kv in FACTOR_NAMES.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(FACTOR_LABELS) for x in (k, i)])
    some = factor_counts(records).where("n_negative > 0").withColumn("line_no", F.row_number().over(Window.orderBy(F.desc("n_negative"), place[F.col("label")])))
    return some.select("line_no", F.concat(F.lit("  - "), F.rpad(names[F.col("label")], 35, "."), F.lit(" "), F.col("n_negative"), F.lit(" z "), F.col("n_moderated"), F.lit(" pripadov")).alias("line"))


def profile(records: DataFrame) -> DataFrame:
    """(field, value, n): value counts of five fields, and how many records have each amount or any flag."""
    fields = ["contract_type", "breach_type", "decision", "currency", "rate_type"]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    given = [F.struct(F.lit("has_amount").alias("field"), F.when(F.col(a).isNotNull(), F.lit(a)).alias("value")) for a in ("secured_principal", "original_claimed", "final_awarded")]
    given.append(F.struct(F.lit("flags").alias("field"), F.when(F.size("flags") > 0, F.lit("any")).alias("value")))
    return records.select(F.explode(F.concat(pairs, F.array(*given))).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))


def repeated_cases(records: DataFrame) -> DataFrame:
    """Records with how many share their case number; a shuffle by case, no window over all rows."""
    same = records.groupBy("case_number").agg(F.count("*").alias("n_same"))
    return records.select("extraction_id", "penalty_no", "case_number").join(same, "case_number").where("n_same > 1").select("extraction_id", "penalty_no", "case_number", "n_same")


def search(records: DataFrame, intent: Intent, likeness: Column | None = None, n: int = 5) -> dict[str, DataFrame]:
    """Filter, rank, cards and statistics of one question."""
    kept = filtered(records, intent)
    return {"cards": cards(ranked(kept, intent, likeness, n)), "statistics": statistics(kept), "factors": factor_counts(kept), "report": report(kept), "filter": filter_counts(records, intent)}


# Words of a question, in plain letters, that name a facet.
_ASKED: dict[str, dict[str, str]] = {
    "contract_type": {"dielo": r"diel[oae]|zhotovitel", "najom": r"naj(o|)m|prenaj", "kupna": r"kupn|predaj|kupuj", "uver": r"uver|pozick", "preprava": r"preprav|doprav", "dodavka_sluzieb": r"sluz(b|ieb)"},
    "breach_type": {"late_payment": r"omeskan\w*\s+(s\s+)?(plat|uhrad|zaplat)|neskor\w*\s+(plat|uhrad)|nezaplat|neuhrad", "early_termination": r"predcasn|vypoved", "breach_of_confidentiality": r"mlcanliv|dovern", "non_monetary_performance": r"omeskan\w*\s+(s\s+)?(dodan|odovzd|diel|plnen)|nedodal|neodovzd"},
    "decision": {"moderated_301": r"moderac|moderov|zniz", "dismissed": r"zamietn|zamietol", "awarded_full": r"v\s+plnej\s+vyske|priznan", "returned": r"vrat(en|il)"},
    "factors": {"dobre_mravy": r"dobr\w*\s+mrav", "pomer_k_istine": r"pomer|istin|privysok|neprimeran", "vyska_skody": r"skod"},
    "intent": {"safe_rate": r"bezpecn|sadzb|dohodnut", "defense_args": r"obran|argument|branit|namiet"},
}


def intents(questions: DataFrame, text: str = "question") -> DataFrame:
    """``questions`` with ``intent`` and the facets that its words name: contract_type, breach_type, decision, factors, amount, semantic_query.

    The offline stand-in for a model: of several facets the first of the list. A null or blank question, or one that names
    nothing, asks for nothing in particular: all facets null, no factors, the question itself as what is searched.
    """
    from ..functions.text import plain, portable

    t = plain(text)
    first = lambda bank: F.coalesce(*[F.when(t.rlike(portable(p)), F.lit(n)) for n, p in bank.items()])
    named = F.filter(F.array(*[F.when(t.rlike(portable(p)), F.lit(n)) for n, p in _ASKED["factors"].items()]), lambda n: n.isNotNull())
    number = F.regexp_replace(F.regexp_extract(t, r"(\d[\d ]*)\s*(eur|€)", 1), " ", "").try_cast("double")
    return questions.select(
        "*", first(_ASKED["contract_type"]).alias("contract_type"), first(_ASKED["breach_type"]).alias("breach_type"), first(_ASKED["decision"]).alias("decision_interest"), named.alias("factor_interest"),
        number.alias("amount_hint"), F.coalesce(first(_ASKED["intent"]), F.lit("general_precedent")).alias("intent"), F.coalesce(F.trim(text), F.lit("")).alias("semantic_query"),
    )


def search_all(records: DataFrame, asked: DataFrame, n: int = 5, near: DataFrame | None = None) -> DataFrame:
    """(query_id, filter_type, n_filtered, rank, extraction_id, penalty_no, penalty_id, likeness, score): every question of a stated set against all records.

    ``asked``: intents with ``query_id``, few, so broadcast. ``near``: (query_id, extraction_id, penalty_no, likeness); 0 without.
    Records that do not suit a question's facets are left out, unless none does; ranks are group limits, so at most ``n`` rows
    of a question leave a task.
    """
    kinds = F.create_map(*[F.lit(x) for k, v in SIMILAR_CONTRACTS.items() for x in (k, ",".join(v))]) if SIMILAR_CONTRACTS else F.create_map()
    like = F.split(F.coalesce(kinds[F.col("q.contract_type")], F.lit("")), ",")
    q, r = asked.alias("q"), records.alias("r")
    suits = (F.col("q.contract_type").isNull() | (F.col("r.contract_type") == F.col("q.contract_type")) | F.array_contains(like, F.col("r.contract_type"))) & (F.col("q.breach_type").isNull() | (F.col("r.breach_type") == F.col("q.breach_type")))
    both = r.crossJoin(F.broadcast(q)).withColumn("suits", suits)
    counts = both.groupBy("query_id").agg(F.count(F.when(F.col("suits"), 1)).alias("n_suit"), F.count("*").alias("n_all"))
    told = F.transform(F.filter("r.factors", lambda f: f["sentiment"].isNotNull() & (f["sentiment"] != "not_mentioned")), lambda f: f["label"])
    most = F.when(F.col("q.decision_interest").isNotNull(), 2).otherwise(0) + F.size("q.factor_interest")
    got = F.when(F.col("r.decision") == F.col("q.decision_interest"), 2).otherwise(0) + F.aggregate(F.transform("q.factor_interest", lambda x: F.coalesce(F.array_contains(told, x), F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    bonus = F.when(most == 0, 0.5).otherwise(got / most.cast("double"))
    own, hint = F.coalesce("r.secured_principal", "r.original_claimed"), F.col("q.amount_hint")
    amount = F.when(hint.isNull() | (hint <= 0) | own.isNull() | (own <= 0), 0.5).otherwise(F.least(own, hint) / F.greatest(own, hint))
    part = both.select("query_id", "suits", "r.extraction_id", "r.penalty_no", "r.penalty_id", amount.alias("amount"), bonus.alias("bonus"), (F.coalesce(F.col("r.authority_level"), F.lit(1)) / 3).alias("authority"))
    part = part.join(F.broadcast(counts), "query_id").where("suits OR n_suit = 0")
    if near is not None:
        part = part.join(near, ["query_id", "extraction_id", "penalty_no"], "left")
    else:
        part = part.withColumn("likeness", F.lit(0.0))
    w = WEIGHTS
    score = w[0] * F.coalesce("likeness", F.lit(0.0)) + w[1] * F.col("amount") + w[2] * F.col("bonus") + w[3] * F.col("authority")
    scored = part.withColumn("score", F.bround(score, 6)).withColumn("filter_type", F.when(F.col("n_suit") == 0, "none_fallback").otherwise("strict")).withColumn("n_filtered", F.when(F.col("n_suit") == 0, F.col("n_all")).otherwise(F.col("n_suit")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "extraction_id", "penalty_no"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.select("query_id", "filter_type", "n_filtered", "rank", "extraction_id", "penalty_no", "penalty_id", F.bround(F.coalesce("likeness", F.lit(0.0)), 6).alias("likeness"), "score")


def intent_summary(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, intent, filter_type, n_filtered, n_shown): one line per question; questions without any record have zeros."""
    per = found.groupBy("query_id").agg(F.first("filter_type").alias("filter_type"), F.first("n_filtered").alias("n_filtered"), F.count("*").alias("n_shown"))
    return asked.select("query_id", "intent").join(per, "query_id", "left").select("query_id", "intent", "filter_type", F.coalesce("n_filtered", F.lit(0)).alias("n_filtered"), F.coalesce("n_shown", F.lit(0)).alias("n_shown"))


def gated_statistics(records: DataFrame, intent: Intent) -> DataFrame:
    """``statistics`` of all records that suit the question, with a note where they are fewer than ``LEAST_RECORDS``."""
    few = F.concat(F.lit("menej ako "), F.lit(str(LEAST_RECORDS)), F.lit(" zaznamov: "), F.col("n").cast("string"))
    return statistics(filtered(records, intent)).withColumn("note", F.when(F.col("n") < LEAST_RECORDS, few))
