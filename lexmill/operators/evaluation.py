"""Evaluation of retrieval against verbatim quotes.

Every containment test carries the document as an equi key, so no plan compares all texts with all
quotes. All k of a grid are read off one ranked table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import squash


def quotes(gold: DataFrame, fields: list[str], key: str = "document_name") -> DataFrame:
    """(doc, gold_column, quote_no, quote) by the plain rule: cut at bars, squeeze, drop blanks; rows delivered again count once."""
    pairs = F.array(*[F.struct(F.lit(f).alias("gold_column"), F.col(f).alias("cell")) for f in fields])
    cells = gold.select(F.col(key).alias("doc"), F.explode(pairs).alias("x")).select("doc", "x.*").where("cell IS NOT NULL").distinct()
    clean = F.filter(F.transform(F.split("cell", r"[|]"), squash), lambda q: q != "")
    return cells.select("doc", "gold_column", F.posexplode(clean).alias("quote_no", "quote"))


def hits(ranked: DataFrame, rows: DataFrame, query: DataFrame, gold: DataFrame) -> DataFrame:
    """(gold_column, doc, quote_no, quote, idx, rank): each quote with the first chunk, by rank, of its column's queries that contains it; nulls if none does."""
    found = ranked.join(F.broadcast(query.select("query_key", "gold_column")), "query_key").groupBy("gold_column", "doc", "idx").agg(F.min("rank").alias("rank"))
    text = found.join(rows.select("doc", "idx", squash("text").alias("text")), ["doc", "idx"])
    match = gold.join(text, ["gold_column", "doc"]).where(F.contains("text", "quote"))
    first = match.groupBy("gold_column", "doc", "quote_no").agg(F.min_by(F.struct("idx", "rank"), F.struct("rank", "idx")).alias("h"))
    return gold.join(first, ["gold_column", "doc", "quote_no"], "left").select("gold_column", "doc", "quote_no", "quote", "h.idx", "h.rank")


def scores(hit: DataFrame, ranked: DataFrame, query: DataFrame) -> DataFrame:
    """(gold_column, doc, expected, found, recall, hit_class, reciprocal_rank, precision): one row per document and column."""
    got = ranked.join(F.broadcast(query.select("query_key", "gold_column")), "query_key").groupBy("gold_column", "doc").agg(F.countDistinct("idx").alias("returned"))
    per = hit.groupBy("gold_column", "doc").agg(F.count("*").alias("expected"), F.count("idx").alias("found"), F.min("rank").alias("first"), F.countDistinct("idx").alias("chunks"))
    both = per.join(got, ["gold_column", "doc"], "left")
    share = F.col("found") / F.col("expected")
    return both.select(
        "gold_column", "doc", "expected", "found", F.bround(share, 6).alias("recall"), F.when(F.col("found") == F.col("expected"), "PERFECT").when(F.col("found") > 0, "PARTIAL").otherwise("MISS").alias("hit_class"),
        F.bround(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.bround(F.coalesce(F.col("chunks") / F.col("returned"), F.lit(0.0)), 6).alias("precision"),
    )


def coverage(rows: DataFrame, fetched: DataFrame, by: list[str]) -> DataFrame:
    """(by..., doc, coverage): characters of the fetched chunks in per cent of the document's. ``fetched``: (by..., doc, idx)."""
    size = rows.select("doc", "idx", F.char_length("text").alias("n"))
    total = size.groupBy("doc").agg(F.sum("n").alias("total"))
    got = fetched.select(*by, "doc", "idx").distinct().join(size, ["doc", "idx"]).groupBy(*by, "doc").agg(F.sum("n").alias("got"))
    return got.join(total, "doc").select(*by, "doc", F.bround(100 * F.col("got") / F.col("total"), 1).alias("coverage"))


def summary(score: DataFrame) -> DataFrame:
    """Means over all document-column pairs, by column."""
    return score.groupBy("gold_column").agg(F.count("*").alias("n"), F.bround(100 * F.avg("recall"), 4).alias("recall_percent"), F.bround(F.avg("reciprocal_rank"), 4).alias("mrr"), F.bround(F.avg("precision"), 4).alias("precision_at_k"))


def grid(ranked: DataFrame, rows: DataFrame, query: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(k, n_quotes, n_found, recall_percent, coverage): all cut-offs from one ranked table. ``ks`` is the experiment's short list."""
    spark: SparkSession = ranked.sparkSession
    cut = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    h = hits(ranked.where(F.col("rank") <= max(ks)), rows, query, gold)
    found = h.crossJoin(cut).groupBy("k").agg(F.count("*").alias("n_quotes"), F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("n_found"))
    asked = gold.select("doc").distinct()
    fetched = ranked.join(asked, "doc", "left_semi").crossJoin(cut).where("rank <= k")
    cov = coverage(rows, fetched, ["k"]).groupBy("k").agg(F.bround(F.avg("coverage"), 4).alias("coverage"))
    return found.join(cov, "k", "left").select("k", "n_quotes", "n_found", F.bround(100 * F.col("n_found") / F.col("n_quotes"), 4).alias("recall_percent"), "coverage")


def gold_chunks(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc, idx): chunks that contain a quote, whatever its case."""
    text = rows.select("doc", "idx", F.lower(squash("text")).alias("text"))
    return text.join(gold.select("doc", F.lower("quote").alias("quote")), "doc").where(F.contains("text", "quote")).select("doc", "idx").distinct()


def gold_density(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc, n_chunks, n_gold, density, oracle_coverage) of documents with quotes."""
    of = rows.join(gold.select("doc").distinct(), "doc", "left_semi").select("doc", "idx", F.size(F.split(squash("text"), " ")).alias("n"))
    marked = of.join(gold_chunks(rows, gold).withColumn("gold", F.lit(1)), ["doc", "idx"], "left")
    is_gold = F.coalesce("gold", F.lit(0))
    return marked.groupBy("doc").agg(F.count("*").alias("n_chunks"), F.sum(is_gold).alias("n_gold"), F.bround(F.avg(is_gold), 6).alias("density"), F.bround(F.sum(is_gold * F.col("n")) / F.sum("n"), 6).alias("oracle_coverage"))


def micro_recall(score: DataFrame) -> DataFrame:
    return score.groupBy("doc").agg(F.bround(F.sum("found") / F.sum("expected"), 6).alias("recall"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Improved, unchanged and worse pairs, and quadrants at 0.7, on common keys."""
    a, b = F.col("a"), F.col("b")
    both = before.select("gold_column", "doc", F.col("recall").alias("a")).join(after.select("gold_column", "doc", F.col("recall").alias("b")), ["gold_column", "doc"])
    n = lambda c: F.count(F.when(c, 1))
    return both.groupBy("gold_column").agg(
        n(b > a).alias("improved"), n(b == a).alias("unchanged"), n(b < a).alias("worse"), n((a >= 0.7) & (b >= 0.7)).alias("both_good"), n((a >= 0.7) & (b < 0.7)).alias("only_before"),
        n((a < 0.7) & (b >= 0.7)).alias("only_after"), n((a < 0.7) & (b < 0.7)).alias("neither"), F.bround(F.avg(b - a), 6).alias("mean_delta"),
    )


def robustness(doc_recall: DataFrame) -> DataFrame:
    r: Column = F.col("recall")
    return doc_recall.agg(F.count(F.when(r >= 0.95, 1)).alias("strong"), F.count(F.when((r >= 0.8) & (r < 0.95), 1)).alias("fair"), F.count(F.when(r < 0.8, 1)).alias("weak"))


def hit_gap(ranked_scores: DataFrame, hit: DataFrame, query: DataFrame) -> DataFrame:
    """(gold_column, hit_median, miss_median, gap): scores of chunks with and without quotes."""
    s = ranked_scores.join(F.broadcast(query.select("query_key", "gold_column")), "query_key").groupBy("gold_column", "doc", "idx").agg(F.max("score").alias("score"))
    good = hit.where("idx IS NOT NULL").select("gold_column", "doc", "idx").distinct().withColumn("hit", F.lit(True))
    j = s.join(hit.select("gold_column", "doc").distinct(), ["gold_column", "doc"], "left_semi").join(good, ["gold_column", "doc", "idx"], "left")
    med = lambda c: F.percentile(F.when(c, F.col("score")), 0.5)
    out = j.groupBy("gold_column").agg(F.bround(med(F.col("hit")), 6).alias("hit_median"), F.bround(med(F.col("hit").isNull()), 6).alias("miss_median"))
    return out.withColumn("gap", F.bround(F.col("hit_median") - F.col("miss_median"), 6))


def union_ranked(ranked: DataFrame, query: DataFrame) -> DataFrame:
    """(gold_column, doc, idx, query_key, score, place): the chunks of a column's queries put together, query by query and rank by rank; of a chunk fetched twice the first counts. Places are dense, from 1."""
    order = query.select("query_key", "gold_column", F.col("ord"))
    one = ranked.join(F.broadcast(order), "query_key")
    first = F.row_number().over(Window.partitionBy("gold_column", "doc", "idx").orderBy("ord", "rank"))
    place = F.row_number().over(Window.partitionBy("gold_column", "doc").orderBy("ord", "rank"))
    return one.withColumn("k", first).where("k = 1").withColumn("place", place).select("gold_column", "doc", "idx", "query_key", "score", "place")


def holding(rows: DataFrame, gold: DataFrame, windows: list[int]) -> DataFrame:
    """(gold_column, doc, quote_no, w, idx): the chunks that hold a quote with ``w`` neighbours on either side. Documents are the equi key; one window per chunk and width, whatever modes and cut-offs ask."""
    asked = rows.join(gold.select("doc").distinct(), "doc", "left_semi").select("doc", "idx", squash("text").alias("text"))
    parts = [asked.withColumn("w", F.lit(0))] if 0 in windows else []
    for w in windows:
        if w:
            near = F.collect_list("text").over(Window.partitionBy("doc").orderBy("idx").rangeBetween(-w, w))
            parts.append(asked.select("doc", "idx", F.array_join(near, " ").alias("text"), F.lit(w).alias("w")))
    text = parts[0]
    for p in parts[1:]:
        text = text.unionByName(p)
    return text.join(gold, "doc").where(F.contains("text", "quote")).select("gold_column", "doc", "quote_no", "w", "idx")


def window_coverage(rows: DataFrame, fetched: DataFrame, by: list[str]) -> DataFrame:
    """(by..., doc, coverage) of chunks fetched with their neighbours. ``fetched``: (by..., doc, idx, w)."""
    wide = fetched.select(*by, "doc", F.explode(F.sequence(F.col("idx") - F.col("w"), F.col("idx") + F.col("w"))).alias("idx"))
    return coverage(rows, wide, by)


def experiments(ranked: dict[str, DataFrame], rows: DataFrame, query: DataFrame, gold: DataFrame, ks: list[int], windows: list[int], skip: tuple[tuple[str, int, int], ...] = ()) -> DataFrame:
    """(mode, k, w, n_quotes, n_found, recall_percent, coverage): every mode at every cut-off and window, but those in ``skip``.

    ``ranked``: by mode, (query_key, doc, idx, rank) down to the largest cut-off. Ranks are columns, so each mode is ranked once.
    """
    spark: SparkSession = rows.sparkSession
    grid_ = F.broadcast(spark.createDataFrame([(m, k, w) for m in ranked for k in ks for w in windows if (m, k, w) not in skip], "mode string, k int, w int"))
    best = None
    for mode, r in ranked.items():
        one = r.select(F.lit(mode).alias("mode"), "query_key", "doc", "idx", "rank")
        best = one if best is None else best.unionByName(one)
    best = best.join(F.broadcast(query.select("query_key", "gold_column")), "query_key").groupBy("mode", "gold_column", "doc", "idx").agg(F.min("rank").alias("rank"))
    first = holding(rows, gold, windows).join(best, ["gold_column", "doc", "idx"]).groupBy("mode", "gold_column", "doc", "quote_no", "w").agg(F.min("rank").alias("rank"))
    found = first.join(grid_, ["mode", "w"]).where("rank <= k").groupBy("mode", "k", "w").agg(F.count("*").alias("n_found"))
    total = gold.agg(F.count("*").alias("n_quotes"))
    asked = gold.select("doc").distinct()
    fetched = best.select("mode", "doc", "idx", "rank").join(asked, "doc", "left_semi").join(grid_, "mode").where("rank <= k").select("mode", "k", "w", "doc", "idx").distinct()
    cov = window_coverage(rows, fetched, ["mode", "k", "w"]) if windows else None
    mean = cov.groupBy("mode", "k", "w").agg(F.bround(F.avg("coverage"), 4).alias("coverage"))
    out = grid_.join(found, ["mode", "k", "w"], "left").join(mean, ["mode", "k", "w"], "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("n_found", F.lit(0))
    return out.select("mode", "k", "w", "n_quotes", n.alias("n_found"), F.bround(100 * n / F.col("n_quotes"), 4).alias("recall_percent"), "coverage")


def detail(rows: DataFrame, union: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per document and column with everything a report of an experiment needs.

    (gold_column, doc, n_doc_chunks, n_fetched, expected, found, recall, hit_class, first_place, reciprocal_rank, precision, found_quotes,
    missed_quotes, hit_scores, miss_scores, hit_mean, hit_max, miss_mean, miss_max, chars_fetched, coverage, fetched, mean_quote_chars).
    A column without quotes has no row; nothing fetched gives zeros and empty lists. ``union``: see ``union_ranked``.
    """
    key = ["gold_column", "doc"]
    asked = gold.select(*key).distinct()
    text = rows.select("doc", "idx", squash("text").alias("text"), F.char_length("text").alias("size"))
    got = union.join(asked, key, "left_semi").join(text, ["doc", "idx"])
    pairs = gold.join(got.select(*key, "idx", "place", "text"), key).where(F.contains("text", "quote"))
    first = pairs.groupBy(*key, "quote_no").agg(F.min("place").alias("place"))
    quoted = gold.join(first, [*key, "quote_no"], "left").groupBy(*key).agg(
        F.count("*").alias("expected"), F.count("place").alias("found"), F.min("place").alias("first_place"), F.bround(F.avg(F.char_length("quote")), 4).alias("mean_quote_chars"),
        F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.col("quote_no")))).alias("found_quotes"), F.array_sort(F.collect_list(F.when(F.col("place").isNull(), F.col("quote_no")))).alias("missed_quotes"),
    )
    hit = got.join(pairs.select(*key, "idx").distinct().withColumn("hit", F.lit(True)), [*key, "idx"], "left")
    yes, no = F.col("hit"), F.col("hit").isNull()
    of = lambda c: F.sort_array(F.collect_list(F.when(c, F.bround("score", 6))), False)
    fetched = hit.groupBy(*key).agg(
        F.count("*").alias("n_fetched"), F.count(F.when(yes, 1)).alias("n_hit"), F.sum("size").alias("chars_fetched"), of(yes).alias("hit_scores"), of(no).alias("miss_scores"),
        *[f(F.when(c, F.col("score"))).alias(n) for f, c, n in ((F.avg, yes, "hit_mean"), (F.max, yes, "hit_max"), (F.avg, no, "miss_mean"), (F.max, no, "miss_max"))], F.array_sort(F.collect_list("idx")).alias("fetched"),
    )
    whole = text.groupBy("doc").agg(F.count("*").alias("n_doc_chunks"), F.sum("size").alias("chars"))
    out = quoted.join(fetched, key, "left").join(whole, "doc", "left")
    c = F.col
    none, zero = F.array().cast("array<double>"), F.lit(0)
    return out.select(
        *key, F.coalesce("n_doc_chunks", zero).alias("n_doc_chunks"), F.coalesce("n_fetched", zero).alias("n_fetched"), "expected", "found", F.bround(c("found") / c("expected"), 4).alias("recall"),
        F.when(c("found") == c("expected"), "PERFECT").when(c("found") > 0, "PARTIAL").otherwise("MISS").alias("hit_class"), "first_place", F.bround(F.coalesce(1 / c("first_place"), F.lit(0.0)), 4).alias("reciprocal_rank"),
        F.bround(F.coalesce(c("n_hit") / c("n_fetched"), F.lit(0.0)), 4).alias("precision"), "found_quotes", "missed_quotes", F.coalesce("hit_scores", none).alias("hit_scores"), F.coalesce("miss_scores", none).alias("miss_scores"),
        *[F.bround(x, 4).alias(x) for x in ("hit_mean", "hit_max", "miss_mean", "miss_max")], F.coalesce("chars_fetched", zero).alias("chars_fetched"),
        F.bround(F.coalesce(100 * c("chars_fetched") / c("chars"), F.lit(0.0)), 1).alias("coverage"), F.coalesce("fetched", F.array().cast("array<int>")).alias("fetched"), "mean_quote_chars",
    )


def call_coverage(rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """(doc, call1, call2, both): characters fetched by each call and by both, in per cent. ``fetched``: (call, doc, idx)."""
    every = fetched.select("call", "doc", "idx").unionByName(fetched.select(F.lit("both").alias("call"), "doc", "idx"))
    got = coverage(rows, every, ["call"])
    of = lambda n: F.max(F.when(F.col("call") == n, F.col("coverage"))).alias(n)
    return got.groupBy("doc").agg(of("call1"), of("call2"), of("both"))


def weighted_coverage(cover: DataFrame, weight: DataFrame, value: str = "both", by: str = "n") -> DataFrame:
    """(mean_coverage, weighted_coverage): over documents, and by their weights. ``weight``: (doc, n)."""
    j = cover.join(weight, "doc")
    return j.agg(F.bround(F.avg(value), 4).alias("mean_coverage"), F.bround(F.sum(F.col(value) * F.col(by)) / F.sum(by), 4).alias("weighted_coverage"))


def hierarchical(context: DataFrame, parents: DataFrame, gold: DataFrame, calls: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """(by..., gold_column, n_quotes, n_found, recall_percent, coverage): quotes against the joined context of their column's call; no ranks, so no MRR.

    ``context``: (by..., call, doc, context); ``calls``: the call of each column. A document without context finds nothing.
    """
    by = by or []
    call = F.create_map(*[F.lit(x) for kv in calls.items() for x in kv])
    asked = gold.select("doc", "gold_column", "quote_no", "quote", call[F.col("gold_column")].alias("call"))
    settings = context.select(*by).distinct() if by else None
    every = asked.crossJoin(F.broadcast(settings)) if by else asked  # the settings of a grid are a stated few
    held = every.join(context.select(*by, "call", "doc", squash("context").alias("text"), F.char_length("context").alias("size")), [*by, "call", "doc"], "left")
    whole = parents.groupBy(F.col("source_file").alias("doc")).agg(F.sum(F.char_length("page_content")).alias("chars"))
    seen = held.withColumn("hit", F.coalesce(F.contains("text", "quote"), F.lit(False)).cast("int")).join(whole, "doc", "left")
    per = seen.groupBy(*by, "gold_column", "doc").agg(F.count("*").alias("n"), F.sum("hit").alias("f"), F.max(F.coalesce(100 * F.col("size") / F.col("chars"), F.lit(0.0))).alias("cover"))
    return per.groupBy(*by, "gold_column").agg(F.sum("n").alias("n_quotes"), F.sum("f").alias("n_found"), F.bround(100 * F.sum("f") / F.sum("n"), 4).alias("recall_percent"), F.bround(F.avg("cover"), 4).alias("coverage"))


def long_documents(before: DataFrame, after: DataFrame, rows: DataFrame, more_than: int = 40) -> DataFrame:
    """(doc, n_chunks, before, after, delta) of documents with more than so many chunks, recall over all their quotes in per cent. ``before``, ``after``: scores."""
    of = lambda d, n: d.groupBy("doc").agg(F.bround(100 * F.sum("found") / F.sum("expected"), 4).alias(n))
    size = rows.groupBy("doc").agg(F.count("*").alias("n_chunks")).where(F.col("n_chunks") > more_than)
    return size.join(of(before, "before"), "doc").join(of(after, "after"), "doc").select("doc", "n_chunks", "before", "after", F.bround(F.col("after") - F.col("before"), 4).alias("delta"))
