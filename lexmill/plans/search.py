"""Queries of retrieval, re-ranking and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, read, spread
from ..functions import catalog
from ..operators import chunking
from ..operators import evaluation as E
from ..operators import retrieval as R
from .documents import WS, _reasons, q, re2, sql_squash, sql_tokens

GOLD = ["q1_context_quotes", "q2_penalty_quotes", "q3_moderation_quotes"]
CFG = R.Config()


def _rows(s: SparkSession, d: str) -> DataFrame:
    return R.chunk_rows(read(s, d, "chunks"))


def _given(s: SparkSession, d: str) -> DataFrame:
    """Chunks as delivered, for what takes each once itself."""
    return R.chunk_rows(spread(read(s, d, "chunks").select("source_file", "chunk_index", "chunk_id", "page_content")), once=False)


def _golden_rows(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents that have quotes: the evaluation's corpus."""
    return _rows(s, d).join(read(s, d, "golden_dataset_template").select(F.col("document_name").alias("doc")).distinct(), "doc", "left_semi")


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return E.quotes(read(s, d, "golden_dataset_template"), GOLD)


def v3_vector_search(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return R.vector_search(v, v.join(first, ["label", "vec_id"], "left_semi"), 10)


def v3_search_all(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector as a query against all vectors; ``v3_vector_search`` stays within a label, as its SQL states."""
    v = read(s, d, "embeddings")
    return R.search_all(v, v.where("vec_id % 50 = 0"), 10)


def r3_bm25(s: SparkSession, d: str) -> DataFrame:
    return R.ranked(R.bm25(_given(s, d), R.queries(s)), CFG.top_k, 6)


def r5_hybrid(s: SparkSession, d: str) -> DataFrame:
    return R.retrieve(_given(s, d), R.queries(s), "hybrid").withColumn("score", F.bround("score", 6))


def r6_dense(s: SparkSession, d: str) -> DataFrame:
    return R.ranked(R.hashed_dense(_given(s, d), R.queries(s)), CFG.top_k, 6)


def r4_windows(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    return R.windowed(R.ranked(R.bm25(rows, R.queries(s)), 2), rows, 1)


def r8_adaptive(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    return R.adaptive(R.ranked(R.bm25(rows, R.queries(s)), 12, 6), rows, 7).select("query_key", "doc", "idx", "rank", "k_doc")


def r9_merged(s: SparkSession, d: str) -> DataFrame:
    return R.merged(R.ranked(R.bm25(_given(s, d), R.queries(s)), CFG.top_k, 6), R.queries(s))


def r11_assembled(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    out = R.assembled(R.merged(R.ranked(R.bm25(rows, R.queries(s)), CFG.top_k), R.queries(s)), rows)
    return out.select("doc", "n_call1", "n_call2", "n_all", "chars_call1", "chars_call2")


def q1_keyword_scores(s: SparkSession, d: str) -> DataFrame:
    return R.keyword_scores(_rows(s, d))


def q5_reranked(s: SparkSession, d: str) -> DataFrame:
    return R.reranked(_given(s, d), R.queries(s))


def q6_explained(s: SparkSession, d: str) -> DataFrame:
    """Which patterns of every group match a chunk how often."""
    each = _rows(s, d).select("chunk_id", F.explode(F.array(*[F.struct(F.lit(g).alias("pattern_group"), R.matched_patterns(F.col("text"), g).alias("m")) for g in catalog.PATTERNS])).alias("x"))
    return each.where(F.size("x.m") > 0).select("chunk_id", "x.pattern_group", F.map_keys("x.m").alias("patterns"), F.map_values("x.m").alias("counts"))


def _parents(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = checkpointed(chunking.parents(_reasons(s, d), "reasoning", "filename"))
    return p, checkpointed(chunking.children(p))


def _children_ranked(s: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(parents, the best ``k`` children of each query and document). A child is known by its parent and its place in it."""
    p, kids = _parents(s, d)
    rows = kids.select(F.col("source_file").alias("doc"), F.struct("parent_index", "child_index").alias("idx"), F.col("page_content").alias("text"))
    return p, R.ranked(R.bm25(rows, R.queries(s), R.Config(b=0.5)), k).select("query_key", "doc", "score", "rank", "idx.*")


def h2_parents(s: SparkSession, d: str) -> DataFrame:
    return R.parent_scores(_children_ranked(s, d, 8)[1], R.queries(s))


def h4_context(s: SparkSession, d: str) -> DataFrame:
    p, hit = _children_ranked(s, d, 8)
    return R.parent_context(R.parent_scores(hit, R.queries(s)), p, 5)


def m1_quotes(s: SparkSession, d: str) -> DataFrame:
    return _quotes(s, d)


def _hits(s: SparkSession, d: str, mode: str = "bm25", k: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _golden_rows(s, d)
    best = R.retrieve(rows, R.queries(s), mode, k)
    return rows, best, E.hits(best, rows, R.queries(s), _quotes(s, d))


def m2_hits(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d)[2]


def m10_scores(s: SparkSession, d: str) -> DataFrame:
    rows, best, hit = _hits(s, d)
    return E.scores(hit, best, R.queries(s))


def m12_summary(s: SparkSession, d: str) -> DataFrame:
    return E.summary(m10_scores(s, d))


def m11_coverage(s: SparkSession, d: str) -> DataFrame:
    rows = _golden_rows(s, d)
    best = R.retrieve(rows, R.queries(s), "bm25").join(F.broadcast(R.queries(s).select("query_key", "call")), "query_key")
    return E.coverage(rows, best, ["call"])


def m15_grid(s: SparkSession, d: str) -> DataFrame:
    rows = _golden_rows(s, d)
    return E.grid(R.ranked(R.bm25(rows, R.queries(s)), 10), rows, R.queries(s), _quotes(s, d), [2, 3, 4, 5, 6, 7, 10])


def m16_gold(s: SparkSession, d: str) -> DataFrame:
    return E.gold_density(_golden_rows(s, d), _quotes(s, d))


def m18_robustness(s: SparkSession, d: str) -> DataFrame:
    return E.robustness(E.micro_recall(m10_scores(s, d)))


def m19_compared(s: SparkSession, d: str) -> DataFrame:
    rows = _golden_rows(s, d)
    gold, qs = _quotes(s, d), R.queries(s)
    of = lambda best: E.scores(E.hits(best, rows, qs, gold), best, qs)
    return E.compared(of(R.retrieve(rows, qs, "dense")), of(R.retrieve(rows, qs, "bm25")))


def m22_gap(s: SparkSession, d: str) -> DataFrame:
    rows, best, hit = _hits(s, d, k=10)
    return E.hit_gap(best, hit, R.queries(s))


def r8_by_call(s: SparkSession, d: str) -> DataFrame:
    rows = R.chunk_rows(read(s, d, "chunks"))
    return R.adaptive_by_call(R.ranked(R.bm25(rows, R.queries(s)), 12, 6), rows, R.queries(s), 7).select("query_key", "doc", "idx", "rank", "k_doc")


def r10_groups(s: SparkSession, d: str) -> DataFrame:
    """The two halves of the first call, and both together."""
    hit = R.ranked(R.bm25(_given(s, d), R.queries(s)), CFG.top_k, 6)
    return R.merged_groups(hit, GROUPS)


def r12_summary(s: SparkSession, d: str) -> DataFrame:
    return R.run_summary(r11_assembled(s, d))


GROUPS = {"context": ["q_breach", "q_contract"], "penalty": ["q_rate", "q_principal"]}
#: cut-offs and windows of the grid, fetched children and kept parents of the hierarchical one
KS, WINDOWS, FETCH, PARENTS = [2, 3, 5, 7, 10], [0, 1], [4, 8, 12], [2, 3, 5, 7]


def _golden_given(s: SparkSession, d: str) -> DataFrame:
    return checkpointed(_golden_rows(s, d))


def m8_union(s: SparkSession, d: str) -> DataFrame:
    rows = _golden_given(s, d)
    return E.union_ranked(R.ranked(R.bm25(rows, R.queries(s)), CFG.top_k), R.queries(s)).select("gold_column", "doc", "idx", "query_key", "place")


def m10_detail(s: SparkSession, d: str) -> DataFrame:
    rows = _golden_given(s, d)
    return E.detail(rows, E.union_ranked(R.ranked(R.bm25(rows, R.queries(s)), CFG.top_k), R.queries(s)), _quotes(s, d))


def m5_score_lists(s: SparkSession, d: str) -> DataFrame:
    return m10_detail(s, d).select("gold_column", "doc", "n_fetched", "expected", "found", "recall", "first_place", "precision", "hit_mean", "hit_max", "miss_mean", "miss_max", "chars_fetched", "coverage", F.size("hit_scores").alias("n_hits"), F.size("miss_scores").alias("n_misses"))


def _call_cover(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _golden_given(s, d)
    best = R.ranked(R.bm25(rows, R.queries(s)), CFG.top_k).join(F.broadcast(R.queries(s).select("query_key", "call")), "query_key")
    return rows, E.call_coverage(rows, best)


def m11_calls(s: SparkSession, d: str) -> DataFrame:
    return _call_cover(s, d)[1]


def m13_weighted(s: SparkSession, d: str) -> DataFrame:
    rows, cover = _call_cover(s, d)
    return E.weighted_coverage(cover, rows.groupBy("doc").agg(F.count("*").alias("n")))


def m14_hierarchical(s: SparkSession, d: str) -> DataFrame:
    p, hit = _children_ranked(s, d, 8)
    context = R.parent_context(R.parent_scores(hit, R.queries(s)), p, 5)
    return E.hierarchical(context, p, _quotes(s, d), {g: _CALL[k] for k, g in catalog.GOLD_COLUMN.items()})


def m15_hierarchy(s: SparkSession, d: str) -> DataFrame:
    """The hierarchical grid: fetched children by kept parents, off one ranking."""
    p, hit = _children_ranked(s, d, max(FETCH))
    gold = _quotes(s, d)
    asked = gold.select("doc").distinct()
    context = R.parent_context(R.parent_grid(hit.join(asked, "doc", "left_semi"), R.queries(s), FETCH), p, PARENTS)
    return E.hierarchical(context, p, gold, {g: _CALL[k] for k, g in catalog.GOLD_COLUMN.items()}, ["fetch_k", "n_parents"])


def _ranked_modes(s: SparkSession, rows: DataFrame, k: int) -> dict[str, DataFrame]:
    all_ = checkpointed(R.scores(rows, R.queries(s), CFG, dense=True, keywords=True))
    one = lambda c: R.ranked(all_.select("query_key", "doc", "idx", F.col(c).alias("score")), k)
    return {"dense": one("dense"), "bm25": one("lexical"), "all": all_}


def m15_experiments(s: SparkSession, d: str) -> DataFrame:
    """Modes by cut-offs by windows over the stored chunks. Fusion takes the pool of the largest cut-off."""
    rows = _golden_given(s, d)
    r = _ranked_modes(s, rows, max(KS))
    modes = {"dense": r["dense"], "bm25": r["bm25"], "hybrid": R.fuse(r["all"], max(KS), CFG)}
    return E.experiments(modes, rows, R.queries(s), _quotes(s, d), KS, WINDOWS)


def m15_chunkings(s: SparkSession, d: str) -> DataFrame:
    """The same with re-ranking, over other chunkings of the same reasonings; one experiment is skipped."""
    gold = _quotes(s, d)
    asked = gold.select(F.col("doc").alias("filename")).distinct()
    reasons = _reasons(s, d).select("filename", "reasoning").distinct().join(asked, "filename", "left_semi")
    out = None
    for name in ("openai_200", "openai_500"):
        size, overlap = catalog.CHUNK_PRESETS[name]
        rows = chunking.rows(reasons, chunking.recursive("reasoning", size, overlap), name, ["filename"])
        rows = checkpointed(rows.select(F.col("filename").alias("doc"), F.col("chunk_index").alias("idx"), F.col("page_content").alias("text")).dropDuplicates(["doc", "idx"]))
        r = _ranked_modes(s, rows, max(KS))
        modes = {"bm25": r["bm25"], "hybrid": R.fuse(r["all"], max(KS), CFG), "reranked": R.rerank(R.fuse(r["all"], max(KS) * CFG.oversample, CFG, ("kw",)), max(KS), CFG.rerank_alpha)}
        one = E.experiments(modes, rows, R.queries(s), gold, KS, WINDOWS, skip=(("bm25", 10, 1),)).withColumn("chunking", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def m21_long(s: SparkSession, d: str) -> DataFrame:
    """Long documents with dense retrieval and with fused one."""
    rows = _golden_given(s, d)
    gold, qs = _quotes(s, d), R.queries(s)
    of = lambda best: E.scores(E.hits(best, rows, qs, gold), best, qs)
    return E.long_documents(of(R.retrieve(rows, qs, "dense")), of(R.retrieve(rows, qs, "bm25")), rows, 12)


QUERIES = {f.__name__: f for f in (
    r8_by_call, r10_groups, r12_summary, m8_union, m10_detail, m5_score_lists, m11_calls, m13_weighted, m14_hierarchical, m15_experiments, m15_hierarchy, m15_chunkings, m21_long,
    v3_vector_search, v3_search_all, r3_bm25, r5_hybrid, r6_dense, r4_windows, r8_adaptive, r9_merged, r11_assembled, q1_keyword_scores, q5_reranked, q6_explained, h2_parents, h4_context, m1_quotes, m2_hits, m10_scores, m12_summary,
    m11_coverage, m15_grid, m16_gold, m18_robustness, m19_compared, m22_gap,
)}

_CALL = {k: c for c, ks in catalog.CALLS.items() for k in ks}
_QUERIES = "(VALUES " + ", ".join(f"({q(k)}, {q(t)}, {q(_CALL[k])}, {q(catalog.GOLD_COLUMN[k])}, {i})" for i, (k, t) in enumerate(catalog.KEYWORDS.items())) + ") AS v(query_key, keywords, call, gold_column, ord)"
_ROWS = "rows AS (SELECT source_file AS doc, chunk_index AS idx, chunk_id, any_value(page_content) AS text FROM chunks WHERE regexp_matches(page_content, '\\S') AND source_file IS NOT NULL {only} GROUP BY 1, 2, 3)"
_GOLDEN = "AND source_file IN (SELECT document_name FROM golden_dataset_template)"
_BM25 = f"""qs AS (SELECT * FROM {_QUERIES}),
 toks AS (SELECT doc, idx, {sql_tokens('text')} AS t FROM rows), tf AS (SELECT doc, idx, term, count(*) AS f FROM (SELECT doc, idx, unnest(t) AS term FROM toks) GROUP BY ALL),
 st AS (SELECT doc, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY doc), idf0 AS (SELECT doc, term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf JOIN st USING (doc) GROUP BY doc, term),
 mean AS (SELECT doc, avg(idf) AS m FROM idf0 GROUP BY doc), idf AS (SELECT doc, term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM idf0 JOIN mean USING (doc)),
 qt AS (SELECT query_key, term, count(*) AS qf FROM (SELECT query_key, unnest({sql_tokens('keywords')}) AS term FROM qs) GROUP BY ALL),
 sc AS (SELECT query_key, doc, idx, sum(qf * idf * f * 2.2 / (f + 1.2 * (0.6 + 0.4 * len(t) / avgdl))) AS score FROM tf JOIN qt USING (term) JOIN idf USING (doc, term) JOIN st USING (doc) JOIN toks USING (doc, idx) GROUP BY ALL),
 lex AS (SELECT query_key, r.doc, r.idx, coalesce(score, 0) AS score FROM rows r CROSS JOIN qs LEFT JOIN sc USING (query_key, doc, idx)),
 bm AS (SELECT query_key, doc, idx, round_even(score, 9) AS score, row_number() OVER (PARTITION BY query_key, doc ORDER BY round_even(score, 9) DESC, idx) AS rank FROM lex)"""
_DENSE = f"""tb AS (SELECT doc, idx, b, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc, idx, CAST('0x' || left(md5(term), 7) AS BIGINT) % 64 AS b FROM (SELECT doc, idx, unnest(t) AS term FROM toks)) GROUP BY ALL),
 qb AS (SELECT query_key, b, CAST(count(*) AS DOUBLE) AS qw FROM (SELECT query_key, CAST('0x' || left(md5(term), 7) AS BIGINT) % 64 AS b FROM (SELECT query_key, unnest({sql_tokens('keywords')}) AS term FROM qs)) GROUP BY ALL),
 cn AS (SELECT doc, idx, sqrt(sum(w * w)) AS cn FROM tb GROUP BY ALL), qn AS (SELECT query_key, sqrt(sum(qw * qw)) AS qn FROM qb GROUP BY ALL),
 dd AS (SELECT query_key, doc, idx, sum(w * qw) / (any_value(cn) * any_value(qn)) AS score FROM tb JOIN qb USING (b) JOIN cn USING (doc, idx) JOIN qn USING (query_key) GROUP BY ALL),
 de AS (SELECT query_key, r.doc, r.idx, coalesce(score, 0) AS raw, round_even(coalesce(score, 0), 9) AS score FROM rows r CROSS JOIN qs LEFT JOIN dd USING (query_key, doc, idx)),
 dn AS (SELECT *, row_number() OVER (PARTITION BY query_key, doc ORDER BY score DESC, idx) AS rank FROM de)"""
_ALL, _SOME = _ROWS.format(only=""), _ROWS.format(only=_GOLDEN)
_QUOTE = f"""gq AS (SELECT doc, gold_column, CAST(i - 1 AS INTEGER) AS quote_no, quote FROM (SELECT doc, gold_column, unnest(range(1, len(qq) + 1)) AS i, unnest(qq) AS quote FROM (
 SELECT doc, gold_column, list_filter(list_transform(string_split(cell, '|'), lambda x: {sql_squash('x')}), lambda x: x <> '') AS qq FROM (SELECT DISTINCT * FROM (
 {' UNION ALL '.join(f"SELECT document_name AS doc, '{g}' AS gold_column, {g} AS cell FROM golden_dataset_template" for g in GOLD)}) WHERE cell IS NOT NULL))))"""
_HITS = f"""best AS (SELECT * FROM bm WHERE rank <= 7), fr AS (SELECT gold_column, doc, idx, min(rank) AS rank FROM best JOIN qs USING (query_key) GROUP BY ALL),
 mt AS (SELECT gold_column, doc, quote_no, idx, fr.rank, row_number() OVER (PARTITION BY gold_column, doc, quote_no ORDER BY fr.rank, idx) AS o FROM gq JOIN fr USING (gold_column, doc) JOIN rows USING (doc, idx) WHERE contains({sql_squash('text')}, quote)),
 hits AS (SELECT gold_column, doc, quote_no, quote, idx, mt.rank FROM gq LEFT JOIN (SELECT * FROM mt WHERE o = 1) mt USING (gold_column, doc, quote_no)),
 score AS (SELECT gold_column, doc, expected, found, round_even(found / expected, 6) AS recall, CASE WHEN found = expected THEN 'PERFECT' WHEN found > 0 THEN 'PARTIAL' ELSE 'MISS' END AS hit_class, round_even(coalesce(1 / first, 0), 6) AS reciprocal_rank, round_even(coalesce(chunks / returned, 0), 6) AS precision
  FROM (SELECT gold_column, doc, count(*) AS expected, count(idx) AS found, min(rank) AS first, count(DISTINCT idx) AS chunks FROM hits GROUP BY ALL) LEFT JOIN (SELECT gold_column, doc, count(DISTINCT idx) AS returned FROM fr GROUP BY ALL) USING (gold_column, doc))"""


def _keyword_sql(key: str) -> str:
    """The keyword score of one query as SQL."""
    good, noise = [], []
    for g in catalog.QUERY_GROUPS[key]:
        for p, w in catalog.PATTERNS[g]:
            n = f"len(regexp_extract_all(text, {re2(p).replace(chr(92) + 'd', chr(92) + 'p{Nd}')}))"
            (noise if w < 0 else good).append(f"CASE WHEN {n} > 0 THEN {w} ELSE 0 END" if w < 0 else f"least({n}, 3) * {w}")
    a, b = " + ".join(good), " + ".join(noise)
    bonus, near = catalog.FIRST_CHUNK_BONUS[key], key in catalog.POSITION_QUERIES
    place = " + CASE WHEN f > 0 THEN CASE WHEN idx BETWEEN 1 AND 3 THEN 2 WHEN idx BETWEEN 4 AND 6 THEN 1 ELSE 0 END ELSE 0 END" if near else ""
    return f"SELECT doc, idx, '{key}' AS query_key, CAST(f{place} AS DOUBLE) AS kw FROM (SELECT doc, idx, r + CASE WHEN idx = 0 AND r > 0 THEN {bonus} ELSE 0 END AS f FROM (SELECT doc, idx, CASE WHEN g + n >= 5 THEN g + n - n * 0.5 ELSE g + n END AS r FROM (SELECT doc, idx, CAST({a} AS DOUBLE) AS g, CAST({b} AS DOUBLE) AS n FROM rows)))"


_COVER = """(SELECT doc, call, round_even(100 * sum(length(text)) / any_value(total), 1) AS coverage FROM (SELECT DISTINCT call, doc, idx FROM (SELECT call, doc, idx FROM bm JOIN qs USING (query_key) WHERE rank <= 7 UNION ALL SELECT 'both', doc, idx FROM bm WHERE rank <= 7)) JOIN rows USING (doc, idx) JOIN (SELECT doc, sum(length(text)) AS total FROM rows GROUP BY doc) USING (doc) GROUP BY doc, call)"""

SQL = {
    "v3_vector_search": """WITH f AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label), s AS (SELECT v.label, v.vec_id, f.query_id, v.embedding::DOUBLE[] AS a, e.embedding::DOUBLE[] AS b FROM embeddings v JOIN f USING (label) JOIN embeddings e ON e.vec_id = f.query_id AND e.label = v.label)
      SELECT label, vec_id, query_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT label, vec_id, query_id, round_even(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 4) AS score FROM s)) WHERE rank <= 10""",
    "v3_search_all": """WITH s AS (SELECT f.vec_id AS query_id, v.vec_id, round_even(list_dot_product(v.embedding::DOUBLE[], f.embedding::DOUBLE[]) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(f.embedding::DOUBLE[], f.embedding::DOUBLE[])), 4) AS score
 FROM embeddings f CROSS JOIN embeddings v WHERE f.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""",
    "r3_bm25": f"WITH {_ALL}, {_BM25} SELECT query_key, doc, idx, score, rank FROM (SELECT query_key, doc, idx, round_even(score, 6) AS score, row_number() OVER (PARTITION BY query_key, doc ORDER BY round_even(score, 6) DESC, idx) AS rank FROM lex) WHERE rank <= 7",
    "r6_dense": f"WITH {_ALL}, {_BM25}, {_DENSE} SELECT query_key, doc, idx, score, rank FROM (SELECT query_key, doc, idx, round_even(raw, 6) AS score, row_number() OVER (PARTITION BY query_key, doc ORDER BY round_even(raw, 6) DESC, idx) AS rank FROM de) WHERE rank <= 7",
    "r5_hybrid": f"""WITH {_ALL}, {_BM25}, {_DENSE}, fu AS (SELECT query_key, doc, idx, round_even(coalesce(0.7 / (60 + d.rank - 1), 0) + coalesce((1 - 0.7) / (60 + b.rank - 1), 0), 9) AS score FROM (SELECT * FROM dn WHERE rank <= 20) d FULL JOIN (SELECT * FROM bm WHERE rank <= 21) b USING (query_key, doc, idx))
      SELECT query_key, doc, idx, round_even(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_key, doc ORDER BY score DESC, idx) AS rank FROM fu) WHERE rank <= 7""",
    "r4_windows": f"WITH {_ALL}, {_BM25}, w AS (SELECT query_key, doc, b.idx, r.idx AS pos, r.text FROM bm b JOIN rows r USING (doc) WHERE b.rank <= 2 AND r.idx BETWEEN b.idx - 1 AND b.idx + 1) SELECT query_key, doc, idx, {sql_squash('string_agg(text, chr(32) ORDER BY pos)')} AS context FROM w GROUP BY query_key, doc, idx",
    "r8_adaptive": f"WITH {_ALL}, {_BM25}, b6 AS (SELECT query_key, doc, idx, row_number() OVER (PARTITION BY query_key, doc ORDER BY round_even(score, 6) DESC, idx) AS rank FROM lex), k AS (SELECT doc, CAST(CASE WHEN count(*) <= 30 THEN 7 ELSE least(12, 7 + floor((count(*) - 30) / 15)) END AS INTEGER) AS k_doc FROM rows GROUP BY doc) SELECT query_key, doc, idx, rank, k_doc FROM b6 JOIN k USING (doc) WHERE rank <= k_doc AND rank <= 12",
    "r9_merged": f"WITH {_ALL}, {_BM25}, b6 AS (SELECT query_key, doc, idx, round_even(score, 6) AS score, row_number() OVER (PARTITION BY query_key, doc ORDER BY round_even(score, 6) DESC, idx) AS rank FROM lex) SELECT call, doc, idx, max(score) AS score, list(query_key ORDER BY ord) AS source_queries FROM b6 JOIN qs USING (query_key) WHERE rank <= 7 GROUP BY call, doc, idx",
    "r11_assembled": f"WITH {_ALL}, {_BM25}, c AS (SELECT DISTINCT call, doc, idx FROM bm JOIN qs USING (query_key) WHERE rank <= 7) SELECT doc, CAST(count(*) FILTER (call = 'call1') AS INTEGER) AS n_call1, CAST(count(*) FILTER (call = 'call2') AS INTEGER) AS n_call2, count(DISTINCT idx) AS n_all, CAST(coalesce(sum(length(text)) FILTER (call = 'call1'), 0) AS INTEGER) AS chars_call1, CAST(coalesce(sum(length(text)) FILTER (call = 'call2'), 0) AS INTEGER) AS chars_call2 FROM c JOIN rows USING (doc, idx) GROUP BY doc",
    "q1_keyword_scores": f"WITH {_ALL} " + " UNION ALL ".join(_keyword_sql(k) for k in catalog.FIRST_CHUNK_BONUS),
    "m1_quotes": f"WITH {_QUOTE} SELECT * FROM gq",
    "m2_hits": f"WITH {_SOME}, {_BM25}, {_QUOTE}, {_HITS} SELECT * FROM hits",
    "m10_scores": f"WITH {_SOME}, {_BM25}, {_QUOTE}, {_HITS} SELECT * FROM score",
    "m12_summary": f"WITH {_SOME}, {_BM25}, {_QUOTE}, {_HITS} SELECT gold_column, count(*) AS n, round_even(100 * avg(recall), 4) AS recall_percent, round_even(avg(reciprocal_rank), 4) AS mrr, round_even(avg(precision), 4) AS precision_at_k FROM score GROUP BY gold_column",
    "m11_coverage": f"WITH {_SOME}, {_BM25}, g AS (SELECT DISTINCT call, doc, idx FROM bm JOIN qs USING (query_key) WHERE rank <= 7) SELECT call, doc, round_even(100 * sum(length(text)) / (SELECT sum(length(text)) FROM rows r WHERE r.doc = g.doc), 1) AS coverage FROM g JOIN rows USING (doc, idx) GROUP BY call, doc",
    "m16_gold": f"""WITH {_SOME}, {_QUOTE}, of AS (SELECT doc, idx, len(string_split({sql_squash('text')}, ' ')) AS n, EXISTS (SELECT 1 FROM gq WHERE gq.doc = rows.doc AND contains(lower({sql_squash('rows.text')}), lower(gq.quote))) AS gold FROM rows WHERE doc IN (SELECT doc FROM gq))
      SELECT doc, count(*) AS n_chunks, count(*) FILTER (gold) AS n_gold, round_even(avg(gold::INTEGER), 6) AS density, round_even(coalesce(sum(n) FILTER (gold), 0) / sum(n), 6) AS oracle_coverage FROM of GROUP BY doc""",
    "m18_robustness": f"WITH {_SOME}, {_BM25}, {_QUOTE}, {_HITS}, r AS (SELECT round_even(sum(found) / sum(expected), 6) AS recall FROM score GROUP BY doc) SELECT count(*) FILTER (recall >= 0.95) AS strong, count(*) FILTER (recall >= 0.8 AND recall < 0.95) AS fair, count(*) FILTER (recall < 0.8) AS weak FROM r",
    "m15_grid": f"""WITH {_SOME}, {_BM25}, {_QUOTE}, ks AS (SELECT unnest([2, 3, 4, 5, 6, 7, 10]) AS k), fr AS (SELECT gold_column, doc, idx, min(rank) AS rank FROM bm JOIN qs USING (query_key) WHERE rank <= 10 GROUP BY ALL),
      h AS (SELECT gold_column, gq.doc, quote_no, min(fr.rank) FILTER (contains({sql_squash('text')}, quote)) AS rank FROM gq LEFT JOIN fr USING (gold_column, doc) LEFT JOIN rows ON rows.doc = gq.doc AND rows.idx = fr.idx GROUP BY ALL),
      c AS (SELECT k, doc, round_even(100 * sum(length(text)) / (SELECT sum(length(text)) FROM rows r WHERE r.doc = g.doc), 1) AS coverage FROM (SELECT DISTINCT k, doc, idx FROM bm, ks WHERE rank <= k AND doc IN (SELECT doc FROM gq)) g JOIN rows USING (doc, idx) GROUP BY k, doc)
      SELECT CAST(k AS INTEGER) AS k, n_quotes, n_found, round_even(100 * n_found / n_quotes, 4) AS recall_percent, coverage FROM (SELECT k, count(*) AS n_quotes, count(*) FILTER (rank <= k) AS n_found FROM h, ks GROUP BY k) JOIN (SELECT k, round_even(avg(coverage), 4) AS coverage FROM c GROUP BY k) USING (k)""",
    "q5_reranked": f"""WITH {_ALL}, {_BM25}, {_DENSE}, fu AS (SELECT query_key, doc, idx, round_even(coalesce(0.7 / (60 + d.rank - 1), 0) + coalesce((1 - 0.7) / (60 + b.rank - 1), 0), 9) AS score FROM (SELECT * FROM dn WHERE rank <= 20) d FULL JOIN (SELECT * FROM bm WHERE rank <= 105) b USING (query_key, doc, idx)),
      pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key, doc ORDER BY score DESC, idx) AS pr FROM fu) WHERE pr <= 35), kw AS ({' UNION ALL '.join(_keyword_sql(k) for k in catalog.FIRST_CHUNK_BONUS)}),
      mm AS (SELECT query_key, doc, idx, pr, score, kw, min(score) OVER w AS a, max(score) OVER w AS b, min(kw) OVER w AS c, max(kw) OVER w AS d FROM pool JOIN kw USING (query_key, doc, idx) WINDOW w AS (PARTITION BY query_key, doc)),
      mix AS (SELECT query_key, doc, idx, pr, round_even(0.6 * CASE WHEN a = b THEN 0.5 ELSE (score - a) / (b - a) END + 0.4 * CASE WHEN c = d THEN 0.5 ELSE (kw - c) / (d - c) END, 6) AS score FROM mm)
      SELECT query_key, doc, idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_key, doc ORDER BY score DESC, pr) AS rank FROM mix) WHERE rank <= 7""",
    "r8_by_call": f"WITH {_ALL}, {_BM25}, b6 AS (SELECT query_key, doc, idx, row_number() OVER (PARTITION BY query_key, doc ORDER BY round_even(score, 6) DESC, idx) AS rank FROM lex), n AS (SELECT doc, count(*) AS n FROM rows GROUP BY doc) SELECT query_key, doc, idx, rank, CAST(CASE WHEN n <= 30 THEN 7 WHEN call = 'call1' THEN least(12, 7 + floor((n - 30) / 15)) ELSE least(10, 7 + floor((n - 30) / 20)) END AS INTEGER) AS k_doc FROM b6 JOIN n USING (doc) JOIN qs USING (query_key) WHERE rank <= CASE WHEN n <= 30 THEN 7 WHEN call = 'call1' THEN least(12, 7 + floor((n - 30) / 15)) ELSE least(10, 7 + floor((n - 30) / 20)) END",
    "r10_groups": f"WITH {_ALL}, {_BM25}, b6 AS (SELECT query_key, doc, idx, round_even(score, 6) AS score, row_number() OVER (PARTITION BY query_key, doc ORDER BY round_even(score, 6) DESC, idx) AS rank FROM lex), g(query_key, \"group\") AS (VALUES " + ", ".join(f"('{k}', '{g}')" for g, ks in GROUPS.items() for k in ks) + ", " + ", ".join(f"('{k}', 'all')" for ks in GROUPS.values() for k in ks) + ") SELECT \"group\", doc, idx, max(score) AS score, list(query_key ORDER BY ord) AS source_queries FROM b6 JOIN g USING (query_key) JOIN qs USING (query_key) WHERE rank <= 7 GROUP BY ALL",
    "m8_union": f"WITH {_SOME}, {_BM25}, o AS (SELECT gold_column, doc, idx, query_key, ord, rank, row_number() OVER (PARTITION BY gold_column, doc, idx ORDER BY ord, rank) AS k FROM bm JOIN qs USING (query_key) WHERE rank <= 7) SELECT gold_column, doc, idx, query_key, row_number() OVER (PARTITION BY gold_column, doc ORDER BY ord, rank) AS place FROM o WHERE k = 1",
    "m11_calls": f"WITH {_SOME}, {_BM25}, c AS {_COVER} SELECT doc, max(coverage) FILTER (call = 'call1') AS call1, max(coverage) FILTER (call = 'call2') AS call2, max(coverage) FILTER (call = 'both') AS both FROM c GROUP BY doc",
    "m13_weighted": f"WITH {_SOME}, {_BM25}, c AS {_COVER} SELECT round_even(avg(coverage), 4) AS mean_coverage, round_even(sum(coverage * n) / sum(n), 4) AS weighted_coverage FROM c JOIN (SELECT doc, count(*) AS n FROM rows GROUP BY doc) USING (doc) WHERE call = 'both'",
    "m15_experiments": f"""WITH {_SOME}, {_BM25}, {_DENSE}, {_QUOTE}, fu AS (SELECT query_key, doc, idx, round_even(coalesce(0.7 / (60 + d.rank - 1), 0) + coalesce((1 - 0.7) / (60 + b.rank - 1), 0), 9) AS score FROM (SELECT * FROM dn WHERE rank <= 20) d FULL JOIN (SELECT * FROM bm WHERE rank <= 30) b USING (query_key, doc, idx)),
      md AS (SELECT 'dense' AS mode, query_key, doc, idx, rank FROM dn UNION ALL SELECT 'bm25', query_key, doc, idx, rank FROM bm UNION ALL SELECT 'hybrid', query_key, doc, idx, row_number() OVER (PARTITION BY query_key, doc ORDER BY score DESC, idx) FROM fu),
      be AS (SELECT mode, gold_column, doc, idx, min(rank) AS rank FROM md JOIN qs USING (query_key) WHERE rank <= 10 GROUP BY ALL), ks(k) AS (VALUES {', '.join(f'({k})' for k in KS)}), ws(w) AS (VALUES {', '.join(f'({w})' for w in WINDOWS)}), ms AS (SELECT DISTINCT mode FROM md),
      tx AS (SELECT w, c.doc AS doc, c.idx AS idx, string_agg({sql_squash('n.text')}, ' ' ORDER BY n.idx) AS text FROM rows c JOIN ws ON true JOIN rows n ON n.doc = c.doc AND n.idx BETWEEN c.idx - w AND c.idx + w WHERE c.doc IN (SELECT doc FROM gq) GROUP BY ALL),
      fi AS (SELECT mode, w, gold_column, doc, quote_no, min(rank) AS rank FROM tx JOIN gq USING (doc) JOIN be USING (gold_column, doc, idx) WHERE contains(text, quote) GROUP BY ALL),
      fe AS (SELECT DISTINCT mode, k, w, be.doc AS doc, n.idx AS idx FROM be JOIN ks ON be.rank <= k JOIN ws ON true JOIN rows n ON n.doc = be.doc AND n.idx BETWEEN be.idx - w AND be.idx + w WHERE be.doc IN (SELECT doc FROM gq)),
      co AS (SELECT mode, k, w, round_even(avg(c), 4) AS coverage FROM (SELECT mode, k, w, doc, round_even(100 * sum(length(text)) / any_value(total), 1) AS c FROM fe JOIN rows USING (doc, idx) JOIN (SELECT doc, sum(length(text)) AS total FROM rows GROUP BY doc) USING (doc) GROUP BY ALL) GROUP BY ALL),
      nf AS (SELECT mode, k, w, count(*) AS n_found FROM fi JOIN ks ON rank <= k GROUP BY ALL), t AS (SELECT count(*) AS n_quotes FROM gq)
      SELECT mode, k, w, n_quotes, coalesce(n_found, 0) AS n_found, round_even(100 * coalesce(n_found, 0) / n_quotes, 4) AS recall_percent, coverage FROM ms CROSS JOIN ks CROSS JOIN ws CROSS JOIN t LEFT JOIN nf USING (mode, k, w) LEFT JOIN co USING (mode, k, w)""",
    "m21_long": f"WITH {_SOME}, {_BM25}, {_DENSE}, {_QUOTE}, md AS (SELECT 'before' AS m, query_key, doc, idx, rank FROM dn WHERE rank <= 7 UNION ALL SELECT 'after', query_key, doc, idx, rank FROM bm WHERE rank <= 7), fr AS (SELECT DISTINCT m, gold_column, doc, idx FROM md JOIN qs USING (query_key)), h AS (SELECT m.m, gq.doc, 100 * count(DISTINCT CASE WHEN contains({sql_squash('text')}, quote) THEN gq.gold_column || quote_no END) / count(DISTINCT gq.gold_column || quote_no) AS r FROM gq CROSS JOIN (VALUES ('before'), ('after')) m(m) LEFT JOIN fr ON fr.m = m.m AND fr.doc = gq.doc AND fr.gold_column = gq.gold_column LEFT JOIN rows ON rows.doc = fr.doc AND rows.idx = fr.idx GROUP BY ALL), n AS (SELECT doc, count(*) AS n_chunks FROM rows GROUP BY doc HAVING count(*) > 12) SELECT doc, n_chunks, round_even(max(r) FILTER (m = 'before'), 4) AS before, round_even(max(r) FILTER (m = 'after'), 4) AS after, round_even(round_even(max(r) FILTER (m = 'after'), 4) - round_even(max(r) FILTER (m = 'before'), 4), 4) AS delta FROM n JOIN h USING (doc) GROUP BY ALL",
}
SQL["r12_summary"] = "SELECT count(*) AS n_docs, " + ", ".join(f"round_even(avg({a}), 4) AS mean_{b}" for a, b in (("n_call1", "call1"), ("n_call2", "call2"), ("n_all", "all"), ("chars_call1", "chars_call1"), ("chars_call2", "chars_call2"))) + f" FROM ({SQL['r11_assembled']})"
