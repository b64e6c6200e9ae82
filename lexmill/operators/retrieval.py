"""Lexical, dense and hybrid retrieval inside each document, re-ranking, and child-to-parent search.

Inputs are chunk rows (doc, idx, text) and a query table. Scores of all queries over all documents
come from one plan: each text is read once, where it lies, into its tokens, its dense vector's cosines with the queries and
its keyword scores; only these are shuffled, once, by document. As a document is a corpus of its own, term statistics,
scores, ranks and fusion are windows and groups within that partitioning. Query terms are few (fixed by the catalogue) and
broadcast. A rank is a column, so every k is read off one result. Documents of more than ``HOT`` chunks take a way whose
shuffles go by document and term, with the same scores.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import checkpointed
from ..functions import catalog
from ..functions.text import portable, squash, tokens


@dataclass(frozen=True)
class Config:
    """Parameters of retrieval; the defaults are the production preset."""

    top_k: int = 7
    alpha: float = 0.7
    rrf_k: int = 60
    dense_cap: int = 20
    pool: int = 3
    k1: float = 1.2
    b: float = 0.4
    rerank_alpha: float = 0.6
    oversample: int = 5
    dims: int = 64


def queries(spark: SparkSession) -> DataFrame:
    """(query_key, keywords, call, gold_column, ord), seven rows."""
    call = {q: c for c, qs in catalog.CALLS.items() for q in qs}
    return spark.createDataFrame([(q, t, call[q], catalog.GOLD_COLUMN[q], i) for i, (q, t) in enumerate(catalog.KEYWORDS.items())], "query_key string, keywords string, call string, gold_column string, ord int")


def chunk_rows(chunks: DataFrame, once: bool = True) -> DataFrame:
    """(doc, idx, chunk_id, text) of non-empty chunks, each once, or as delivered; ``scores`` takes each (doc, idx) once itself and so needs no shuffle of texts."""
    has = chunks.where(F.col("page_content").rlike(r"\S") & F.col("source_file").isNotNull())
    out = has.select(F.col("source_file").alias("doc"), F.col("chunk_index").alias("idx"), "chunk_id", F.col("page_content").alias("text"))
    return out.repartition("doc").dropDuplicates(["doc", "idx", "chunk_id"]) if once else out


#: chunks from which a document is not left to one task
HOT = 100_000


def _terms(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "idx", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term")).groupBy("doc", "idx", "term").agg(F.count("term").alias("f"), F.max("dl").alias("dl"))


def _wanted(query: DataFrame) -> DataFrame:
    return query.select("query_key", F.explode(tokens("keywords")).alias("term")).groupBy("query_key", "term").agg(F.count("*").alias("qf"))


def _part(cfg: Config) -> Column:
    """What a term adds to a chunk's score, its weight in the query aside."""
    return F.col("idf") * F.col("f") * (cfg.k1 + 1) / (F.col("f") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))


def _spread(rows: DataFrame, query: DataFrame, cfg: Config) -> DataFrame:
    """(query_key, doc, idx, lexical) of documents of any size: every shuffle goes by document and term or chunk. ``rows``: (doc, idx, toks)."""
    terms = checkpointed(_terms(rows))  # read five times below
    stats = terms.groupBy("doc", "idx").agg(F.max("dl").alias("dl")).groupBy("doc").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = terms.where("term IS NOT NULL").groupBy("doc", "term").agg(F.count("*").alias("df")).join(stats, "doc")
    idf = df.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.groupBy("doc").agg(F.avg("idf").alias("mean_idf"))
    asked = idf.join(F.broadcast(_wanted(query)), "term").join(mean, "doc")
    asked = asked.withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("idf"))).select("query_key", "doc", "term", "qf", "idf", "avgdl")
    hit = terms.where("term IS NOT NULL").join(asked, ["doc", "term"])
    scored = hit.groupBy("query_key", "doc", "idx").agg(F.sum(F.col("qf") * _part(cfg)).alias("score"))
    every = rows.select("doc", "idx").crossJoin(F.broadcast(query.select("query_key")))  # seven queries, the catalogue's
    return every.join(scored, ["query_key", "doc", "idx"], "left").select("query_key", "doc", "idx", F.coalesce("score", F.lit(0.0)).alias("lexical"))


def _within(rows: DataFrame, keys: list[str], wanted: DataFrame, cfg: Config, keep: list[str]) -> DataFrame:
    """(doc, idx, lexical, keep...), ``lexical`` an array in the order of ``keys``. ``rows``: (doc, idx, toks, keep...), partitioned by doc, which all that follows goes by.

    Every chunk has one row per distinct term and one without a term, which stands for the chunk and carries what is kept.
    The mean idf of a document's terms is the sum over (chunk, term) of idf / df by that of 1 / df.
    """
    of = Window.partitionBy("doc")
    nothing = [F.lit(None).cast("array<double>").alias(c) for c in keep]
    terms = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), *keep)), F.transform("toks", lambda t: F.struct(t.alias("term"), *nothing)))
    each = rows.select("doc", "idx", F.size("toks").alias("dl"), F.explode(terms).alias("x")).select("doc", "idx", "dl", "x.*")
    found = each.groupBy("doc", "idx", "term").agg(F.count("term").alias("f"), F.max("dl").alias("dl"), *[F.first(c, True).alias(c) for c in keep])
    chunk = F.col("term").isNull()
    found = found.withColumn("df", F.when(~chunk, F.count("*").over(Window.partitionBy("doc", "term"))))
    found = found.withColumn("n", F.count(F.when(chunk, 1)).over(of)).withColumn("avgdl", F.avg(F.when(chunk, F.col("dl"))).over(of))
    found = found.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    found = found.withColumn("mean_idf", F.sum(F.col("idf") / F.col("df")).over(of) / F.sum(1 / F.col("df")).over(of))
    found = found.withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("idf"))).join(F.broadcast(wanted), "term", "left")
    sums = [F.coalesce(F.sum(F.when(F.col("qf")[k] > 0, F.col("qf")[k] * _part(cfg))), F.lit(0.0)) for k in keys]
    return found.groupBy("doc", "idx").agg(F.array(*sums).alias("lexical"), *[F.first(c, True).alias(c) for c in keep])


def scores(rows: DataFrame, query: DataFrame, cfg: Config = Config(), dense: bool = False, keywords: bool = False) -> DataFrame:
    """(query_key, doc, idx, lexical[, dense][, kw]) of every chunk: Okapi, cosine of hashed bags of words, keyword score; 0 without a hit.

    The corpus is the document's own chunks. A negative idf is replaced by a quarter of the mean idf of the document's
    terms; a term repeated in the query counts as often.
    """
    asked = [(r["query_key"], r["toks"]) for r in query.select("query_key", tokens("keywords").alias("toks")).orderBy("query_key").collect()]  # seven queries
    keys = [k for k, _ in asked]
    each = rows.select("doc", "idx", tokens("text").alias("toks"), *([pattern_hits(F.col("text")).alias("_hits")] if keywords else []))
    keep = []
    if dense:
        each = each.withColumn("dense", _cosines([t for _, t in asked], cfg.dims)(F.transform("toks", lambda t: _bucket(t, cfg.dims))))
        keep.append("dense")
    if keywords:
        each = each.withColumn("kw", F.array(*[placed_keyword_score(F.col("_hits"), F.col("idx"), k) for k in keys])).drop("_hits")
        keep.append("kw")
    wanted = _wanted(query).groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("query_key", "qf"))).alias("qf"))
    hot = checkpointed(rows.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("doc"))
    crowded = bool(hot.head(1))
    few = each.join(F.broadcast(hot), "doc", "left_anti") if crowded else each  # more than HOT chunks each, so few
    out = _within(few.repartition("doc").dropDuplicates(["doc", "idx"]), keys, wanted, cfg, keep)
    flat = F.array(*[F.struct(F.lit(k).alias("query_key"), *[F.col(c)[i].alias(c) for c in ("lexical", *keep)]) for i, k in enumerate(keys)])
    out = out.select("doc", "idx", F.inline(flat)).select("query_key", "doc", "idx", "lexical", *keep)
    if crowded:
        most = checkpointed(each.join(F.broadcast(hot), "doc", "left_semi").dropDuplicates(["doc", "idx"]))
        other = [F.struct(F.lit(k).alias("query_key"), *[F.col(c)[i].alias(c) for c in keep]) for i, k in enumerate(keys)]
        rest = most.select("doc", "idx", F.inline(F.array(*other)))
        out = out.unionByName(_spread(most.select("doc", "idx", "toks"), query, cfg).join(rest, ["query_key", "doc", "idx"]))
    return out


def bm25(rows: DataFrame, query: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(query_key, doc, idx, score): Okapi scores of every chunk, see ``scores``."""
    return scores(rows, query, cfg).withColumnRenamed("lexical", "score")


def _bucket(term: Column, dims: int) -> Column:
    return F.conv(F.substring(F.md5(F.encode(term, "UTF-8")), 1, 7), 16, 10).cast("long") % dims


def _cosines(queries: list[list[str]], dims: int) -> object:
    """A function from a chunk's buckets to its cosines with all queries, in Arrow batches."""
    own = np.array([np.bincount([int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dims for t in ts], minlength=dims) for ts in queries], dtype=np.float64).reshape(-1, dims)
    size = np.linalg.norm(own, axis=1)

    def run(buckets: pd.Series) -> pd.Series:
        bags = np.array([np.bincount(b, minlength=dims) if b is not None and len(b) else np.zeros(dims) for b in buckets], dtype=np.float64).reshape(-1, dims)
        by = np.linalg.norm(bags, axis=1)[:, None] * size[None, :]
        return pd.Series(list(np.divide(bags @ own.T, by, out=np.zeros(by.shape), where=by > 0)))

    return F.pandas_udf(run, "array<double>")


def hashed_dense(rows: DataFrame, query: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(query_key, doc, idx, score): cosine of hashed bag-of-words vectors, the offline embedder; stored vectors can take its place. Only cosines are shuffled."""
    asked = [(r["query_key"], r["toks"]) for r in query.select("query_key", tokens("keywords").alias("toks")).orderBy("query_key").collect()]  # seven queries
    near = _cosines([t for _, t in asked], cfg.dims)(F.transform(tokens("text"), lambda t: _bucket(t, cfg.dims)))
    each = rows.select("doc", "idx", near.alias("d")).repartition("doc").dropDuplicates(["doc", "idx"])
    flat = F.array(*[F.struct(F.lit(k).alias("query_key"), F.col("d")[i].alias("score")) for i, (k, _) in enumerate(asked)])
    return each.select("doc", "idx", F.inline(flat)).select("query_key", "doc", "idx", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(label, vec_id, query_id, score, rank): exact cosine top k of stored vectors within each label. ``queries``: one vector per label."""
    q = queries.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    scored = vectors.join(q, "label").select("label", "vec_id", "query_id", F.bround(cosine(F.col("embedding"), F.col("q")), 4).alias("score"))
    return top(scored, ["label"], [F.desc("score"), F.asc("vec_id")], k)


def search_all(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine top k of all stored vectors, whatever their label, for each query.

    Every block of queries meets every block of vectors once and leaves its best candidates, so that no
    worker holds more than two blocks. A query that is stored finds itself, as in ``vector_search``;
    null vectors and vectors of length 0 have no cosine and no rows.
    """
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding", part(n_v).alias("vb"), every(n_q).alias("qb"))
    q = queries.where("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), part(n_q).alias("qb"), every(n_v).alias("vb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if a.empty or b.empty:
            return empty
        x, y = (np.array(c.tolist(), dtype=np.float64) for c in (a["embedding"], b["q"]))
        ok, asked = np.linalg.norm(x, axis=1) > 0, np.linalg.norm(y, axis=1) > 0
        x, y, ids, of = x[ok], y[asked], a["vec_id"].to_numpy()[ok], b["query_id"].to_numpy()[asked]
        if not len(x) or not len(y):
            return empty
        cos = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        least = np.partition(cos, -k, axis=1)[:, -k] if cos.shape[1] > k else np.full(len(y), -2.0)
        i, j = np.nonzero(cos >= least[:, None] - 1.01e-4)  # what may tie once scores are rounded to four places
        return pd.DataFrame({"query_id": of[i], "vec_id": ids[j], "score": cos[i, j]})

    found = v.groupBy("qb", "vb").cogroup(q.groupBy("qb", "vb")).applyInPandas(best, "query_id long, vec_id long, score double")
    return top(found.withColumn("score", F.bround("score", 4)), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def top(df: DataFrame, by: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def ranked(scores: DataFrame, k: int | None, digits: int | None = 9) -> DataFrame:
    """Best ``k`` chunks per query and document; ties keep the chunks' order."""
    s = scores if digits is None else scores.withColumn("score", F.bround("score", digits))
    return top(s, ["query_key", "doc"], [F.desc("score"), F.asc("idx")], k)


def fuse(both: DataFrame, k: int, cfg: Config = Config(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Weighted reciprocal-rank fusion of the columns ``dense`` and ``lexical``; ranks from 0, an absent side adds nothing, ties go to the earlier chunk."""
    of = Window.partitionBy("query_key", "doc")
    place = lambda c: F.row_number().over(of.orderBy(F.desc(F.bround(c, 9)), F.asc("idx"))) - 1
    at = both.withColumn("rd", place("dense")).withColumn("rb", place("lexical"))
    at = at.withColumn("rd", F.when(F.col("rd") < min(cfg.pool * k, cfg.dense_cap), F.col("rd"))).withColumn("rb", F.when(F.col("rb") < cfg.pool * k, F.col("rb")))
    score = F.coalesce(F.lit(cfg.alpha) / (cfg.rrf_k + F.col("rd")), F.lit(0.0)) + F.coalesce(F.lit(1 - cfg.alpha) / (cfg.rrf_k + F.col("rb")), F.lit(0.0))
    return ranked(at.where("rd IS NOT NULL OR rb IS NOT NULL").select("query_key", "doc", "idx", score.alias("score"), *keep), k, 9)


def retrieve(rows: DataFrame, query: DataFrame, mode: str = "hybrid", k: int | None = None, cfg: Config = Config()) -> DataFrame:
    """Best chunks by mode: ``dense``, ``bm25`` or ``hybrid``."""
    k = k or cfg.top_k
    if mode == "dense":
        return ranked(hashed_dense(rows, query, cfg), k)
    if mode == "bm25":
        return ranked(bm25(rows, query, cfg), k)
    if mode == "hybrid":
        return fuse(scores(rows, query, cfg, dense=True), k, cfg)
    raise ValueError(f"unknown mode {mode!r}")


def windowed(hits: DataFrame, rows: DataFrame, w: int) -> DataFrame:
    """Each hit with its text and that of ``w`` neighbours on either side, in order, joined by blanks."""
    at = hits.select("query_key", "doc", "idx", F.explode(F.sequence(F.lit(-w), F.lit(w))).alias("d")).withColumn("at", F.col("idx") + F.col("d"))
    text = at.join(rows.select("doc", F.col("idx").alias("at"), "text"), ["doc", "at"])
    parts = text.groupBy("query_key", "doc", "idx").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    return parts.select("query_key", "doc", "idx", squash(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("context"))


_BANK = [(g, p, float(w)) for g, ps in catalog.PATTERNS.items() for p, w in ps]


def count_hits(texts: pd.Series) -> pd.Series:
    """Per text the number of matches of each pattern; patterns are lower case and compiled once per worker, texts are lowered."""
    bank = _compiled()
    return texts.map(lambda t: [len(p.findall(t)) for p in bank])


@lru_cache(maxsize=1)
def _compiled() -> list[re.Pattern]:
    return [re.compile(p.removeprefix("(?i)").lower()) for _, p, _ in _BANK]


def pattern_hits(text: Column) -> Column:
    """How often each pattern of the catalogue occurs, as one array: every pattern runs once per text, whatever queries share it.

    So many literal patterns outgrow a generated method, and patterns that are data would be compiled for every row,
    so they run in Arrow batches.
    """
    return F.pandas_udf(count_hits, "array<int>")(F.lower(F.coalesce(text, F.lit(""))))


def keyword_score(hits: Column, query_key: str) -> Column:
    """Weights of matched patterns, at most three times each; a noise pattern counts once, and half of it is given back from 5 points up."""
    groups = catalog.QUERY_GROUPS[query_key]
    weights = F.array(*[F.lit(w if g in groups else 0.0) for g, _, w in _BANK])
    parts = F.zip_with(hits, weights, lambda n, w: F.when(w < 0, F.when(n > 0, w).otherwise(0.0)).otherwise(F.least(n, F.lit(3)) * w))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    score, noise = total(parts), total(F.filter(parts, lambda x: x < 0))
    return F.when(score >= 5, score - noise * 0.5).otherwise(score)


def placed_keyword_score(hits: Column, idx: Column, query_key: str) -> Column:
    """The keyword score of a query with the bonuses of the first chunks."""
    raw = keyword_score(hits, query_key)
    first = raw + F.when((idx == 0) & (raw > 0), float(catalog.FIRST_CHUNK_BONUS[query_key])).otherwise(0.0)
    if query_key not in catalog.POSITION_QUERIES:
        return first
    place = F.when(idx.between(1, 3), 2.0).when(idx.between(4, 6), 1.0).otherwise(0.0)
    return first + F.when(first > 0, place).otherwise(0.0)


def keyword_scores(rows: DataFrame) -> DataFrame:
    """(doc, idx, query_key, kw): the scores with the bonuses of the first chunks, all queries from one pass over the texts."""
    counted = rows.select("doc", "idx", pattern_hits(F.col("text")).alias("_hits"))
    each = F.array(*[F.struct(F.lit(q).alias("query_key"), placed_keyword_score(F.col("_hits"), F.col("idx"), q).alias("kw")) for q in catalog.FIRST_CHUNK_BONUS])
    return counted.select("doc", "idx", F.inline(each))


def matched_patterns(text: Column, group: str) -> Column:
    """Which patterns of a group match how often, for explaining a score."""
    hits = [F.struct(F.lit(p).alias("key"), F.regexp_count(text, F.lit(portable(p))).alias("value")) for p, _ in catalog.PATTERNS[group]]
    return F.map_from_entries(F.filter(F.array(*hits), lambda h: h["value"] > 0))


def min_max(col: str, by: list[str]) -> Column:
    """Scaled to [0, 1] within a group, 0.5 if all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.when(hi == lo, 0.5).otherwise((F.col(col) - lo) / (hi - lo))


def rerank(pool: DataFrame, k: int, alpha: float = 0.6) -> DataFrame:
    """(query_key, doc, idx, score, rank): a pool with ``kw`` re-ranked by scaled retrieval and keyword scores; ties keep the pool's order."""
    by = ["query_key", "doc"]
    mixed = pool.withColumnRenamed("rank", "pool_rank").withColumn("score", F.bround(alpha * min_max("score", by) + (1 - alpha) * min_max("kw", by), 6))
    return top(mixed, by, [F.desc("score"), F.asc("pool_rank")], k).select("query_key", "doc", "idx", "score", "rank")


def reranked(rows: DataFrame, query: DataFrame, mode: str = "hybrid", k: int | None = None, cfg: Config = Config()) -> DataFrame:
    """Oversampled retrieval, then re-ranking to k. Keyword scores come from the pass that reads the texts, so none is joined again."""
    k = k or cfg.top_k
    pool = k * cfg.oversample
    all_ = scores(rows, query, cfg, dense=mode != "bm25", keywords=True)
    if mode == "hybrid":
        return rerank(fuse(all_, pool, cfg, ("kw",)), k, cfg.rerank_alpha)
    if mode not in ("dense", "bm25"):
        raise ValueError(f"unknown mode {mode!r}")
    one = all_.select("query_key", "doc", "idx", F.col("dense" if mode == "dense" else "lexical").alias("score"), "kw")
    return rerank(ranked(one, pool), k, cfg.rerank_alpha)


def adaptive_k(n: Column, k: int, most: int = 5, every: int = 15) -> Column:
    """k, grown with the number of chunks beyond 30."""
    return F.when(n <= 30, F.lit(k)).otherwise(F.least(F.lit(k + most), k + F.floor((n - 30) / every))).cast("int")


def adaptive(ranked_all: DataFrame, rows: DataFrame, k: int, most: int = 5, every: int = 15) -> DataFrame:
    """Hits up to each document's own k. ``ranked_all``: ranked at least to k + most."""
    n = rows.groupBy("doc").agg(F.count("*").alias("n"))
    return ranked_all.join(n, "doc").withColumn("k_doc", adaptive_k(F.col("n"), k, most, every)).where("rank <= k_doc").drop("n")


#: how k grows with the chunks of a document, by call: at most so many more, one for every so many chunks beyond 30
GROWTH = {"call1": (5, 15), "call2": (3, 20)}


def adaptive_by_call(ranked_all: DataFrame, rows: DataFrame, query: DataFrame, k: int, growth: dict[str, tuple[int, int]] = GROWTH) -> DataFrame:
    """Hits up to each document's own k, which grows by call. ``ranked_all``: ranked at least to k and the most more."""
    n = rows.groupBy("doc").agg(F.count("*").alias("n"))
    j = ranked_all.join(n, "doc").join(F.broadcast(query.select("query_key", "call")), "query_key")
    own = F.coalesce(*[F.when(F.col("call") == c, adaptive_k(F.col("n"), k, most, every)) for c, (most, every) in growth.items()], F.lit(k))
    return j.withColumn("k_doc", own).where("rank <= k_doc").drop("n", "call")


def merged_groups(hits: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, doc, idx, score, source_queries): hits of every group's queries, and of all groups together as ``all``; each chunk once with its best score, in document order."""
    pairs = [(q, g) for g, qs in groups.items() for q in qs] + [(q, "all") for q in dict.fromkeys(q for qs in groups.values() for q in qs)]
    of = hits.sparkSession.createDataFrame(pairs, "query_key string, group string")
    order = F.create_map(*[F.lit(x) for i, q in enumerate(catalog.KEYWORDS) for x in (q, i)])
    h = hits.join(F.broadcast(of), "query_key")
    out = h.groupBy("group", "doc", "idx").agg(F.bround(F.max("score"), 6).alias("score"), F.array_sort(F.collect_set(F.struct(order[F.col("query_key")].alias("i"), F.col("query_key").alias("q")))).alias("qs"))
    return out.select("group", "doc", "idx", "score", F.transform("qs", lambda x: x["q"]).alias("source_queries"))


def run_summary(assembled: DataFrame) -> DataFrame:
    """(n_docs, mean_call1, mean_call2, mean_all, mean_chars_call1, mean_chars_call2): one row over a run."""
    mean = lambda c, n: F.bround(F.avg(c), 4).alias(n)
    return assembled.agg(F.count("*").alias("n_docs"), mean("n_call1", "mean_call1"), mean("n_call2", "mean_call2"), mean("n_all", "mean_all"), mean("chars_call1", "mean_chars_call1"), mean("chars_call2", "mean_chars_call2"))


def merged(hits: DataFrame, query: DataFrame) -> DataFrame:
    """(call, doc, idx, score, source_queries): hits of a call's queries, each chunk once, in document order."""
    order = F.create_map(*[F.lit(x) for i, q in enumerate(catalog.KEYWORDS) for x in (q, i)])
    h = hits.join(F.broadcast(query.select("query_key", "call")), "query_key")
    out = h.groupBy("call", "doc", "idx").agg(F.bround(F.max("score"), 6).alias("score"), F.array_sort(F.collect_set(F.struct(order[F.col("query_key")].alias("i"), F.col("query_key").alias("q")))).alias("qs"))
    return out.select("call", "doc", "idx", "score", F.transform("qs", lambda x: x["q"]).alias("source_queries"))


def assembled(merged: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, n_call1, n_call2, n_all, chars_call1, chars_call2, call1_chunks, call2_chunks): one row per document."""
    text = merged.join(rows, ["doc", "idx"]).select("doc", "call", F.struct("idx", "chunk_id", "text", "score", "source_queries").alias("c"))
    of = lambda call: F.array_sort(F.collect_list(F.when(F.col("call") == call, F.col("c"))))
    out = text.groupBy("doc").agg(of("call1").alias("call1_chunks"), of("call2").alias("call2_chunks"), F.countDistinct("c.idx").alias("n_all"))
    size = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.char_length(x["text"]))
    return out.select("doc", F.size("call1_chunks").alias("n_call1"), F.size("call2_chunks").alias("n_call2"), "n_all", size("call1_chunks").alias("chars_call1"), size("call2_chunks").alias("chars_call2"), "call1_chunks", "call2_chunks")


def parent_scores(child_hits: DataFrame, query: DataFrame) -> DataFrame:
    """(call, doc, parent_index, score, n_queries): the best child, raised by further queries that find it or the parent."""
    h = child_hits.join(F.broadcast(query.select("query_key", "call")), "query_key")
    return _parent_scores(h, [])


def parent_grid(child_hits: DataFrame, query: DataFrame, fetch: list[int]) -> DataFrame:
    """(fetch_k, call, doc, parent_index, score, n_queries): ``parent_scores`` of the best ``fetch_k`` children of each query, for every listed one, off one ranking."""
    ks = F.broadcast(child_hits.sparkSession.createDataFrame([(k,) for k in fetch], "fetch_k int"))
    h = child_hits.join(F.broadcast(query.select("query_key", "call")), "query_key").crossJoin(ks).where("rank <= fetch_k")
    return _parent_scores(h, ["fetch_k"])


def _parent_scores(h: DataFrame, by: list[str]) -> DataFrame:
    kids = h.groupBy(*by, "call", "doc", "parent_index", "child_index").agg((F.max("score") + 0.15 * (F.count("*") - 1)).alias("child"))
    key = [*by, "call", "doc", "parent_index"]
    asked = h.groupBy(*key).agg(F.countDistinct("query_key").alias("n_queries"))
    best = kids.groupBy(*key).agg(F.max("child").alias("child"))
    return best.join(asked, key).select(*by, "call", "doc", "parent_index", F.bround(F.col("child") + 0.12 * (F.col("n_queries") - 1), 6).alias("score"), "n_queries")


def parent_context(scores: DataFrame, parents: DataFrame, n: int | list[int]) -> DataFrame:
    """(call, doc, context): the best ``n`` parents in document order, each under a label line. A list of ``n`` gives one for each, in the column ``n_parents``; a column ``fetch_k`` stays."""
    by = [c for c in ("fetch_k",) if c in scores.columns]
    ns = [n] if isinstance(n, int) else n
    best = top(scores, [*by, "call", "doc"], [F.desc("score"), F.asc("parent_index")], max(ns))
    if not isinstance(n, int):
        best = best.crossJoin(F.broadcast(scores.sparkSession.createDataFrame([(k,) for k in ns], "n_parents int"))).where("rank <= n_parents")
        by.append("n_parents")
    text = best.join(parents.select(F.col("source_file").alias("doc"), "parent_index", "point_number", "page_content"), ["doc", "parent_index"])
    label = F.format_string("PARENT %d | point=%d | score=%.4f | queries=%d\n%s", "parent_index", "point_number", "score", "n_queries", "page_content")
    parts = text.select(*by, "call", "doc", F.struct("parent_index", label.alias("t")).alias("p")).groupBy(*by, "call", "doc").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select(*by, "call", "doc", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("context"))
