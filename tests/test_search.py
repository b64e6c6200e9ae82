import math
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexmill.operators import evaluation as E
from lexmill.operators import retrieval as R

TEXTS = {"d1": ["zmluvná pokuta vo výške 5% denne", "istina a úrok z omeškania", "iný text bez väzby", "pokuta istina"], "d2": ["dobré mravy a škoda", "nič"]}


@pytest.fixture(scope="module")
def corpus(spark):
    data = [(d, i, f"{d}_chunk_{i}", t) for d, ts in TEXTS.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(data, "doc string, idx int, chunk_id string, text string"), R.queries(spark)


def okapi(docs, query, k1=1.2, b=0.4):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query if t in d) for d in docs]


def test_bm25_against_brute_force(corpus):
    from lexmill.functions.text import tokens

    c, qs = corpus
    toks = {(r[0], r[1]): r[2] for r in c.select("doc", "idx", tokens("text")).collect()}
    words = {r[0]: r[1] for r in qs.select("query_key", tokens("keywords")).collect()}
    got = {(r["query_key"], r["doc"], r["idx"]): r["score"] for r in R.bm25(c, qs).collect()}
    for q, ws in words.items():
        for d, ts in TEXTS.items():
            for i, want in enumerate(okapi([toks[d, i] for i in range(len(ts))], ws)):
                assert got[q, d, i] == pytest.approx(want, abs=1e-9)


def test_ranks_fusion_and_rerank(corpus):
    c, qs = corpus
    best = R.retrieve(c, qs, "hybrid", 3).collect()
    assert {r["rank"] for r in best} <= {1, 2, 3} and len({(r["query_key"], r["doc"], r["idx"]) for r in best}) == len(best)
    assert R.reranked(c, qs, k=2).groupBy("query_key", "doc").count().agg(F.max("count")).first()[0] == 2
    with pytest.raises(ValueError):
        R.retrieve(c, qs, "other")


def test_min_max(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 6.0), ("a", 10.0), ("b", 3.0)], "g string, v double")
    assert sorted(r[0] for r in df.select(R.min_max("v", ["g"])).collect()) == [0.0, 0.5, 0.5, 1.0]


def test_adaptive_k(spark):
    assert spark.range(1).select(R.adaptive_k(F.lit(86), 7)).first()[0] == 10 and spark.range(1).select(R.adaptive_k(F.lit(30), 7)).first()[0] == 7


def test_keyword_score_counts_three_at_most(spark, corpus):
    df = spark.createDataFrame([("d", 0, "v omeškaní " * 5), ("d", 9, "trovy konania"), ("d", 10, None)], "doc string, idx int, text string")
    got = {(r["idx"], r["query_key"]): r["kw"] for r in R.keyword_scores(df.where("text IS NOT NULL")).collect()}
    assert got[0, "q_breach"] == 6 + 3 and got[9, "q_breach"] == -2


def test_hits_and_grid(spark, corpus):
    c, qs = corpus
    gold = E.quotes(spark.createDataFrame([("d1", "istina a úrok | chýba", None, ""), ("d1", "istina a úrok | chýba", None, "")], "document_name string, q1_context_quotes string, q2_penalty_quotes string, q3_moderation_quotes string"), ["q1_context_quotes", "q2_penalty_quotes", "q3_moderation_quotes"])
    best = R.ranked(R.bm25(c, qs), 10)
    hit = E.hits(best, c, qs, gold)
    assert [(r["quote"], r["idx"]) for r in hit.orderBy("quote_no").collect()] == [("istina a úrok", 1), ("chýba", None)]
    s = E.scores(hit, best, qs).first()
    assert s["hit_class"] == "PARTIAL" and s["recall"] == 0.5
    g = {r["k"]: r["n_found"] for r in E.grid(best, c, qs, gold, [1, 4]).collect()}
    assert g[4] == 1


def test_empty(spark, corpus):
    c, qs = corpus
    assert rows(R.retrieve(c.limit(0), qs, "hybrid", 3)) == []
    assert rows(R.merged(R.ranked(R.bm25(c.limit(0), qs), 3), qs)) == []


def test_group_limit_is_planned(corpus):
    c, qs = corpus
    assert "WindowGroupLimit" in R.ranked(R.bm25(c, qs), 3)._jdf.queryExecution().toString()
