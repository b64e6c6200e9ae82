import math
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as X
from lexmill.operators import casebase as C
from lexmill.operators import embedding as E
from lexmill.operators import evaluation as V
from lexmill.operators import extraction as L
from lexmill.operators import retrieval as R

TEXTS = [("d", 0, "zmluvná pokuta denne pokuta"), ("d", 1, "istina suma dlh"), ("d", 2, "iné slová vety"), ("d", 3, "zmluvná istina"), ("e", 0, "pokuta"), ("e", 1, "")]


def chunks(spark, extra=()):
    return spark.createDataFrame([*TEXTS, *extra], "doc string, idx int, text string")


def test_scores_of_large_documents_take_another_way_to_the_same_numbers(spark, monkeypatch):
    q = R.queries(spark)
    one = rows(R.scores(chunks(spark, TEXTS[:2]), q, dense=True, keywords=True))
    monkeypatch.setattr(R, "HOT", 3)
    two = rows(R.scores(chunks(spark, TEXTS[:2]), q, dense=True, keywords=True))
    assert len(one) == len(two) == 7 * len(TEXTS)
    for a, b in zip(one, two):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-12)


def test_okapi_against_plain_python(spark):
    toks = {r[0:2]: r[2] for r in rows(chunks(spark).select("doc", "idx", X.tokens("text")))}
    asked = {r["query_key"]: Counter(r["t"]) for r in R.queries(spark).select("query_key", X.tokens("keywords").alias("t")).collect()}
    got = {(r["query_key"], r["doc"], r["idx"]): r["score"] for r in R.bm25(chunks(spark), R.queries(spark)).collect()}
    for d in "de":
        own = {k: v for k, v in toks.items() if k[0] == d}
        n, avg = len(own), sum(map(len, own.values())) / len(own)
        df = Counter(t for v in own.values() for t in set(v))
        idf = {t: math.log((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
        mean = sum(idf.values()) / len(idf)
        idf = {t: x if x >= 0 else 0.25 * mean for t, x in idf.items()}
        for key, want in asked.items():
            for k, v in own.items():
                f = Counter(v)
                s = sum(m * idf[t] * f[t] * 2.2 / (f[t] + 1.2 * (0.6 + 0.4 * len(v) / avg)) for t, m in want.items() if t in f)
                assert got[key, *k] == pytest.approx(s, abs=1e-9)


def test_embeddings(spark):
    df = spark.createDataFrame([("a", "zmluvná pokuta"), ("b", ""), ("c", None)], "id string, t string")
    v = {r["id"]: r["vector"] for r in E.embedded(df, "t").collect()}
    assert sum(x * x for x in v["a"]) == pytest.approx(1) and not any(v["b"]) and not any(v["c"])
    seen = lambda texts: [(i, [float(len(t)), 0.0]) for i, t in reversed(list(enumerate(texts)))]
    w = {r["id"]: r["vector"] for r in E.embedded(df, "t", seen, batch=2).collect()}
    assert w["a"] == [1.0, 0.0] and w["c"] == [1.0, 0.0]
    near = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], None)], "a array<double>, b array<double>")
    assert [r[0] for r in near.select(E.likeness("a", "b")).collect()] == [0.6, 0.0, 0.0]
    m = spark.createDataFrame([("7", None, "x")], "n string, s string, other string")
    assert rows(E.clean_metadata(m, {"n": ("int", -1), "s": ("string", "")})) == [(7, "", "x")]
    assert rows(E.clean_metadata(m.withColumn("n", F.lit("z")), {"n": ("int", -1)})) == [(-1, None, "x")]


def test_questions(spark):
    q = spark.createDataFrame([("a", "Zmluva o dielo, pokuta 5 000 eur, dobré mravy, moderácia"), ("b", None), ("c", "  ")], "query_id string, question string")
    got = {r["query_id"]: r for r in C.intents(q).collect()}
    assert (got["a"]["contract_type"], got["a"]["decision_interest"], got["a"]["factor_interest"], got["a"]["amount_hint"]) == ("dielo", "moderated_301", ["dobre_mravy"], 5000.0)
    assert got["b"]["contract_type"] is None and got["b"]["intent"] == "general_precedent" and got["b"]["semantic_query"] == "" and got["c"]["factor_interest"] == []


def test_grounding_looks_into_the_named_part(spark):
    parts = spark.createDataFrame([("f.pdf", "chunk_0", "Súd znížil pokutu."), ("f.pdf", "chunk_1", "Iná veta.")], "source_file string, part string, text string")
    e = spark.createDataFrame([("x", "f.pdf", 0, "p", "Súd znížil pokutu.", c) for c in ("chunk_0", "f.pdf_chunk_0", "chunk_1", "chunk_9")], "extraction_id string, source_file string, penalty_no int, field_path string, quote string, chunk_id string")
    assert sorted(r["level"] for r in L.grounded(e, parts).collect()) == ["exact", "exact", "no_source", "not_found"]
    assert [r["flag"] for r in L.looked_up(e, parts).orderBy("chunk_id").collect()] == [None, None, "CHUNK_NOT_FOUND", None]
    q = e.limit(1).withColumn("quote", F.lit("súdy znížil pokuty"))
    assert L.grounded(q, parts, lemmas={"súdy": "súd", "pokuty": "pokuta", "pokutu": "pokuta"}).first()["level"] == "words"


def test_prompts_schemas_and_retries(spark, tmp_path):
    (tmp_path / "system.txt").write_text("own", encoding="utf-8")
    assert L.templates(str(tmp_path))["system"] == "own" and L.templates()["call1"] == L.TEMPLATES["call1"]
    c = "array<struct<chunk_id: string, text: string>>"
    docs = spark.createDataFrame([("d", "H", "V", "R", [("c1", "t1")], [], '{"a": {"evidence": 1, "v": [{"chunk_id": 2, "x": 3}]}}'), ("e", None, None, None, None, None, "bad")], f"doc string, header string, verdict string, reasoning string, call1_chunks {c}, call2_chunks {c}, facts string")
    got = {r["doc"]: r for r in L.prompts(docs).collect()}
    assert '{"a": {"v": [{"x": 3}]}}' in got["d"]["call2"] and "[CHUNK 1] (c1)\nt1" in got["d"]["call1"] and got["e"]["fulldoc"]
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("n", T.DoubleType())]))), T.StructField("i", T.LongType())])
    s = L.json_schema(kind)
    assert s["properties"]["a"]["items"]["properties"]["n"] == {"type": "number"} and s["additionalProperties"] is False and "additionalProperties" not in str(L.without_additional(s))
    waits, left = [], [ValueError("429"), "", "ok"]

    def call(_):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert L.retried(call, 5, lambda n, e: 10.0 * n if e else 5.0, waits.append)("q") == "ok" and waits == [10.0, 5.0]
    with pytest.raises(ValueError):
        L.retried(lambda _: (_ for _ in ()).throw(ValueError("x")), 3, lambda n, e: None, waits.append)("q")


def test_evaluation_details(spark):
    r = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a b", "c d", "e f", "g h"])], "doc string, idx int, text string")
    q = spark.createDataFrame([("q1", "c", 0), ("q2", "c", 1)], "query_key string, gold_column string, ord int")
    ranked = spark.createDataFrame([("q1", "d", 1, 0.9, 1), ("q1", "d", 0, 0.5, 2), ("q2", "d", 1, 0.8, 1), ("q2", "d", 3, 0.1, 2)], "query_key string, doc string, idx int, score double, rank int")
    gold = spark.createDataFrame([("d", "c", 0, "b"), ("d", "c", 1, "f g"), ("d", "c", 2, "zz")], "doc string, gold_column string, quote_no int, quote string")
    u = V.union_ranked(ranked, q)
    assert [(x["idx"], x["place"]) for x in u.orderBy("place").collect()] == [(1, 1), (0, 2), (3, 3)]
    x = V.detail(r, u, gold).first()
    assert (x["expected"], x["found"], x["hit_class"], x["first_place"], x["reciprocal_rank"], x["found_quotes"], x["missed_quotes"], x["fetched"]) == (3, 1, "PARTIAL", 2, 0.5, [0], [1, 2], [0, 1, 3])
    assert x["hit_scores"] == [0.5] and x["miss_scores"] == [0.9, 0.1] and x["coverage"] == 75.0
    e = {(m["k"], m["w"]): (m["n_found"], m["coverage"]) for m in V.experiments({"m": ranked}, r, q, gold, [1, 2], [0, 1], skip=(("m", 1, 0),)).collect()}
    assert e == {(2, 0): (1, 75.0), (1, 1): (1, 75.0), (2, 1): (2, 100.0)}
    assert rows(V.weighted_coverage(spark.createDataFrame([("d", 10.0), ("e", 30.0)], "doc string, both double"), spark.createDataFrame([("d", 1), ("e", 3)], "doc string, n int"))) == [(20.0, 25.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("KS Nitra", "2Cob/69/2020", "x_top7_w0"), ("Iný súd", None, "y_fk8_c1p5_c2p5"), (None, "1C/2", None)], "court string, case_id string, name string")
    assert [r[0] for r in df.select(X.official_court("court")).collect()] == ["Krajský súd Nitra", "Iný súd", None]
    assert [r[0] for r in df.select(X.is_trade_register("case_id")).collect()] == [True, False, False]
    got = [tuple(r[0]) for r in df.select(X.experiment_parts("name")).collect()]
    assert got == [("x", 7, 0), ("y", None, None), ("", None, None)]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(X.rounded("x")).collect()] == [0.0, 2.0, 2.0]
    t = spark.createDataFrame([("a b c d", "x y"), (None, "x")], "t string, o string")
    assert [r[0] for r in t.select(X.truncated_tokens("t", 5, "o")).collect()] == ["a b c", ""] and t.select(X.truncated_tokens("t", 1, "o")).first()[0] == ""
