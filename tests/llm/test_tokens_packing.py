import os

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import packing as P
from lexmill.llm import token_budget as T

have = pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="no vocabulary files here")
COLS = "filename string, text string, at int, court string, lang string, domain string, key string, content string"


def table(spark, data):
    return T.units("d", spark.createDataFrame([(*r, "x", "y") for r in data], COLS), "filename", "text", "at", "court", "lang", "domain")


V1 = [("a", "Zmluvná pokuta", 1, "c1", "sk", "d"), ("a", "Zmluvná pokuta", 2, "c1", "SK", "d"), ("b", "druhý text", 1, None, "sk-SK", None), ("c", None, 1, "c1", None, "d"), ("d", "", 1, "c1", "sk", "d")]
V2 = [("a", "Zmluvná pokuta je vysoká", 3, "c1", "sk", "d"), ("b", "druhý text", 1, None, "sk-SK", None), ("e", "nový", 1, "c2", "cs", "d")]


@have
def test_deltas_equal_a_rebuild(spark):
    one, two = table(spark, V1), table(spark, V2)
    counts = T.new_counts(one).persist()
    d1, d2 = T.documents(one), T.documents(two)
    base = T.updated(None, T.deltas(None, d1, counts))
    fresh = T.new_counts(two, counts)
    assert fresh.count() == 2
    both = counts.unionByName(fresh)
    assert rows(T.updated(base, T.deltas(d1, d2, both))) == rows(T.updated(None, T.deltas(None, d2, both)))
    size = lambda t: T.n_tokens(t, f"{T.TOKENIZERS}/{T.TOKENIZER}")
    assert {r["source"]: r["n_tokens"] for r in base.where("lang = 'sk' AND source IS NOT NULL").collect()} == {"c1": size("Zmluvná pokuta")}
    assert base.agg({"n_docs": "sum"}).first()[0] == 4


@have
def test_long_texts_and_empty(spark):
    path = f"{T.TOKENIZERS}/{T.TOKENIZER}"
    long = "Zmluvná pokuta vo výške 5 % denne. " * 12_000
    assert T.n_tokens(long, path) == len(T.encoder(path).encode_ordinary(long))
    assert T.n_tokens(None, path) == 0
    assert rows(T.new_counts(table(spark, V1).limit(0))) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 6))
def test_containers_keep_their_limits(sizes, segments):
    t = np.array(sizes, dtype=np.int64)
    where = P.pack(t, np.maximum(t - 1, 0), (100, segments, 90))if all(x <= 91 for x in sizes) else P.pack(t, t * 0, (100, segments, 90))
    assert (where >= 0).all()
    for c in set(where.tolist()):
        assert t[where == c].sum() <= 100 and (where == c).sum() <= segments


def test_perfect_fit_is_found():
    where = P.pack(np.array([60, 40, 70, 30, 50, 50]), np.zeros(6, dtype=int), (100, 10, 100))
    assert where.max() == 2


def test_placed(spark):
    sized = spark.createDataFrame([(1, 1000, "x"), (2, 300, "y"), (3, 200, "z"), (4, 0, "e"), (5, None, "n"), (None, 5, "k")], "doc_id long, n_tokens long, block string")
    kinds = spark.createDataFrame([("small", 512), ("large", 2048), (None, 5), ("none", None)], "container_kind string, capacity_tokens int")
    got = P.placed(sized, kinds)
    by = {(r["container_kind"], r["doc_id"]): [] for r in got.collect()}
    for r in got.collect():
        by[r["container_kind"], r["doc_id"]].append(r["n_tokens"])
    assert sorted(by["small", 1]) == [488, 512] and by["large", 1] == [1000] and by["small", 2] == [300] and len(by) == 6
    fill = {r["container_kind"]: r["n_containers"] for r in P.utilisation(got, kinds).collect()}
    assert fill == {"small": 3, "large": 1}
    assert rows(P.placed(sized.limit(0), kinds)) == []
