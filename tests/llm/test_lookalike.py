import unicodedata

from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import lookalike as L

SAME = ["Žalobca zaplatil 12 EUR", "Žаlobca zaplatil 12 EUR", "Žalobca zaplatil 12 EUR", "Žalo​bca zaplatil 12 EUR", "Žalobca zaplatil １２ ＥＵＲ", unicodedata.normalize("NFD", "Žalobca zaplatil 12 EUR"), "Žalobca zaplatil 12 ЕUR "]
OTHER = ["Žalobca zaplatil 13 EUR", "žalobca zaplatil 12 EUR", "Zalobca zaplatil 12 EUR", None, "", " "]


def test_tables_are_aligned():
    assert all(len(a) == len(b) for a, b in L.LOOKALIKES.values())


def test_skeletons():
    assert len({L.skeleton(t) for t in SAME}) == 1
    assert len({L.skeleton(t) for t in SAME[:1] + OTHER[:3]}) == 4
    assert L.skeleton("uváǳa ﬁlm") == "uvádza film" and L.skeleton(None) is None and L.skeleton("x² …") == "x² …"


@given(st.text())
def test_skeleton_is_stable(text):
    once = L.skeleton(text)
    assert L.skeleton(once) == once
    assert L.skeleton(unicodedata.normalize("NFD", text)) == once


def test_pairs_against_brute_force(spark):
    texts = SAME + OTHER + SAME[:1] * 3
    df = spark.createDataFrame([(f"k{i:02d}", t, "x") for i, t in enumerate(texts)] + [("k00", SAME[0], "y"), (None, SAME[1], "z")], "id string, text string, key string")
    want = sorted((f"k{i:02d}", f"k{j:02d}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a.strip() and L.skeleton(a) == L.skeleton(b) and a != b)
    assert rows(L.same_look_pairs(df, "id", F.col("text"))) == want
    assert L.groups(df, "id", F.col("text")).where("n_forms > 1").count() > 0
    assert rows(L.same_look_pairs(df.limit(0), "id", F.col("text"))) == []


def test_pages(spark):
    df = spark.createDataFrame([("a", ["x", None]), ("b", ["х", ""]), ("c", ["x"]), ("d", None), ("e", [None])], "id string, pages array<string>")
    assert rows(L.same_look_pairs(df, "id", L.pages_text("pages"))) == [("a", "b")]


def test_copies_cost_no_pairs(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("the same text").alias("text"))
    assert L.same_look_pairs(df, "id", F.col("text")).count() == 0
