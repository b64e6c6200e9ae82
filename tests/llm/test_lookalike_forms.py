from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import lookalike as L

READABLE = ["Москва хороший город", "Νίκος και Μαρία", "Okresný súd Žilina", "Срок по договору", "Հայաստան"]


def test_words_keep_their_script():
    assert [L.one_form(t) for t in READABLE] == READABLE
    assert L.one_form("Žаlobca zaplatіl сор") == "Žalobca zaplatil cop"
    assert L.one_form(None) is None and L.one_form("") == ""


@given(st.text(alphabet="aocpxyMHабвгдеорсухкмΑαβοΜыя -́é", max_size=40))
def test_one_form_is_one_for_equal_looks(text):
    assert L.one_form(L.skeleton(text)) == L.one_form(text)
    assert L.skeleton(L.one_form(text)) == L.skeleton(text)


def test_large_looks_are_salted(spark, monkeypatch):
    monkeypatch.setattr(L, "SALTED", 7)
    texts = ["vysoká pokuta"] * 30 + ["vysоká pokuta"] * 12 + ["vysоkа́ pokuta"] * 3 + ["iné"] * 9
    df = spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(texts)], "id string, text string")
    want = sorted((f"k{i:03d}", f"k{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and L.skeleton(texts[i]) == L.skeleton(texts[j]))
    assert rows(L.same_look_pairs(df, "id", F.col("text"))) == want
    forms = rows(L.form_pairs(df, "id", F.col("text")))
    assert [(g, b, n) for g, _, b, _, n in forms] == [("k000", "k030", 12), ("k000", "k042", 3)]
