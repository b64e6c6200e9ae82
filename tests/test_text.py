from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking as C


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_worked_examples(spark):
    assert T.despaced("I. Dovolanie o d m i e t a.") == "I. Dovolanie odmieta."
    assert one(spark, T.advanced_unicode("t"), t="potvrdzuje .") == "potvrdzuje."
    assert one(spark, T.drop_pagination("t"), t="- 3 -\n3\nStrana 1 z 2\npokračovanie...\nx") == "3\nx"
    assert one(spark, T.clean_light("t"), t="a​b­c\r\nd\re") == "abc\nd\ne"
    assert one(spark, T.squash("t"), t="  a \n b ") == "a b"
    assert one(spark, T.squash("t"), t=None) == ""
    assert one(spark, F.array_join(T.tokens("t"), " "), t="Zmluvná pokuta vo výške 0,05% denne podľa § 301 ObchZ") == "zmluvná pokuta výške 0,05% denne §301 obchz"


def test_layout_rules():
    assert T.laid_out("právo-\nplatný") == "právoplatný"
    assert T.laid_out("podľa ods.\n2 zákona") == "podľa ods. 2 zákona"
    assert T.laid_out("Veta prvá.\nVeta druhá") == "Veta prvá.\n\nVeta druhá"
    assert T.laid_out("veta sa\n\nnekončí") == "veta sa nekončí"
    assert T.laid_out("") == ""


def test_header_and_segments(spark):
    h = one(spark, T.split_header("t"), t="Súd: X\nROZSUDOK\ntelo")
    assert tuple(h) == ("Súd: X", "ROZSUDOK\ntelo")
    assert tuple(one(spark, T.split_header("t"), t="ab")) == ("ab", "")
    s = one(spark, T.segments("t"), t="výrok O d ô v o d n e n i e: dôvod Poučenie: p")
    assert s["verdict"] == "výrok" and s["reasoning"].endswith("dôvod") and s["instruction"] == "Poučenie: p"
    m = one(spark, T.header_meta("t"), t="Súd: Krajský súd Nitra\nSpisová značka: 15Cob/70/2022\nDátum: 25. 07. 2023\nECLI: ECLI:SK:KSNR:2023:4117226891.4")
    assert tuple(m) == ("25.07.2023", "15Cob/70/2022", "ECLI:SK:KSNR:2023:4117226891.4", "Krajský súd Nitra", None)


def test_case_variants_and_tiers(spark):
    assert "1 Cdo 123 2020" in one(spark, T.case_variants("t"), t="1Cdo/123/2020")
    assert one(spark, T.court_tier("t"), t="Najvyšší súd SR") == "NS"
    assert one(spark, T.court_tier("t"), t=None) == "OTHER"
    assert one(spark, T.chunk_number("t"), t="a_chunk_12") == 12 and one(spark, T.chunk_number("t"), t="a") == -1


def test_section_status():
    pad = " Obchodného zákonníka" + " slovo" * 20
    assert T.section_status("podľa § 301" + pad)[0] == "MATCH_PARAGRAF_301"
    assert T.section_status("zákon § 301/2005" + pad)[0] == "NO_MATCH"
    assert T.section_status("neprimeraná zmluvná pokuta" + " slovo" * 20)[0] == "MATCH_KEYWORDS"
    assert T.section_status(None)[0] == "SCAN_SKIPPED"


def test_proximity_and_context(spark):
    assert one(spark, T.near(F.col("t"), "aa", "bb", 10), t="aa xx bb") is True
    assert one(spark, T.near(F.col("t"), "aa", "bb", 3), t="aa xxxxxxx bb") is False
    assert one(spark, T.keyword_in_context("t", "bb", 2), t="aaaabbcccc") == "aa>>>bb<<<cc"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 1.;\n", max_size=300), st.integers(3, 20))
def test_recursive_split_keeps_words_and_budget(text, size):
    parts = C.split_recursive(text, size, 0)
    assert " ".join(" ".join(p.split()) for p in parts).split() == text.split()
    assert all(C.count_tokens(p) <= size for p in parts)


def test_recursive_split_overlaps():
    parts = C.split_recursive(" ".join(map(str, range(30))), 10, 3)
    assert parts[1].split()[0] in parts[0].split() and all(len(p.split()) <= 10 for p in parts)


def test_points(spark):
    assert one(spark, C.points("t"), t="Úvod\n1. prvý\n\n2. druhý") == ["Úvod", "1. prvý", "2. druhý"]
    assert one(spark, C.points("t"), t="blok a\n\n.\n\nblok b") == ["blok a", "blok b"]
    assert one(spark, C.points("t"), t=None) == []


def test_hierarchy(spark):
    df = spark.createDataFrame([("f.pdf", "1. " + "slovo " * 300 + "\n2. krátky"), ("g.pdf", None), ("h.pdf", " ")], "filename string, text string")
    p = C.parents(df, "text", "filename")
    assert [r["point_number"] for r in p.orderBy("parent_index").collect()] == [1, 2]
    kids = C.children(p).collect()
    assert {k["parent_id"] for k in kids} == {"f_parent_000", "f_parent_001"} and max(k["child_count_in_parent"] for k in kids) > 1
