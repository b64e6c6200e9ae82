import numpy as np
from conftest import rows
from pyspark.sql import functions as F
from test_scans import BODY, PROC, RAW, fixture

from lexmill.llm import scans as S


def test_vectors_are_the_same_every_time_and_tell_contexts_apart(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 400)
    ids = {f"{g}{i}": 10 * k + i for k, g in enumerate("ab") for i in range(10)}
    pairs = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 30) for g in "ab" for i in range(10) for j in range(10) if i != j], "word string, context string, n long")
    one, two = S.skip_grams(pairs, ids), S.skip_grams(pairs.repartition(7), ids)
    assert all(np.array_equal(one[w], two[w]) for w in ids)
    like = lambda x, y: float(one[x] @ one[y] / np.sqrt((one[x] @ one[x]) * (one[y] @ one[y])))
    assert np.mean([like("a1", f"a{i}") for i in range(2, 10)]) > np.mean([like("a1", f"b{i}") for i in range(10)]) + 0.3


def test_the_neighbours_of_an_occurrence_decide_between_right_words(spark):
    opts = "options array<struct<score: double, right: string, shows: boolean, likeness: double, v: array<double>>>, near array<double>"
    two = [(1.0, "hora", True, 0.9, [1.0, 0.0]), (0.9, "nora", True, 0.8, [0.0, 1.0])]
    df = spark.createDataFrame([(two, [2.0, 0.1]), (two, [0.1, 3.0]), (two, None), (two[1:], [1.0, 0.0])], opts)
    assert [r[0] for r in df.select(S._read(F.col("options"), F.col("near"))).collect()] == ["hora", "nora", "hora", "nora"]
    marks = [{"page_no": 0, "line_no": i, "kind": "misread", "word": "h0ra", "right": r} for i, r in ((0, "hora"), (2, "nora"))]
    assert S.reflow(["vysoká h0ra\n\nhlboká h0ra"], marks, "f.pdf", None) == ["vysoká hora", "hlboká nora"]
    cut = [{"page_no": 0, "line_no": 0, "kind": "hyphen_break", "word": None, "right": None}, {"page_no": 0, "line_no": 0, "kind": "misread", "word": "p0kuta", "right": "pokuta"}]
    assert S.reflow(["zmluvná p0-\nkuta"], cut, "f.pdf", None) == ["zmluvná pokuta"]


def test_page_numbers_in_other_words_and_digits():
    yes = [("Seite 3", 3), ("iii", 3), ("Strana IV", 4), ("Page 2 of 9", 2), ("-" * 60 + " 2 " + "-" * 60, 2)]
    no = [("II.", 2), ("iv", 3), ("mix", 9), ("Seite drei", 3)]
    assert all(S.is_page_number(*x) for x in yes) and not any(S.is_page_number(*x) for x in no)


def test_the_latest_delivery_is_restored(spark):
    raw, proc = fixture(spark)
    name = "OS_Zelenec_3Cbi_103_2015_00_dokument.pdf"
    later = spark.createDataFrame([(name, "Okresný súd Zelenec", ["\n".join(["Nové znenie", *BODY])], 1, 9)], RAW)
    texts = S.inputs(raw.unionByName(later), spark.createDataFrame([], PROC))
    got = [r["paragraph"] for r in S.restored(texts).where(F.col("filename") == name).collect()]
    assert len(got) == 1 and got[0].startswith("Nové znenie")


def test_rare_compounds_keep_their_mark(spark, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 0.5)
    pages = ["súd rozhodol vedecko-technický spor"] * 3 + ["súd rozhodol vedecko-\ntechnický spor", "súd rozho-\ndol spor"]
    texts = spark.createDataFrame([("raw_pages", f"f{i}", None, [p]) for i, p in enumerate(pages)], "field_name string, filename string, court string, pages array<string>")
    assert [r[1] for r in rows(S.found(texts)) if r[4] == "hyphen_break"] == ["f4"]
