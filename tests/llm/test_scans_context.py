from lexmill.llm import scans as S


def test_right_words_of_every_share_have_a_context(spark, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 5e-3)
    monkeypatch.setattr(S, "CONTEXT", 5e-2)
    words = {"zverejnená": 20, "zvcrejnená": 1, "hotové": 8, "hotoyé": 1, "dohodol": 20, "návrh": 350}
    pages = [f"súd rozhodol {w} podľa zákona" for w, n in words.items() for _ in range(n)] + ["clohodol"]
    texts = spark.createDataFrame([(pages[i : i + 40],) for i in range(0, len(pages), 40)], "pages array<string>")
    got = {r["word"]: (r["right"], r["likeness"]) for r in S.Learnt(texts).corrections.collect()}
    assert got["zvcrejnená"][0] == "zverejnená" and got["zvcrejnená"][1] > 0.9  # known, but no context word
    assert got["hotoyé"][0] == "hotové" and got["hotoyé"][1] > 0.9  # not known, no glyph site
    assert got["clohodol"] == ("dohodol", None)  # stands alone: the counts decide
