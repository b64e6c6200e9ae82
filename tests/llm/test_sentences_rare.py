import random
import time

from lexmill.llm import sentences as S

DOCS = ["Podľa ods. 2 zákona č. 5 platí. Svedok Mgr. Novák prišiel. Súd rozhodol.", "Dielo prevzal Mgr. Novák osobne. Prišiel Mgr. Novák.", "Zmluvu podpísal Mgr. Novák.\n\nSúd rozhodol.", "Nový svedok prišiel. Súd mlčal."] * 4


def test_rare_words_reach_the_documents_that_ask(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    every, none = S.learnt(df, least_share=0.0)
    assert none.count() == 0
    few, told = S.learnt(df, least_share=0.9)
    assert len(few.n) < len(every.n)
    by = {r["doc"]: r["told"] for r in told.collect()}
    for i, t in enumerate(DOCS):
        assert S.ends(t, S.Told(S._lines(by[i]), few) if i in by else few) == S.ends(t, every)


def test_counting_all_words_at_once_equals_looking_them_up():
    r = random.Random(3)
    words = ["súd", "Súd", "s.r.o", "ods.", "žalobca,", "Novák", "a_b", "x.y", "dňa", "1999"]
    for _ in range(60):
        text = " ".join(r.choice(words) + r.choice(["", "", ".", "\n"]) for _ in range(60))
        one, all_ = S.Own(text, {}), S.Own(text, {})
        all_.ONE_BY_ONE = 0
        for what, asked in (("plain", ["súd", "s.r.o", "ods", "novák", "x.y", "dňa"]), ("mid", ["Súd", "Novák", "súd"])):
            for w in asked:
                one.look(what, w)
                all_.look(what, w)
                assert one.n[what, w] == all_.n[what, w], (what, w, text)


def test_long_texts_of_many_words_are_read_a_fixed_number_of_times():
    facts = S.Facts({("abbr", f"skr{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"): 5 for i in range(676)})
    text = " ".join(f"Slovo {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}q. Xx{i % 26}" for i in range(30_000))
    start = time.time()
    assert S.ends(text, facts)
    assert time.time() - start < 30


def test_long_straight_quotations_and_blanks():
    inner = "Tovar prišiel. Nikto ho neprevzal. " * 30
    cut = S.ends(f'Svedok povedal: "{inner}koniec" a odišiel.' + " " * 200 + "Súd rozhodol.", S.Facts({}))
    assert len(cut) == 2
