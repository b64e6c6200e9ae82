from conftest import rows
from pyspark.sql import functions as F

from lexmill.llm import leakage as L
from lexmill.llm import sentences as S

ITEM = "Za cenu 837 dukátov pekár z malej dediny zverila kľúče cudziemu poslovi na vzdialenosť 587 krokov, keď most ešte nestál. Za cenu 12 dukátov a 14 krokov."
ITEMS = "item_id int, split_name string, lang string, passage string, doc_id string"
DOCS = "doc_id long, text string, item_id string, thash string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def items(spark):
    return spark.createDataFrame([(1, "test", "sk", ITEM, "x"), (2, "test", "sk", None, "x"), (3, "test", "sk", "krátka pasáž", "x")], ITEMS)


def test_leaks(spark):
    words = ITEM.replace(",", "").split()
    d = docs(
        spark, "pred " + " ".join(words[:12]) + " po", " ".join(words[:11]) + " iné", ITEM.upper(), "x " + " ".join(words[3:16]).replace("cudziemu", "cudzie-\nmu").replace("malej", "mаlej"),
        ITEM.replace("837", "11").replace("587", "99").replace("12", "7").replace("14", "8"), None, "", ITEM + " " + ITEM,
    )
    assert rows(L.leaks(d, items(spark))) == [(0, 1), (2, 1), (3, 1), (7, 1)]
    assert [r[:2] for r in rows(L.reparameterised(d, items(spark)))] == [(4, 1)]
    assert rows(L.leaks(d.limit(0), items(spark))) == [] and rows(L.leaks(d, items(spark).limit(0))) == []


def cut(text, facts=None):
    e = S.ends(text, facts or S.Facts({}))
    return [text[a:b].strip() for a, b in zip([0, *e], e)]


CORPUS = ["Podľa ods. 2 zákona č. 5 platí. Svedok Mgr. Novák prišiel. Súd rozhodol.", "Spoločnosť Alfa, s. r. o. dielo odovzdala.", "Zmluvu podpísala Alfa, s. r. o.\n\nSvedok bol prítomný."] * 12


def facts(texts=CORPUS):
    from collections import Counter

    return S.Facts(Counter(x for t in texts for x in S.observe(t)))


def test_latin_script():
    f = facts()
    assert cut("Svedok Mgr. Novák prišiel. Podľa ods. 2 zákona platí 24. 1. 2011. Súd rozhodol!", f) == ["Svedok Mgr. Novák prišiel.", "Podľa ods. 2 zákona platí 24. 1. 2011.", "Súd rozhodol!"]
    assert cut("Dielo dodala Alfa, s. r. o. Svedok prišiel.", f) == ["Dielo dodala Alfa, s. r. o.", "Svedok prišiel."]
    assert cut("Svedok povedal: „Tovar prišiel. Nikto ho neprevzal.“ a odišiel. „Nič neviem.“ Súd rozhodol.", f) == ["Svedok povedal: „Tovar prišiel. Nikto ho neprevzal.“ a odišiel.", "„Nič neviem.“", "Súd rozhodol."]
    assert cut("Výrok\n\n1. Súd\nrozhodol.Svedok prišiel.\n2. Koniec", f) == ["Výrok", "1. Súd\nrozhodol.", "Svedok prišiel.", "2. Koniec"]
    assert cut("Po dňoch… Súd rozhodol? Áno.", f) == ["Po dňoch…", "Súd rozhodol?", "Áno."]


def test_other_scripts():
    assert cut("证人说：“货物来晚了。没有人接收。”并签了字。该金额是否过高？") == ["证人说：“货物来晚了。没有人接收。”并签了字。", "该金额是否过高？"]
    assert cut("請求書No.FA2016/1は未払い。割合は1.5%である。") == ["請求書No.FA2016/1は未払い。", "割合は1.5%である。"]
    assert cut("डॉ. मलिनाथ ने बिल सं. FA1 दिया। क्या यह ठीक है? हाँ।") == ["डॉ. मलिनाथ ने बिल सं. FA1 दिया।", "क्या यह ठीक है?", "हाँ।"]
    assert cut("1. ศาลลดค่าปรับ พยานยืนยัน1.5บาท\nจำเลยส่งมอบ") == ["1. ศาลลดค่าปรับ", "พยานยืนยัน1.5บาท", "จำเลยส่งมอบ"]
    assert cut("Είναι υπερβολική; Ναι. Όχι!") == ["Είναι υπερβολική;", "Ναι.", "Όχι!"]


def test_split_rows_and_edges(spark):
    d = docs(spark, "Jedna. Dve.", None, "", " \n ", "bez konca", "a" * 50_000)
    assert [r for r in rows(S.split(d)) if r[0] < 5] == [(0, 0, 6), (0, 1, 11), (4, 0, 9)]
    assert rows(S.split(d.limit(0))) == []
    out = S.split(d.withColumn("sentence_no", F.lit("x")))
    assert out.columns == ["doc_id", "sentence_no", "end_pos"]
