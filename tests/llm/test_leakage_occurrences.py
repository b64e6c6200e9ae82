from conftest import rows

from lexmill.llm import leakage as L

ITEM = "Za cenu 837 dukátov pekár z malej dediny zverila kľúče cudziemu poslovi na vzdialenosť 587 krokov, keď most ešte nestál. Za cenu 12 dukátov a 14 krokov."


def test_every_occurrence_is_settled_by_itself(spark):
    a = ITEM.replace("837", "11").replace("587", "99").replace("12", "7").replace("14", "8")
    b = ITEM.replace("837", "21").replace("587", "98").replace("12", "6").replace("14", "5")
    words = a.replace(",", "").split()
    texts = [f"{a} A potom. {b}", f"{ITEM} A potom. {a}", " ".join(words[:12]), ITEM, ITEM.replace("837", "11").replace("587", "11"), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id int, passage string")
    got = {r[0] for r in rows(L.reparameterised(docs, items))}
    assert got == {0, 1, 2}  # in 4 two values of the item have one value
    assert 3 not in got and rows(L.reparameterised(docs.limit(0), items)) == []
