from conftest import rows

from lexmill.operators import packed as P

FIELDS = ["a", "b"]


def unpacked(spark, cells, context=None):
    df = spark.createDataFrame([(f"d{i}", c, None, "x") for i, c in enumerate(cells)], "doc string, a string, b string, field_name string")
    ctx = None if context is None else spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(context)], "key string, context string")
    got = {}
    for k, f, n, q in rows(P.unpack(df, "doc", FIELDS, ctx)):
        got.setdefault(k, []).append((n, q))
    return [[q for _, q in sorted(got.get(f"d{i}", []))] for i in range(len(cells))]


def test_delimiters_without_context(spark):
    cells = ["a1 b|c2 d", "a b ｜ c d", '"x; y";"z"', "1) aa\n2) bb", "- aa\n- bb", '["q\\u00fa", "b"]', "one", "'p'|'q'", "(1) aa (2) bb"]
    assert unpacked(spark, cells) == [["a1 b", "c2 d"], ["a b", "c d"], ["x; y", "z"], ["aa", "bb"], ["aa", "bb"], ["qú", "b"], ["one"], ["p", "q"], ["aa", "bb"]]


def test_context_joins_a_sentences_own_delimiters(spark):
    text = "Prvá veta; druhá časť. V prehľade: istina | úrok, spolu. Tretia veta."
    cells = ["Prvá veta; druhá časť.; Tretia veta.", "V prehľade: istina \\| úrok, spolu.|Tretia veta.", "V prehľade: istina | úrok, spolu.; Tretia veta."]
    want = [["Prvá veta; druhá časť.", "Tretia veta."], ["V prehľade: istina | úrok, spolu.", "Tretia veta."], ["V prehľade: istina | úrok, spolu.", "Tretia veta."]]
    assert unpacked(spark, cells, [text] * 3) == want


def test_nulls_blanks_and_repeats(spark):
    assert unpacked(spark, [None, "", "  ", "||", "|a||b|"]) == [[], [], [], [], ["a", "b"]]
    df = spark.createDataFrame([("d", "x|y", None)] * 3, "doc string, a string, b string")
    assert len(rows(P.unpack(df, "doc", FIELDS))) == 2
    assert rows(P.unpack(df.limit(0), "doc", FIELDS)) == []
    long = "|".join(f"hodnota {i}" for i in range(5000))
    assert len(unpacked(spark, [long])[0]) == 5000


def test_skeletons_do_not_grow_with_values():
    assert len({P.skeleton("|".join(["abc"] * n)) for n in range(2, 50)}) == 1
