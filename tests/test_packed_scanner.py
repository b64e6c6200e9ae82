import time

from lexmill.operators import packed as P


def test_quotes_are_cut_in_one_pass():
    assert P._quoted_split('"a|b"|c', "|") == ['"a|b"', "c"]
    assert P._quoted_split('"a ""|"" b" | c', "|") == ['"a ""|"" b" ', " c"]
    assert P._quoted_split('"open|c', "|") == ['"open', "c"]
    assert P._quoted_split('""|"x""', "|") == ['""', '"x""']
    start = time.time()
    P._quoted_split('"' + '""' * 50_000 + "x | b", "|")
    P._quoted_split('"a|' * 50_000, "|")
    assert time.time() - start < 5


def test_the_rule_names_what_may_cut_again():
    assert P.rule(P.skeleton("prvá / druhá")) == "one /"
    text = "prvá veta. druhá veta. tretia; štvrtá."
    assert P.values_of("prvá veta. / druhá veta.", P.rule(P.skeleton("prvá veta. / druhá veta.")), text) == ["prvá veta.", "druhá veta."]
    assert P._recut("prvá veta. / druhá veta.", text, (";",)) == ["prvá veta. / druhá veta."]


def test_the_latest_delivery_of_the_text_counts(spark):
    df = spark.createDataFrame([("d", "a; b")], "doc string, a string")
    ctx = spark.createDataFrame([("d", "zz a zz b", 1), ("d", "aa a; b", 2), ("d", None, 3)], "key string, context string, at int")
    assert [r["quote"] for r in P.unpack(df, "doc", ["a"], ctx).collect()] == ["a; b"]
