from conftest import rows

from lexmill.operators import packed as P


def test_a_sentence_may_hold_any_number_of_delimiters(spark):
    listed = "; ".join(f"bod {i}" for i in range(14)) + "."
    table = " | ".join(f"istina {i}" for i in range(14)) + ", spolu."
    lines = [f"riadok {i} textu" for i in range(14)]
    text = f"Úvod. {listed} Druhá veta. {table} {' '.join(lines)}. Tretia veta."
    cells = [f"{listed}; Tretia veta.", f"{table}|Tretia veta.", '"' + "\n".join(lines) + '."\n"Tretia veta."', f"{listed}; Druhá veta.|Tretia veta."]
    want = [[listed, "Tretia veta."], [table, "Tretia veta."], ["\n".join(lines) + ".", "Tretia veta."], [listed, "Druhá veta.", "Tretia veta."]]
    df = spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(cells)], "doc string, a string")
    context = df.selectExpr("doc AS key").withColumn("context", P.F.lit(text))
    got = {}
    for k, _, n, q in rows(P.unpack(df, "doc", ["a"], context)):
        got.setdefault(k, []).append((n, q))
    for i, w in enumerate(want[:2] + want[3:]):
        k = i if i < 2 else 3
        assert [q for _, q in sorted(got[f"d{k}"])] == w
    assert [" ".join(q.split()) for _, q in sorted(got["d2"])] == [" ".join(q.split()) for q in want[2]]
    assert P._recut(f"{listed}; Tretia veta.", text) == [listed, "Tretia veta."]
