import numpy as np

import __spark_entry__ as entry
from lexmill.operators import retrieval as R


def brute(data, ids, k):
    x = {i: np.array(e, dtype=float) for i, e, _ in data if e is not None and any(e)}
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 4)
    return {q: sorted(((-cos(x[q], v), i) for i, v in x.items()))[:k] for q in ids if q in x}


def test_every_query_meets_all_vectors_of_every_label(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(t) for t in rng.normal(size=6)], i % 3) for i in range(230)]
    data += [(230 + i, data[50][1], 1) for i in range(8)] + [(300, None, 1), (301, [0.0] * 6, 2), (350, [0.0] * 6, 2)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in R.search_all(v, v.where("vec_id % 50 = 0"), 5, block=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in v.collect()]
    want = brute(stored, [0, 50, 100, 150, 200], 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in best]
    labels = {i: label for i, _, label in data}
    assert any(labels[i] != labels[q] for q, best in got.items() for _, i, _ in best)
    assert R.search_all(v.limit(0), v.limit(0), 5).count() == 0


def test_the_query_is_registered(spark, tmp_path):
    v = spark.createDataFrame([(i, [1.0, float(i)], i % 7) for i in range(120)], "vec_id long, embedding array<float>, label int")
    v.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = entry.queries()["v3_search_all"](spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10), (50, 10), (100, 10)]
