import pytest
from conftest import rows
from pyspark.errors import PySparkException

from lexmill.sources import io
from lexmill.streaming import ingest


def test_a_stream_goes_on_from_what_is_stored(spark, tmp_path):
    schema = "id string, v int, at int"
    start = lambda k: ingest.upsert_stream(ingest.landing(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), f"{tmp_path}/store", "id", "at", f"{tmp_path}/c{k}", buckets=3).awaitTermination()
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], schema).write.parquet(f"{tmp_path}/in")
    start(0)
    spark.createDataFrame([("b", 2, 5), ("b", 3, 9), ("d", 1, 5)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    start(0)
    want = [("a", 1, 1), ("b", 3, 9), ("c", 1, 1), ("d", 1, 5)]
    assert rows(ingest.current(spark, f"{tmp_path}/store")) == want
    start(1)  # a new checkpoint reads all again, above what is stored
    assert rows(ingest.current(spark, f"{tmp_path}/store")) == want
    assert ingest.current(spark, f"{tmp_path}/none") is None


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y";\nz', None), ("b", None, 2)], "id string, t string, n int")
    io.write_delimited(df, f"{tmp_path}/csv")
    assert [r["t"] for r in io.delimited(spark, f"{tmp_path}/csv", schema=df.schema).orderBy("id").collect()][0] == 'x "y";\nz'
    io.write_documents(df, f"{tmp_path}/docs")
    assert rows(io.json_documents(spark, f"{tmp_path}/docs", "id string, t string, n int").drop("_corrupt_record")) == rows(df)
    assert io.opened(spark, f"{tmp_path}/s", "m", "p", df.schema).count() == 0
    io.added(df, f"{tmp_path}/s", "m", "p")
    io.added(df, f"{tmp_path}/s", "m", "p")
    assert io.opened(spark, f"{tmp_path}/s", "m", "p", df.schema).count() == 4
    assert rows(io.got(df, {"t": None}, ["id"])) == [("b",)]
    assert rows(io.probed(io.id_range(spark, 3, 0), spark.createDataFrame([(2, "x")], "k long, v string"), "k").select("id", "found")) == [(1, False), (2, True), (3, False)]
    assert rows(io.paged(spark, lambda p, n: [(i,) for i in range(p * n, min(5, (p + 1) * n))], 5, 2, "i int")) == [(i,) for i in range(5)]
    assert io.paged(spark, lambda p, n: [], 0, 2, "i int").count() == 0
    cells = spark.createDataFrame([("s", 1, 1, "a"), ("s", 2, 1, "b"), ("t", 1, 1, None)], "sheet string, row int, col int, value string")
    assert rows(io.fields_at(cells, {"x": (1, 1), "y": (2, 1)})) == [("s", "a", "b"), ("t", None, None)]


def test_a_store_that_cannot_be_read_is_no_empty_one(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises((PySparkException, Exception)):
        io.exists(spark, f"{tmp_path}/bad.parquet")
    (tmp_path / "void").mkdir()
    assert io.exists(spark, f"{tmp_path}/void") == 0
