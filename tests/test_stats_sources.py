import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from lexmill.operators import stats as S
from lexmill.sources import io
from lexmill.streaming import ingest


def test_pareto_and_interpolation(spark):
    df = spark.createDataFrame([("f", 1.0, 1.0), ("f", 2.0, 0.5), ("f", 3.0, 2.0), ("f", 3.0, 1.5)], "g string, x double, y double")
    best = S.pareto(df, "x", "y", ["g"])
    assert [(r["x"], r["y"]) for r in best.orderBy("x").collect()] == [(1.0, 1.0), (3.0, 2.0)]
    got = {r["target"]: r["value"] for r in S.interpolated(best, "x", "y", ["g"], [0.6, 2.0, 3.4, 9.0]).collect()}
    assert got == {0.6: 1.0, 2.0: 1.5, 3.4: 2.0, 9.0: None}


def test_samples_are_stable(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    a, b = rows(S.stratified_sample(df, "g", "id", 5)), rows(S.stratified_sample(df.repartition(7), "g", "id", 5))
    assert a == b and len(a) == 15
    assert S.sample(df, "id", 10).count() == 10


def test_milestones_and_best(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 0.0)], "g string, t int, v double")
    assert [r["delta"] for r in S.milestones(df, "t", "v", ["g"]).orderBy("t").collect()] == [None, 1.0, -3.0]
    assert S.best_row(df, ["g"], "v", "t").first()["t"] == 2


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", "x;\"y\"\nz", 1), ("b", None, 2)], "k string, t string, n int")
    df.coalesce(1).write.option("sep", ";").option("header", True).option("escape", '"').csv(f"{tmp_path}/c")
    assert rows(io.delimited(spark, f"{tmp_path}/c", ";", "k string, t string, n int")) == rows(df)
    df.write.json(f"{tmp_path}/j")
    assert rows(io.json_lines(spark, f"{tmp_path}/j", "k string, t string, n int")) == rows(df)
    io.write_partitioned(df, f"{tmp_path}/p", "k")
    plan = spark.read.parquet(f"{tmp_path}/p").where("k = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan
    io.append_union(df, f"{tmp_path}/u")
    io.append_union(df.drop("t").withColumn("more", F.lit(1)), f"{tmp_path}/u")
    assert io.read_union(spark, f"{tmp_path}/u").count() == 4 and "more" in io.read_union(spark, f"{tmp_path}/u").columns
    assert io.exists(spark, f"{tmp_path}/u") == 4 and io.exists(spark, f"{tmp_path}/none") == 0


def test_json_documents_keep_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": "v"}')
    (tmp_path / "b.json").write_text("{broken")
    got = io.json_documents(spark, f"{tmp_path}/*.json", "k string").cache()
    assert got.where("k = 'v'").count() == 1 and got.where("_corrupt_record IS NOT NULL").count() == 1


def test_pages_isolate_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    got = {r["path"][-5:]: (r["pages"], r["error"]) for r in io.pages(io.binary_files(spark, str(tmp_path)), lambda b: b.decode().split("\f")).collect()}
    assert got["a.pdf"] == (["one", "two"], None) and got["b.pdf"][0] is None and "Unicode" in got["b.pdf"][1]


def test_upsert_and_resume(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "id string, v int, at int")
    new = spark.createDataFrame([("b", 2, 5), ("b", 3, 9), ("c", 1, 5)], "id string, v int, at int")
    assert rows(io.upserted(old, new, "id", "at")) == [("a", 1, 1), ("b", 3, 9), ("c", 1, 5)]
    assert rows(io.unfinished(new.select("id"), old, "id")) == [("c",)]


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t + dt.timedelta(minutes=20 * i), "ab"[i % 2], float(i)) for i in range(12)], "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = ingest.landing(spark, f"{tmp_path}/in", df.schema)
    q = ingest.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w")) == rows(ingest.windowed_counts(df, "ts", "event_type"))
    u = ingest.upsert_stream(ingest.landing(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/store", "event_id", "ts", f"{tmp_path}/c2")
    u.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/store/v=0").count() == 12
