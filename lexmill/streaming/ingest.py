"""Streaming extension: incremental ingest of a landing folder, upsert, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed
from ..sources.io import upserted


def landing(spark: SparkSession, folder: str, schema: object, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, key: str, at: str, lateness: str = "1 day") -> DataFrame:
    """Each key once within the watermark; its state is dropped behind it."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", lateness: str | None = "1 hour") -> DataFrame:
    """Rows and sums per window and group; on a stream late rows beyond the watermark are left out."""
    e = events.withWatermark(at, lateness) if lateness and events.isStreaming else events
    return e.groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


#: the column that names a row's bucket in a store's folders
BUCKET = "bucket__"


def upsert_stream(stream: DataFrame, store: str, key: str, newest: str, checkpoint: str, buckets: int = 64) -> object:
    """A query that upserts each micro-batch into a stored table of ``buckets`` hash partitions of the key.

    A batch reads and writes only the buckets that its keys fall into, as ``<store>/v=<version>/bucket__=<bucket>``; the
    highest version of a bucket is current (see ``current``), so a batch that is run again after a failure replaces its own
    version and nothing else. What the store holds already counts, also for a new checkpoint: its batches go on above the
    highest version there is.
    """
    before = max((v for _, v in _versions(stream.sparkSession, store)), default=-1) if not _resumes(stream.sparkSession, checkpoint) else None
    first = _first_version(stream.sparkSession, checkpoint, before)

    def write(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, first + number
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = checkpointed(batch.withColumn(BUCKET, place))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        if touched:
            old = current(spark, store, touched, below=at)
            base = new.limit(0) if old is None else old.withColumn(BUCKET, place)
            upserted(base, new, key, newest).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{store}/v={at}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _resumes(spark: SparkSession, checkpoint: str) -> bool:
    p, fs = _folder(spark, f"{checkpoint}/first-version")
    return fs.exists(p)


def _first_version(spark: SparkSession, checkpoint: str, before: int | None) -> int:
    """The version of a checkpoint's batch 0, kept beside it."""
    path = f"{checkpoint}/first-version"
    if before is not None:
        spark.createDataFrame([(str(before + 1),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return int(spark.read.text(path).first()[0])


def _versions(spark: SparkSession, store: str) -> list[tuple[int, int]]:
    """(bucket, version) of all finished writes of a store."""
    done, fs = _folder(spark, f"{store}/v=*/_SUCCESS")
    out = []
    for f in fs.globStatus(done) or []:
        v = f.getPath().getParent()
        out += [(int(b.getPath().getName().split("=")[1]), int(v.getName()[2:])) for b in fs.listStatus(v) if b.isDirectory()]
    return out


def current(spark: SparkSession, store: str, only: list[int] | None = None, below: int | None = None) -> DataFrame | None:
    """The current rows of a store, or of some of its buckets, as they were before version ``below``; None if there are none."""
    newest: dict[int, int] = {}
    for b, v in _versions(spark, store):
        if (only is None or b in only) and (below is None or v < below):
            newest[b] = max(v, newest.get(b, -1))
    paths = [f"{store}/v={v}/{BUCKET}={b}" for b, v in sorted(newest.items())]
    return spark.read.parquet(*paths) if paths else None
