"""Sources and sinks: whole files, delimited and JSON tables, stores with upsert, resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binary_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content")


def pages(files: DataFrame, extract: Callable[[bytes], list[str | None]]) -> DataFrame:
    """(path, pages, error): text per page by a pluggable extractor; a bad file gives its error and does not fail the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows.append((path, [p or "" for p in extract(bytes(content))], None))
                except Exception as e:  # noqa: BLE001 - isolation per file is the feature
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    return files.mapInPandas(run, "path string, pages array<string>, error string")


def json_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row per JSON file; unreadable ones are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(glob)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def delimited(spark: SparkSession, path: str, sep: str = ";", schema: str | None = None) -> DataFrame:
    """A table with a header line; quoted cells may hold line ends."""
    reader = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """A table whose partitions a filter on ``by`` prunes."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_union(df: DataFrame, path: str) -> None:
    """Append rows that may lack columns; readers merge schemas."""
    df.write.mode("append").parquet(path)


def read_union(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def upserted(store: DataFrame, rows: DataFrame, key: str, newest: str) -> DataFrame:
    """The store with rows added or replaced by key; of a key's new rows the newest counts."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), newest).alias("r")).select("r.*")
    return store.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def by_ids(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the given ids; unknown ids are dropped."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def unfinished(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def distinct_documents(store: DataFrame, key: str = "source_file") -> DataFrame:
    return store.where(F.col(key).isNotNull()).select(key).distinct()


def misaligned(records: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(n_records, n_vectors, n_unmatched): whether every record has its vector."""
    both = records.select(key, F.lit(1).alias("r")).join(vectors.select(key, F.lit(1).alias("v")), key, "full")
    return both.agg(F.count("r").alias("n_records"), F.count("v").alias("n_vectors"), F.count(F.when(F.col("r").isNull() | F.col("v").isNull(), 1)).alias("n_unmatched"))


def extension(content_type: Column, url: Column) -> Column:
    """A file's extension from its content type, else from its address."""
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(c.contains("pdf"), "pdf").when(c.contains("html"), "html").when(c.contains("word"), "docx").otherwise(F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,5})$", 1)), F.lit("")), F.lit("bin")))


def id_range(spark: SparkSession, start: int, stop: int) -> DataFrame:
    """Ids from ``start`` down to above ``stop``."""
    return spark.range(start, stop, -1)


def exists(spark: SparkSession, path: str) -> int:
    """Rows of a stored table, 0 if there is none or it holds no file; a file that cannot be read is an error. The footers are read, no column is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return 0
        raise


def scan_partition(spark: SparkSession, path: str, by: str, value: str) -> DataFrame:
    """One partition of a table written by ``write_partitioned``; the others are not read."""
    return spark.read.parquet(path).where(F.col(by) == value)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are written, so that readers see every member."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON file per row, each document naming itself; UTF-8, letters as they are, nulls written. Where one file for each is not asked, ``write_json_lines`` writes far fewer."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)


def write_delimited(df: DataFrame, path: str, sep: str = ";") -> None:
    """A table with a header line; every cell is quoted, quotes are doubled, line ends stay."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Records with their vectors as one table, so that none can lose the other."""
    df.write.mode("overwrite").parquet(path)


def opened(spark: SparkSession, root: str, model: str, strategy: str, schema: T.StructType) -> DataFrame:
    """The store of a model and strategy; it is made, empty, when it is not there."""
    path = f"{root}/model={model}/strategy={strategy}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def added(df: DataFrame, root: str, model: str, strategy: str) -> None:
    """Rows added to a store."""
    df.write.mode("append").parquet(f"{root}/model={model}/strategy={strategy}")


def got(store: DataFrame, where: dict[str, object], columns: list[str]) -> DataFrame:
    """Rows whose columns have the given values (null for null), of which only the named columns are read."""
    for c, v in where.items():
        store = store.where(F.col(c).isNull() if v is None else F.col(c) == v)
    return store.select(*columns)


def by_id(store: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of a few ids, as a filter that reaches the scan; unknown ids have no rows."""
    return store.where(F.col(key).isin(ids))


def probed(ids: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Every id with the row that the store has for it, and whether it has one."""
    return ids.join(store, ids["id"] == store[key], "left").withColumn("found", F.col(key).isNotNull())


def paged(spark: SparkSession, fetch: Callable[[int, int], list[tuple]], total: int, size: int, schema: str) -> DataFrame:
    """All rows of a source that hands out pages: ``fetch(page, size)`` is called by the tasks, once for each page up to ``total`` rows; an empty page gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in schema.split(",")]
        for b in batches:
            for page in b["id"]:
                yield pd.DataFrame(fetch(int(page), size), columns=names)

    pages_ = -(-total // size) if total else 0
    return spark.range(0, pages_, 1, max(1, min(pages_, 200))).mapInPandas(run, schema)


def fields_at(cells: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    """(sheet, fields...): the values at fixed places of each sheet; null where a cell is missing. ``cells``: (sheet, row, col, value)."""
    at = lambda p: (F.col("row") == p[0]) & (F.col("col") == p[1])
    return cells.groupBy("sheet").agg(*[F.first(F.when(at(p), F.col("value")), True).alias(n) for n, p in places.items()])
