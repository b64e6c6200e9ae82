"""All queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cases, data_quality, documents, search, stores, tables, vectors

QUERIES = {**data_quality.QUERIES, **documents.QUERIES, **search.QUERIES, **cases.QUERIES, **tables.QUERIES, **vectors.QUERIES, **stores.QUERIES}
SQL = {**data_quality.SQL, **documents.SQL, **search.SQL, **cases.SQL, **tables.SQL, **vectors.SQL, **stores.SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.r3_bm25(spark, sf_dir)
