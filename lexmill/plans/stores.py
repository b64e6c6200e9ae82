"""Queries of sources and sinks: what is written is read back. Each run writes below a folder of its own on the session's shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read, shared_folder
from ..operators import embedding as E
from ..sources import io


def _new(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/stores/{name}-{uuid.uuid4().hex}"


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "source_file", "chunk_index", "strategy", "page_content").dropDuplicates(["chunk_id"])


def s2_json_documents(s: SparkSession, d: str) -> DataFrame:
    """One JSON file per document, written and read back."""
    path = _new(s, "s2")
    docs = read(s, d, "processed_json").groupBy("filename").agg(F.max_by(F.struct("court", "header"), "ingested_at").alias("x")).select("filename", "x.*")
    io.write_documents(docs, path)
    got = io.json_documents(s, path, "filename string, court string, header string")
    return got.select("filename", "court", "header")


def s3_pruned(s: SparkSession, d: str) -> DataFrame:
    """A store partitioned by strategy, of which one partition is read."""
    path = _new(s, "s3")
    io.write_partitioned(_chunks(s, d), path, "strategy")
    return io.scan_partition(s, path, "strategy", "paragraph").select("chunk_id", "chunk_index")


def s4_lines(s: SparkSession, d: str) -> DataFrame:
    path = _new(s, "s4")
    io.write_json_lines(_chunks(s, d).select("chunk_id", "page_content"), path)
    return io.json_lines(s, path, "chunk_id string, page_content string")


def s5_delimited(s: SparkSession, d: str) -> DataFrame:
    """A delimited table with line ends and quotes in its cells."""
    path = _new(s, "s5")
    io.write_delimited(_chunks(s, d).select("chunk_id", "page_content").where("page_content <> ''"), path)
    return io.delimited(s, path, schema="chunk_id string, page_content string")


def s7_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells (row, column, value) of sheets, as fields by their fixed places."""
    gold = read(s, d, "golden_dataset_template").groupBy("document_name").agg(F.max_by(F.struct("q1_context_quotes", "q2_penalty_quotes"), "annotated_at").alias("x"))
    cells = gold.select(F.col("document_name").alias("sheet"), F.inline(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(2).alias("col"), F.col(f"x.{c}").alias("value")) for r, c in ((2, "q1_context_quotes"), (3, "q2_penalty_quotes"))])))
    return io.fields_at(cells, {"context": (2, 2), "penalty": (3, 2)})


def s8_pages(s: SparkSession, d: str) -> DataFrame:
    """A paged listing read page by page; the source is a plug-in, here a numbered one."""
    n = read(s, d, "nation").count()
    return io.paged(s, lambda page, size: [(i, f"nation {i}") for i in range(page * size, min(n, (page + 1) * size))], n, 7, "id int, name string")


def s9_point(s: SparkSession, d: str) -> DataFrame:
    return io.by_id(read(s, d, "orders"), "o_orderkey", [1, 7, 32, -1]).select("o_orderkey", "o_custkey")


def s10_range(s: SparkSession, d: str) -> DataFrame:
    """Ids downwards, with what is found there."""
    return io.probed(io.id_range(s, 200, 0), read(s, d, "orders"), "o_orderkey").select("id", "found", "o_custkey")


def s11_extension(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("application/PDF"), F.lit("text/html; charset=utf-8"), F.lit("application/msword"), F.lit(None).cast("string")), (F.col("chunk_index") % 4 + 1).cast("int"))
    c = read(s, d, "chunks").where("chunk_index IS NOT NULL").select("source_file", kind.alias("content_type")).distinct()
    return c.select("source_file", "content_type", io.extension(F.col("content_type"), F.col("source_file")).alias("extension"))


def s13_vectors(s: SparkSession, d: str) -> DataFrame:
    """Records and their vectors in one table, aligned by being one row."""
    path = _new(s, "s13")
    io.write_vectors(E.embedded(_chunks(s, d), "page_content"), path)
    return s.read.parquet(path).select("chunk_id", "strategy", F.size("vector").alias("dims"))


def s15_sinks(s: SparkSession, d: str) -> DataFrame:
    """Selected columns as a delimited table, and a summary beside it as JSON."""
    path = _new(s, "s15")
    o = read(s, d, "orders")
    io.write_delimited(o.select("o_orderkey", "o_orderpriority"), f"{path}/table")
    io.write_summary(o.groupBy("o_orderpriority").agg(F.count("*").alias("n")), f"{path}/summary")
    back = io.delimited(s, f"{path}/table", schema="o_orderkey long, o_orderpriority string").groupBy("o_orderpriority").agg(F.count("*").alias("n_read"))
    return s.read.schema("o_orderpriority string, n long").json(f"{path}/summary").join(back, "o_orderpriority")


def s16_store(s: SparkSession, d: str) -> DataFrame:
    """A store that is made when it is first opened, filled, opened again."""
    path = _new(s, "s16")
    c = _chunks(s, d).select("chunk_id", "source_file")
    first = io.opened(s, path, "model", "paragraph", c.schema)
    before = first.count()
    io.added(c, path, "model", "paragraph")
    return io.opened(s, path, "model", "paragraph", c.schema).groupBy("source_file").agg(F.count("*").alias("n"), F.lit(before).alias("before"))


def s18_by_ids(s: SparkSession, d: str) -> DataFrame:
    ids = read(s, d, "extraction_files").select(F.concat(F.regexp_replace("source_file", r"\.pdf$", ""), F.lit(".pdf_chunk_0")).alias("chunk_id"))
    return io.by_ids(_chunks(s, d), ids, "chunk_id").select("chunk_id", "chunk_index")


def s19_filtered(s: SparkSession, d: str) -> DataFrame:
    return io.got(read(s, d, "lineitem"), {"l_returnflag": "R", "l_linenumber": 1}, ["l_orderkey", "l_quantity"])


def s21_sizes(s: SparkSession, d: str) -> DataFrame:
    tables = ("nation", "region", "orders", "no_such_table")
    return s.createDataFrame([(t, io.exists(s, f"{d}/{t}.parquet")) for t in tables], "name string, n long")


def s24_templates(s: SparkSession, d: str) -> DataFrame:
    from ..operators.extraction import templates

    return s.createDataFrame([(k, len(v)) for k, v in templates().items()], "name string, n_chars int")


QUERIES = {f.__name__: f for f in (s2_json_documents, s3_pruned, s4_lines, s5_delimited, s7_cells, s8_pages, s9_point, s10_range, s11_extension, s13_vectors, s15_sinks, s16_store, s18_by_ids, s19_filtered, s21_sizes, s24_templates)}

SQL = {
    "s2_json_documents": "SELECT filename, x.court AS court, x.header AS header FROM (SELECT filename, arg_max({'court': court, 'header': header}, ingested_at) AS x FROM processed_json GROUP BY filename)",
    "s3_pruned": "SELECT DISTINCT chunk_id, chunk_index FROM chunks WHERE strategy = 'paragraph' AND chunk_id IS NOT NULL",
    "s4_lines": "SELECT DISTINCT chunk_id, page_content FROM chunks WHERE chunk_id IS NOT NULL",
    "s5_delimited": "SELECT DISTINCT chunk_id, page_content FROM chunks WHERE chunk_id IS NOT NULL AND page_content <> ''",
    "s7_cells": "SELECT document_name AS sheet, x.a AS context, x.b AS penalty FROM (SELECT document_name, arg_max({'a': q1_context_quotes, 'b': q2_penalty_quotes}, annotated_at) AS x FROM golden_dataset_template GROUP BY 1)",
    "s8_pages": "SELECT CAST(i AS INTEGER) AS id, 'nation ' || i AS name FROM range(0, (SELECT count(*) FROM nation)) t(i)",
    "s9_point": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 32, -1)",
    "s10_range": "SELECT i AS id, o_orderkey IS NOT NULL AS found, o_custkey FROM range(1, 201) t(i) LEFT JOIN orders ON o_orderkey = i",
    "s11_extension": "SELECT source_file, content_type, CASE WHEN contains(lower(content_type), 'pdf') THEN 'pdf' WHEN contains(lower(content_type), 'html') THEN 'html' WHEN contains(lower(content_type), 'word') THEN 'docx' ELSE coalesce(nullif(lower(regexp_extract(source_file, '\\.([A-Za-z0-9]{2,5})$', 1)), ''), 'bin') END AS extension FROM (SELECT DISTINCT source_file, ['application/PDF', 'text/html; charset=utf-8', 'application/msword', NULL][chunk_index % 4 + 1] AS content_type FROM chunks WHERE chunk_index IS NOT NULL)",
    "s13_vectors": "SELECT DISTINCT chunk_id, strategy, 64 AS dims FROM chunks WHERE chunk_id IS NOT NULL",
    "s15_sinks": "SELECT o_orderpriority, count(*) AS n, count(*) AS n_read FROM orders GROUP BY 1",
    "s16_store": "SELECT source_file, count(DISTINCT chunk_id) AS n, 0 AS before FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1",
    "s18_by_ids": "SELECT DISTINCT chunk_id, chunk_index FROM chunks WHERE chunk_id IN (SELECT regexp_replace(source_file, '\\.pdf$', '') || '.pdf_chunk_0' FROM extraction_files)",
    "s19_filtered": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1",
    "s21_sizes": "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'no_such_table', 0",
}
