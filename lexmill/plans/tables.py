"""Queries of the relational and statistical operators over the star schema and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read
from ..operators import stats as S
from ..sources import io
from ..streaming import ingest


def d1_means(s: SparkSession, d: str) -> DataFrame:
    return S.means(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"])


def d2_mapped(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").withColumn("score", S.mapped("o_orderstatus", {"F": 1, "O": 0.5, "P": 0, "X": None}))
    return o.groupBy("o_orderpriority").agg(F.bround(F.avg("score"), 6).alias("mean_score"), F.count("score").alias("n"))


def d3_pivot(s: SparkSession, d: str) -> DataFrame:
    return S.pivoted(read(s, d, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity", [1, 2, 3, 4])


def d4_difference(s: SparkSession, d: str) -> DataFrame:
    return S.paired_difference(read(s, d, "lineitem"), "l_returnflag", "l_linestatus", "F", "O", "l_extendedprice")


def d6_missing(s: SparkSession, d: str) -> DataFrame:
    return S.missing_and_ranges(read(s, d, "events").withColumn("number", F.get_json_object("props", "$.none").try_cast("double")), ["value", "number"])


def d7_counts(s: SparkSession, d: str) -> DataFrame:
    return S.value_counts(read(s, d, "events"), "event_type")


def d8_described(s: SparkSession, d: str) -> DataFrame:
    return S.described(read(s, d, "orders"), "o_totalprice", ["o_orderpriority"])


def d9_rate(s: SparkSession, d: str) -> DataFrame:
    return S.rate(read(s, d, "lineitem"), ["l_returnflag"], F.col("l_discount") > 0.05)


def d10_latest(s: SparkSession, d: str) -> DataFrame:
    return S.latest(read(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


def d11_stratified(s: SparkSession, d: str) -> DataFrame:
    return S.stratified_sample(read(s, d, "customer"), "c_mktsegment", "c_custkey", 8).select("c_mktsegment", "c_custkey")


def d12_sample(s: SparkSession, d: str) -> DataFrame:
    return S.sample(read(s, d, "customer"), "c_custkey", 50).select("c_custkey")


EDGES = [0.0, 1000.0, 5000.0, 20000.0, 100000.0, 1000000.0]


def d13_histogram(s: SparkSession, d: str) -> DataFrame:
    return S.histogram(read(s, d, "orders"), "o_totalprice", EDGES)


def d14_pareto(s: SparkSession, d: str) -> DataFrame:
    return S.pareto(read(s, d, "part"), "p_retailprice", "p_size", ["p_brand"]).select("p_brand", "p_retailprice", "p_size")


def d15_interpolated(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("price"))
    return S.interpolated(p, "p_size", "price", ["p_brand"], [0.7, 10.5, 25.25, 50.2, 90.0])


def d16_overlap(s: SparkSession, d: str) -> DataFrame:
    return S.overlap(read(s, d, "part"), ["p_brand"], "p_retailprice")


def d17_interval(s: SparkSession, d: str) -> DataFrame:
    r = read(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg((F.col("l_discount") > 0.05).cast("int")).alias("p"), F.count("*").alias("n"))
    lo, hi = S.binomial_interval(F.col("p"), F.col("n"))
    return r.select("l_returnflag", F.bround("p", 6).alias("p"), "n", lo.alias("lo"), hi.alias("hi"))


def d18_milestones(s: SparkSession, d: str) -> DataFrame:
    m = read(s, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count("*").alias("n"))
    return S.milestones(m, "year", "n", ["o_orderpriority"])


def d19_best(s: SparkSession, d: str) -> DataFrame:
    return S.best_row(read(s, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey")


def d20_masks(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part")
    n = lambda c: F.count(F.when(c, 1))
    return p.agg(n(F.col("p_type").startswith("STANDARD")).alias("n_prefix"), n(F.contains("p_type", F.lit("BRASS"))).alias("n_contains"), n(F.col("p_brand").isin("Brand#11", "Brand#22")).alias("n_in"), n(F.col("p_brand").rlike("#[1-3]")).alias("n_pattern"))


def d22_revenue(s: SparkSession, d: str) -> DataFrame:
    """Five tables joined: revenue by region and year."""
    li, o, c = read(s, d, "lineitem"), read(s, d, "orders"), read(s, d, "customer")
    n, r = read(s, d, "nation"), read(s, d, "region")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.bround(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def d5_coerced(s: SparkSession, d: str) -> DataFrame:
    """Texts as numbers, null where they are none."""
    c = read(s, d, "customer")
    return c.select("c_custkey", F.substring("c_name", -3, 3).try_cast("double").alias("tail"), F.col("c_mktsegment").try_cast("double").alias("segment"))


def d22_savings(s: SparkSession, d: str) -> DataFrame:
    """Tokens of whole documents against those of two calls with seven chunks each, in per cent saved; a token is four characters."""
    chunk = read(s, d, "chunks").where("page_content IS NOT NULL").select("chunk_id", F.floor(F.char_length("page_content") / 4).alias("n")).distinct().agg(F.avg("n").alias("mean_chunk"))
    doc = read(s, d, "processed_json").where("reasoning_full IS NOT NULL").select("filename", F.floor(F.char_length("reasoning_full") / 4).alias("n")).distinct().agg(F.avg("n").alias("mean_document"))
    one = chunk.crossJoin(F.broadcast(doc))  # a row each
    return one.select(F.bround("mean_chunk", 4).alias("mean_chunk"), F.bround("mean_document", 4).alias("mean_document"), F.bround(14 * F.col("mean_chunk"), 4).alias("per_document"), F.bround((1 - 14 * F.col("mean_chunk") / F.col("mean_document")) * 100, 4).alias("saved_percent"))


def d23_adaptive_curve(s: SparkSession, d: str) -> DataFrame:
    from ..operators.retrieval import adaptive_k

    return s.range(1, 131).select(F.col("id").alias("n_chunks"), adaptive_k(F.col("id"), 7).alias("k"))


def s14_union(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    b = read(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    return io.union_all(a, b)


def w1_windowed_events(s: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_counts(read(s, d, "events"), "ts", "event_type", "6 hours")


QUERIES = {f.__name__: f for f in (
    d1_means, d2_mapped, d3_pivot, d4_difference, d6_missing, d7_counts, d8_described, d9_rate, d10_latest, d11_stratified, d12_sample, d13_histogram, d14_pareto, d15_interpolated, d16_overlap, d17_interval, d18_milestones, d19_best,
    d20_masks, d5_coerced, d22_savings, d22_revenue, d23_adaptive_curve, s14_union, w1_windowed_events,
)}

_DRAW = lambda k: f"md5(CAST({k} AS VARCHAR) || ':42')"
_BUCKETS = "(VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + ") AS b(bucket, lo, hi)"

SQL = {
    "d1_means": "SELECT l_returnflag, l_linestatus, round_even(a, 6) AS mean_l_quantity, round_even(b, 6) AS mean_l_discount, round_even(c, 6) AS mean_l_tax, round_even((a + b + c) / 3, 6) AS composite FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY 1, 2)",
    "d2_mapped": "SELECT o_orderpriority, round_even(avg(s), 6) AS mean_score, count(s) AS n FROM (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5 WHEN 'P' THEN 0 END AS s FROM orders) GROUP BY 1",
    "d3_pivot": "SELECT l_returnflag, " + ", ".join(f"round_even(avg(l_quantity) FILTER (l_linenumber = {i}), 6) AS l_linenumber_{i}" for i in (1, 2, 3, 4)) + " FROM lineitem GROUP BY 1",
    "d4_difference": "SELECT l_returnflag, round_even(avg(l_extendedprice) FILTER (l_linestatus = 'F') - avg(l_extendedprice) FILTER (l_linestatus = 'O'), 6) AS difference FROM lineitem GROUP BY 1",
    "d6_missing": "SELECT 'value' AS column_name, count(*) FILTER (value IS NULL) AS n_missing, min(value) AS lowest, max(value) AS highest, round_even(avg(value), 6) AS mean FROM events UNION ALL SELECT 'number', count(*), NULL, NULL, NULL FROM events",
    "d7_counts": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1",
    "d8_described": "SELECT o_orderpriority, count(o_totalprice) AS n, round_even(avg(o_totalprice), 6) AS mean, round_even(stddev_samp(o_totalprice), 6) AS deviation, min(o_totalprice) AS lowest, round_even(quantile_cont(o_totalprice, 0.25), 6) AS q25, round_even(quantile_cont(o_totalprice, 0.5), 6) AS q50, round_even(quantile_cont(o_totalprice, 0.75), 6) AS q75, round_even(quantile_cont(o_totalprice, 0.95), 6) AS q95, max(o_totalprice) AS highest FROM orders GROUP BY 1",
    "d9_rate": "SELECT l_returnflag, round_even(avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END), 6) AS rate, count(*) AS n FROM lineitem GROUP BY 1",
    "d10_latest": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "d11_stratified": f"SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_DRAW('c_custkey')}, c_custkey) AS k FROM customer) WHERE k <= 8",
    "d12_sample": f"SELECT c_custkey FROM customer ORDER BY {_DRAW('c_custkey')}, c_custkey LIMIT 50",
    "d13_histogram": f"SELECT bucket, lo, hi, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS n_up_to FROM (SELECT bucket, lo, hi, count(o_orderkey) AS n FROM {_BUCKETS} LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY ALL)",
    "d14_pareto": "SELECT p_brand, p_retailprice, p_size FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM part) WHERE m IS NULL OR p_size > m",
    "d15_interpolated": """WITH p AS (SELECT p_brand, p_size, avg(p_retailprice) AS price FROM part GROUP BY 1, 2), s AS (SELECT p_brand, p_size::DOUBLE AS x0, price AS y0, (lead(p_size) OVER w)::DOUBLE AS x1, lead(price) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)),
      a AS (SELECT p_brand, target, CASE WHEN target BETWEEN lo - 0.5 AND hi + 0.5 THEN greatest(lo, least(hi, target)) END AS pos FROM (SELECT p_brand, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM p GROUP BY 1) e, (VALUES (0.7::DOUBLE), (10.5), (25.25), (50.2), (90.0)) AS t(target))
      SELECT a.p_brand, a.target, round_even(max(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (pos - x0) / (x1 - x0) END), 6) AS value FROM a LEFT JOIN s ON s.p_brand = a.p_brand AND ((x1 IS NULL AND pos = x0) OR (pos >= x0 AND pos < x1)) GROUP BY 1, 2""",
    "d16_overlap": "SELECT max(a) AS lo, min(b) AS hi FROM (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part GROUP BY p_brand)",
    "d17_interval": "SELECT l_returnflag, round_even(p, 6) AS p, n, round_even(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS lo, round_even(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS hi FROM (SELECT l_returnflag, avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS p, count(*) AS n FROM lineitem GROUP BY 1)",
    "d18_milestones": "SELECT *, round_even(n - lag(n) OVER w, 6) AS delta, round_even(n / lag(n) OVER w, 6) AS ratio FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year)",
    "d19_best": "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "d20_masks": "SELECT count(*) FILTER (starts_with(p_type, 'STANDARD')) AS n_prefix, count(*) FILTER (contains(p_type, 'BRASS')) AS n_contains, count(*) FILTER (p_brand IN ('Brand#11', 'Brand#22')) AS n_in, count(*) FILTER (regexp_matches(p_brand, '#[1-3]')) AS n_pattern FROM part",
    "d22_revenue": "SELECT r_name, strftime(o_orderdate, '%Y') AS year, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "d5_coerced": "SELECT c_custkey, try_cast(right(c_name, 3) AS DOUBLE) AS tail, try_cast(c_mktsegment AS DOUBLE) AS segment FROM customer",
    "d22_savings": "WITH c AS (SELECT avg(n) AS m FROM (SELECT DISTINCT chunk_id, floor(length(page_content) / 4) AS n FROM chunks WHERE page_content IS NOT NULL)), d AS (SELECT avg(n) AS m FROM (SELECT DISTINCT filename, floor(length(reasoning_full) / 4) AS n FROM processed_json WHERE reasoning_full IS NOT NULL)) SELECT round_even(c.m, 4) AS mean_chunk, round_even(d.m, 4) AS mean_document, round_even(14 * c.m, 4) AS per_document, round_even((1 - 14 * c.m / d.m) * 100, 4) AS saved_percent FROM c, d",
    "d23_adaptive_curve": "SELECT n AS n_chunks, CAST(CASE WHEN n <= 30 THEN 7 ELSE least(12, 7 + floor((n - 30) / 15)) END AS INTEGER) AS k FROM range(1, 131) t(n)",
    "s14_union": "SELECT s_name AS name, s_nationkey AS nation, 'supplier' AS kind, NULL AS segment FROM supplier UNION ALL SELECT c_name, NULL, 'customer', c_mktsegment FROM customer",
    "w1_windowed_events": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round_even(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}
