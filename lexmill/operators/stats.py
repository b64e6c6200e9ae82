"""Relational and statistical operators over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def means(df: DataFrame, by: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    """Group means of several measures and their row mean, nulls left out."""
    out = df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
    have = sum((F.col(f"mean_{c}").isNotNull().cast("int") for c in cols[1:]), F.col(f"mean_{cols[0]}").isNotNull().cast("int"))
    total = sum((F.coalesce(F.col(f"mean_{c}"), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(f"mean_{cols[0]}"), F.lit(0.0)))
    return out.withColumn("composite", F.bround(total / F.nullif(have, F.lit(0)), digits)).select(*by, *[F.bround(f"mean_{c}", digits).alias(f"mean_{c}") for c in cols], "composite")


def mapped(col: Column | str, values: dict[str, float | None]) -> Column:
    """A category as a number; null for unlisted ones and those mapped to null."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("double")
    for k, v in values.items():
        if v is not None:
            out = F.when(c == k, F.lit(float(v))).otherwise(out)
    return out


def pivoted(df: DataFrame, index: str, column: str, value: str, values: list) -> DataFrame:
    """Mean of ``value`` per index, a column per listed value; the list is given, so no job looks for it."""
    out = df.groupBy(index).pivot(column, values).agg(F.bround(F.avg(value), 6))
    return out.select(index, *[F.col(f"`{v}`").alias(f"{column}_{v}") for v in values])


def paired_difference(df: DataFrame, key: str, side: str, a: str, b: str, value: str) -> DataFrame:
    of = lambda s: F.avg(F.when(F.col(side) == s, F.col(value)))
    return df.groupBy(key).agg(F.bround(of(a) - of(b), 6).alias("difference"))


def missing_and_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_missing, lowest, highest, mean): one aggregate over all rows."""
    row = df.agg(*[F.struct(F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"), F.min(F.col(c).cast("double")).alias("lowest"), F.max(F.col(c).cast("double")).alias("highest"), F.bround(F.avg(c), 6).alias("mean")).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c)["n_missing"].alias("n_missing"), F.col(c)["lowest"].alias("lowest"), F.col(c)["highest"].alias("highest"), F.col(c)["mean"].alias("mean")) for c in cols])))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))


def described(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Count, mean, deviation and exact quartiles per group."""
    q = lambda p: F.bround(F.percentile(col, p), 6)
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.bround(F.avg(col), 6).alias("mean"), F.bround(F.stddev_samp(col), 6).alias("deviation"), F.min(col).alias("lowest"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), q(0.95).alias("q95"), F.max(col).alias("highest"))


def rate(df: DataFrame, by: list[str], test: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.bround(F.avg(F.coalesce(test, F.lit(False)).cast("int")), 6).alias("rate"), F.count("*").alias("n"))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows of each stratum, chosen by a hash of key and seed: the same on every run and every engine."""
    draw = F.md5(F.encode(F.concat(F.col(key).cast("string"), F.lit(":" + seed)), "UTF-8"))
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(draw, key))).where(F.col("_k") <= n).drop("_k")


def sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows by the same hash, as a top n without a global sort."""
    draw = F.md5(F.encode(F.concat(F.col(key).cast("string"), F.lit(":" + seed)), "UTF-8"))
    return df.orderBy(draw, key).limit(n)


def histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """(bucket, n, n_up_to): rows per bucket [edge, next edge) and up to its end. The edges are the few given."""
    spark = df.sparkSession
    b = F.broadcast(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(edges, edges[1:]))], "bucket int, lo double, hi double"))
    place = F.lit(-1)
    for i, (x, y) in enumerate(zip(edges, edges[1:])):
        place = F.when((F.col(col) >= x) & (F.col(col) < y), i).otherwise(place)
    n = df.groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    out = b.join(n, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("n_up_to", F.sum("n").over(Window.orderBy("bucket")))  # one row per bucket


def pareto(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rows that beat every earlier ``y`` in the order of ``x``, per family."""
    w = Window.partitionBy(*by).orderBy(x, F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(y).over(w)).where(F.col("_best").isNull() | (F.col(y) > F.col("_best"))).drop("_best")


def interpolated(df: DataFrame, x: str, y: str, by: list[str], targets: list[float], slack: float = 0.5) -> DataFrame:
    """(by..., target, value): linear between neighbouring points, the end values up to ``slack`` outside, null beyond."""
    spark = df.sparkSession
    t = F.broadcast(spark.createDataFrame([(float(v),) for v in targets], "target double"))
    w = Window.partitionBy(*by).orderBy(x)
    seg = df.select(*by, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), F.lead(x).over(w).cast("double").alias("x1"), F.lead(y).over(w).cast("double").alias("y1"))
    ends = df.groupBy(*by).agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    asked = ends.crossJoin(t).withColumn("at", F.when((F.col("target") >= F.col("lo") - slack) & (F.col("target") <= F.col("hi") + slack), F.greatest("lo", F.least("hi", "target"))))
    last = (F.col("x1").isNull() & (F.col("at") == F.col("x0"))) | ((F.col("at") >= F.col("x0")) & (F.col("at") < F.col("x1")))
    hit = asked.join(seg, by).where(last)
    value = F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("at") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    got = hit.groupBy(*by, "target").agg(F.bround(F.max(value), 6).alias("value"))
    return asked.select(*by, "target").join(got, [*by, "target"], "left")


def overlap(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(lo, hi): where the ranges of all groups overlap."""
    return df.groupBy(*by).agg(F.min(x).alias("a"), F.max(x).alias("b")).agg(F.max("a").alias("lo"), F.min("b").alias("hi"))


def binomial_interval(p: Column, n: Column) -> tuple[Column, Column]:
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return F.bround(p - half, 6), F.bround(p + half, 6)


def milestones(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Each step with the change from the one before and the ratio to it."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("delta", F.bround(F.col(value) - before, 6)).withColumn("ratio", F.bround(F.try_divide(F.col(value), before), 6))


def best_row(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The key of the highest value per group; ties go to the smaller key."""
    return df.groupBy(*by).agg(F.min_by(F.col(key), F.struct(-F.col(value), F.col(key))).alias(key), F.max(value).alias(value))
