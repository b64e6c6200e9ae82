"""Helpers shared by every operator: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only on one machine (``local`` masters, as in tests), where the session names none, a temporary one is set;
    on a cluster a folder of one machine could not be shared, so none named is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[.*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexmill-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt to all cores before costly work on its texts; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < splits < cores else df


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (best checkpointed before) has at most ``most`` rows; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salted(key: F.Column | str, n: int, *by: F.Column) -> F.Column:
    """A salt in [0, n) drawn from a hash, so that it is the same when a task is run again."""
    return F.pmod(F.xxhash64(key, *by), F.lit(n)).cast("int")


def ensure_package(spark: SparkSession) -> None:
    """Let the workers import this package: ship it once per context where their path lacks it."""
    sc = spark.sparkContext
    if getattr(sc, "_lexmill_ready", False):
        return

    def importable(_: int) -> bool:
        import importlib.util

        return importlib.util.find_spec("lexmill") is not None

    if not sc.parallelize([0], 1).map(importable).first():
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="lexmill-"), "lexmill.zip")  # of the driver, served to the executors by Spark
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    sc._lexmill_ready = True
