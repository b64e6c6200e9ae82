import pytest

from lexmill import common


class _Conf:
    def get(self, name):
        return None


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):  # noqa: N802
        return None

    def getConf(self):  # noqa: N802
        return _Conf()


class _Frame:
    class sparkSession:  # noqa: N801
        sparkContext = _Context()  # noqa: N815


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError):
        common.checkpointed(_Frame())


def test_few_splits_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    few = spark.read.parquet(f"{tmp_path}/t")
    assert common.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and common.spread(few).count() == 100
    assert common.spread(spark.range(100).repartition(9)).count() == 100
    assert common.spread(few.limit(0)).count() == 0
