import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_tokens_packing import V1, V2, table

from lexmill.llm import packing as P
from lexmill.llm import token_budget as T

have = pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="no vocabulary files here")


@have
def test_updates_reach_what_a_rebuild_gives(spark):
    one, two = table(spark, V1), table(spark, V2)
    first, change = T.State().update(one)
    second, delta = first.update(two)
    fresh, _ = T.State().update(two)
    assert rows(second.base) == rows(fresh.base) and rows(first.base) == rows(change)
    assert delta.agg(F.sum("n_docs")).first()[0] == 3 - 4  # documents c and d left, e came
    assert second.counts.groupBy("content").count().where("count > 1").count() == 0
    assert first.update(one)[1].count() == 0


@have
def test_pieces_of_long_texts_in_other_scripts():
    path = f"{T.TOKENIZERS}/{T.TOKENIZER}"
    for unit in ("合同违约金。", "सज़ा बहुत अधिक है। ", "ค่าปรับ", "Αυτό είναι υπερβολικό; ", "a  b\n\nc 12 ", "неустойка по договору 5 % "):
        long = unit * (T._LONG // len(unit) + 900)
        assert T.n_tokens(long, path) == len(T.encoder(path).encode_ordinary(long)), unit


def test_limits_that_bind(spark):
    sized = spark.createDataFrame([(i, 40 + i % 50, 30 + i % 40) for i in range(300)] + [(1000, 500, 450), (1001, 90, 90)], "doc_id long, n_tokens long, loss long")
    kinds = spark.createDataFrame([("k", 200)], "container_kind string, capacity_tokens int")
    how = {"tokens_a_segment": 80.0, "loss_share": 0.4}
    got = P.placed(sized, kinds, loss="loss", **how)
    assert [r[1:] for r in rows(P.audit(got, sized, kinds, **how))] == [(302, 0, 0, 0, 0)]
    full = got.groupBy("block", "container_no").agg(F.sum("loss_tokens").alias("l"), F.count("*").alias("s"))
    assert full.agg(F.max("l")).first()[0] <= 80 and full.agg(F.max("s")).first()[0] <= 2
    assert [r[2:] for r in rows(P.audit(got.where("doc_id <> 3"), sized, kinds, **how))] == [(1, 0, 0, 0)]
    assert P.placed(sized, kinds, block=None).select("block").distinct().count() == 1


@have
def test_workers_without_the_folder_take_the_file_of_the_job(spark, tmp_path):
    import shutil

    for n in (T.TOKENIZER, "__init__.py"):
        shutil.copy(f"{T.TOKENIZERS}/{n}", tmp_path / n)
    path = f"{tmp_path}/{T.TOKENIZER}"
    col = T.token_count("t", path)
    (tmp_path / T.TOKENIZER).unlink()  # as on a worker: only what came with the job is there
    df = spark.createDataFrame([("Zmluvná pokuta",), (None,)], "t string")
    assert [r[0] for r in df.select(col).collect()] == [T.n_tokens("Zmluvná pokuta", f"{T.TOKENIZERS}/{T.TOKENIZER}"), 0]
