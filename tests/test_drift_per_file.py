from conftest import rows
from test_drift import payload, run

from lexmill.operators import drift as D


def found(spark, payloads):
    files, reg = run(spark, payloads)
    got = {}
    for f, c, p in rows(D.changes(files, reg)):
        got.setdefault(int(f[1:]), set()).add((c, p))
    return got


def test_one_file_with_both_names_does_not_settle_the_others(spark):
    renamed, both = payload(cfg={"modelName": "m", "top_k": 5, "alpha": 0.5}), payload(cfg={"model": "m", "modelName": "m", "top_k": 5, "alpha": 0.5})
    got = found(spark, [payload()] * 10 + [renamed, renamed, both])
    assert got == {10: {("renamed", "cfg.model")}, 11: {("renamed", "cfg.model")}, 12: {("added", "cfg.modelName")}}


def test_a_file_is_settled_alike_in_small_and_large_deliveries(spark):
    other = payload(cfg={"mdl_kind": "x", "top_k": 5, "alpha": 0.5})  # little alike, new contents
    for n in (1, 6):
        got = found(spark, ([payload()] * 9 + [other]) * n)
        assert len(got) == n and all(v == {("renamed", "cfg.model")} for v in got.values()), got


def test_a_removed_and_an_added_member_may_meet_by_chance(spark):
    got = found(spark, [payload()] * 9 + [payload(cfg={"schema_version": "2", "top_k": 5, "alpha": 0.5})])
    assert got == {9: {("removed", "cfg.model"), ("added", "cfg.schema_version")}}
