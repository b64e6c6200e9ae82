import json

from conftest import rows

from lexmill.operators import drift as D

REG = [("cfg", "object", True), ("cfg.model", "string", True), ("cfg.top_k", "int", True), ("cfg.alpha", "double", True), ("cfg.note", "string", False), ("qc", "object", True), ("qc.flags", "array<string>", True)]


def run(spark, payloads):
    files = spark.createDataFrame([(f"f{i:02d}", p, "x") for i, p in enumerate(payloads)], "file_id string, payload string, path string")
    reg = spark.createDataFrame(REG, "field_path string, json_type string, is_required boolean")
    return files, reg


def payload(cfg=None, qc=None, **more):
    return json.dumps({"cfg": {"model": "m", "top_k": 5, "alpha": 0.5} if cfg is None else cfg, "qc": {"flags": ["A"]} if qc is None else qc, "meta": {"x": 1}} | more)


def test_changes(spark):
    base = [payload()] * 12
    odd = [
        payload(cfg={"modelName": "m", "top_k": 5, "alpha": 1}), payload(cfg={"model": "m", "topK": "5", "alpha": None}), payload(cfg={"model": "m", "alpha": 0.5}), payload(extra={"a": 1}),
        payload(qc={"flags": [1]}), payload(qc={"flags": []}), payload(cfg=4), None, "not json", "[1]",
    ]
    files, reg = run(spark, base + odd)
    got = {}
    for f, c, p in rows(D.changes(files, reg)):
        got.setdefault(int(f[1:]) - 12, set()).add((c, p))
    assert got[0] == {("renamed", "cfg.model")}
    assert got[1] == {("renamed", "cfg.top_k"), ("retyped", "cfg.top_k")}
    assert got[2] == {("removed", "cfg.top_k")}
    assert got[3] == {("added", "extra")}
    assert got[4] == {("retyped", "qc.flags")}
    assert 5 not in got and all(k >= 0 for k in got)
    assert got[6] == {("retyped", "cfg")}
    assert got[7] == got[8] == got[9] == {("removed", "cfg"), ("removed", "qc")}


def test_conformed_reports_failed_casts(spark):
    files, reg = run(spark, [payload()] * 6 + [payload(cfg={"model": "m", "top_k": "many", "alpha": 0.5})])
    out = {r["file_id"]: r for r in D.conformed(files, reg).collect()}
    assert out["f00"]["cfg__top_k"] == 5 and out["f00"]["qc__flags"] == ["A"] and out["f00"]["failed_casts"] == []
    assert out["f06"]["cfg__top_k"] is None and out["f06"]["failed_casts"] == ["cfg.top_k"]


def test_empty_and_repeated(spark):
    files, reg = run(spark, [payload()])
    assert rows(D.changes(files.limit(0), reg)) == []
    assert rows(D.changes(files.unionByName(files), reg)) == []
    assert rows(D.statistics(files.limit(0))) == []


def test_types():
    assert D.valid("int", "double") and not D.valid("double", "int") and D.valid("array<>", "array<string>") and not D.valid("array<null|string>", "array<string>") and D.valid("null", "object")
    assert D.likeness("baseTopK", "base_top_k") == 1.0
