import json

from conftest import rows

from lexmill.operators import drift as D

REG = [("a", "object", True), ("a.b", "object", True), ("a.b.c", "object", True), ("a.b.c.leaf_value", "int", True), ("a.b.c.note", "string", False)]


def test_any_number_of_levels(spark):
    of = lambda o: json.dumps({"a": {"b": {"c": o}}})
    deep = {"x": {"y": 1}}
    payloads = [of({"leaf_value": 1})] * 8 + [of({"leafValue": 1}), of({"leaf_value": "1"}), of({"leaf_value": 2, "more": deep}), of({})]
    files = spark.createDataFrame([(f"f{i:02d}", p) for i, p in enumerate(payloads)], "file_id string, payload string")
    reg = spark.createDataFrame(REG, "field_path string, json_type string, is_required boolean")
    assert rows(D.changes(files, reg)) == [("f08", "renamed", "a.b.c.leaf_value"), ("f09", "retyped", "a.b.c.leaf_value"), ("f10", "added", "a.b.c.more"), ("f11", "removed", "a.b.c.leaf_value")]
    assert "a.b.c.more.x.y" in {r["path"] for r in D.statistics(files).collect()}
    assert len(D.nodes("[" * 50 + "]" * 50)) == 0
