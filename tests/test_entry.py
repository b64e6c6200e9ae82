import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "lexmill")
    for at, _, names in os.walk(root):
        if os.sep + "llm" not in at:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(at, n), encoding="utf-8").read()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship_and_some_queries(spark):
    assert entry.entry(spark).count() > 0
    for name in ("p2_found", "p4_found", "p6_found", "x5_features", "case_ranking", "m12_summary", "d22_revenue"):
        assert entry.queries()[name](spark, DATA).columns
