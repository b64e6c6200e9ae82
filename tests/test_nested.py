from conftest import rows
from pyspark.sql import functions as F

from lexmill.operators import nested

SCHEMA = """extraction_id string, penalty_no int, result struct<contractual_penalties: array<struct<penalty_id: string, related_claim_ref: string, breach_type: struct<value: string>, rate_definition: struct<type: string, value_raw: string>,
 amounts: struct<currency: string, secured_principal: struct<value: double>, original_claimed: struct<value: double>, final_awarded: struct<value: double>>, associated_interest: struct<awarded: string, rate_value: string>,
 moderation_analysis: struct<decision: struct<value: string, dismissal_reason: string>, legal_reasoning_summary: string, key_quotes: array<struct<quote: string, chunk_id: string>>,
 factors: array<struct<label: string, sentiment: string, evidence: struct<quote: string, chunk_id: string>>>>>>>"""


def test_links_and_tables(spark):
    mod = (None, "r", [("q0", "c"), None, ("q2", None)], [None, ("dobre_mravy", "negative", None)])
    pen = ("p1", None, None, None, None, None, mod)
    bare = (None, None, None, None, None, None, None)
    data = [("e1", 7, ([pen, None, bare],)), ("e1", 8, ([pen, None, bare],)), ("e2", None, (None,)), ("e3", None, None), ("e4", 1, ([],))]
    df = spark.createDataFrame(data, SCHEMA)
    want = [("e1", 0, "penalty", -1), ("e1", 0, "key_quote", 0), ("e1", 0, "key_quote", 2), ("e1", 0, "factor", 1), ("e1", 2, "penalty", -1)]
    assert rows(nested.links(df)) == sorted(want, key=str)
    assert [r["quote"] for r in nested.key_quotes(df).orderBy("quote_no").collect()] == ["q0", "q2"]
    assert nested.factors(df).select("label").collect()[0][0] == "dobre_mravy"
    assert nested.penalties(df).count() == 2
    assert rows(nested.links(df.limit(0))) == []
    plan = nested.links(df).select(F.count("*"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
