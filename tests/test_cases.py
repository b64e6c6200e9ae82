import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexmill.operators import casebase as C
from lexmill.operators import extraction as X


def test_json_of(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('```json\n{"a": 1}\n```',), ('Tu: {"a": 1} koniec',), ("nič",), (None,)], "t string")
    assert [r[0] for r in df.select(F.get_json_object(X.json_of("t"), "$.a")).collect()] == ["1", "1", "1", None, None]


def test_best_window_against_brute_force():
    def brute(quote, text):
        q, words = set(quote.lower().split()), text.split()
        w = min(len(quote.split()) + 3, len(words))
        if not q or not w:
            return 0.0
        return max(len(q & {x.lower() for x in words[i : i + w]}) for i in range(len(words) - w + 1)) / len(q)

    for quote, text in [("a b c", "x a y b c z"), ("a a b", "b b a"), ("q", ""), ("", "x"), ("súd pokutu znížil", "Okresný súd v konaní pokutu napokon primerane znížil na sumu")]:
        assert X.best_window(quote, text)[0] == pytest.approx(brute(quote, text))


def test_grounding_levels(spark):
    text = spark.createDataFrame([("s", "Súd  pokutu znížil , lebo bola neprimeraná.")], "source_file string, text string")
    ev = [("exact", "bola neprimeraná"), ("whitespace", "Súd pokutu znížil, lebo"), ("case", "súd pokutu znížil, LEBO"), ("fuzzy", "pokutu súd znížil bola ináč"), ("not_found", "celkom iná veta bez zhody slov tu")]
    df = spark.createDataFrame([("e", "s", i, n, q, "c") for i, (n, q) in enumerate(ev)] + [("e", "zz", 9, "none", "x", "c")], "extraction_id string, source_file string, penalty_no int, field_path string, quote string, chunk_id string")
    got = {r["field_path"]: r["level"] for r in X.grounded(df, text).collect()}
    assert got == {n: n for n, _ in ev} | {"none": "no_source"}


def test_merged_calls_last_wins(spark):
    facts = spark.createDataFrame([("d", 0, "p1"), ("d", 1, "p2"), ("d", 2, None)], "doc string, penalty_no int, penalty_id string")
    mod = spark.createDataFrame([("d", 0, "p1", "dismissed", "a"), ("d", 1, "p1", "returned", "b")], "doc string, no int, penalty_id string, decision string, summary string")
    assert [(r["decision"], r["matched"]) for r in X.merged_calls(facts, mod).orderBy("penalty_no").collect()] == [("returned", True), ("unclear", False), ("unclear", False)]


REC = "extraction_id string, penalty_no int, contract_type string, breach_type string, decision string, secured_principal double, original_claimed double, authority_level int, factors array<struct<label: string, sentiment: string>>"


@pytest.fixture()
def records(spark):
    data = [("a", 0, "dielo", "late_payment", "moderated_301", 48000.0, None, 3, [("dobre_mravy", "negative")]), ("b", 0, "dodavka_sluzieb", "late_payment", "awarded_full", None, 100000.0, 1, []), ("c", 0, "najom", "other", "unclear", 0.0, 5.0, 2, None)]
    return spark.createDataFrame(data, REC)


def test_amount_ratio(spark, records):
    got = {r[0]: r[1] for r in records.select("extraction_id", C.amount_score(50000.0)).collect()}
    assert got == {"a": pytest.approx(0.96), "b": pytest.approx(0.5), "c": 0.5}


def test_filter_falls_back(records):
    assert {r["filter_type"] for r in C.filtered(records, C.Intent(contract_type="uver")).collect()} == {"none_fallback"}
    assert C.filtered(records, C.Intent(contract_type="dielo")).count() == 2
    assert C.filtered(records, C.Intent()).first()["filter_type"] == "none"


def test_ranking_and_statistics(records):
    best = C.ranked(records, C.Intent(decision="moderated_301", factors=("dobre_mravy",), amount=50000.0)).collect()
    assert [r["extraction_id"] for r in best][0] == "a" and [r["rank"] for r in best] == [1, 2, 3]
    assert C.statistics(records).first()["moderation_rate_pct"] is None
    assert {r["label"]: r["n_negative"] for r in C.factor_counts(records).collect()}["dobre_mravy"] == 1 and C.factor_counts(records).count() == 7
    assert rows(C.report(records))[0][1].startswith("  - dobre mravy....")


def test_merit_ratio(spark):
    data = [(f"e{i}", 0, "dielo", "x", "awarded_full" if i < 15 else "moderated_301", None, None, 1, []) for i in range(24)]
    assert C.statistics(spark.createDataFrame(data, REC)).first()["moderation_rate_pct"] == 37.5
