"""Facts: the small cases that fix their meaning."""

import pytest
from pyspark.sql import functions as F

from tracefolio.functions import periods, quote_units, units
from tracefolio.operators import facts as ops

SCHEMA = "document_id string, company_name string, metric_id string, fiscal_period string, fiscal_year int, normalized_value double, normalized_unit string, currency string, evidence_page int, evidence_quote string, review_status string"


def fact(doc, value, company="", period="2025 annual report", unit="CNY", page=1, quote="q", status="verified", year=2025):
    return (doc, company or doc, "revenue", period, year, value, unit, unit, page, quote, status)


def ask(spark, rows, limit=3, documents=None):
    df = spark.createDataFrame(rows, SCHEMA)
    top = [r["document_id"] for r in ops.top_facts(df, metric_id="revenue", fiscal_year=2025, limit=limit, documents=documents).collect()]
    return top, ops.funnel(df, metric_id="revenue", fiscal_year=2025, limit=limit, documents=documents).collect()[0]


def test_only_verified_cited_facts_of_the_year(spark):
    rows = [fact("a", 100.0), fact("b", 300.0), fact("c", 200.0), fact("d", 999.0, status="needs_review"), fact("e", 800.0, quote=" 　"), fact("f", 700.0, year=2024)]
    top, f = ask(spark, rows)
    assert top == ["b", "c", "a"] and f["status"] == "success" and f["returned_rows"] == 3


def test_annual_facts_and_one_a_company(spark):
    rows = [
        fact("a1", 300.0, "Acme"), fact("a2", 999.0, "Acme", "2025 1-9月"), fact("a3", 320.0, " acme ", "2025年年度报告"), fact("b", 250.0, "B"), fact("c1", 500.0, "C", "2025 interim"), fact("c2", 200.0, "C"),
    ]
    top, f = ask(spark, rows)
    assert top == ["a3", "b", "c2"]
    assert (f["candidate_count"], f["verified_annual_candidates"], f["after_citation_filter"], f["after_company_dedupe"], f["excluded_non_annual_count"], f["excluded_duplicate_company_count"], f["returned_rows"]) == (6, 4, 4, 3, 2, 1, 3)


def test_units_that_differ_give_no_rows_even_for_one(spark):
    rows = [fact("a", 300.0), fact("b", 200.0, unit="HKD"), fact("c", 100.0)]
    top, f = ask(spark, rows, limit=1)
    assert top == [] and f["status"] == "unsupported" and f["note"] == "incomparable_normalized_units=CNY,HKD" and f["after_company_dedupe"] == 3


def test_documents_none_and_empty(spark):
    rows = [fact("a", 1.0), fact("b", 2.0)]
    assert ask(spark, rows, documents=["a", "a", "z"])[0] == ["a"]
    top, f = ask(spark, rows, documents=[])
    assert top == [] and f["status"] == "partial" and f["selected_docs"] == 0 and f["note"] == "no_verified_annual_cited_facts"
    assert ask(spark, rows, limit=3)[1]["note"] == "coverage_below_requested_limit"


def test_upsert_last_row_wins(spark):
    old = spark.createDataFrame([("x", "d", 1.0), ("y", "d", 2.0)], "fact_id string, document_id string, value double")
    new = spark.createDataFrame([("x", "d", 300.0, 0), ("x", "d", 400.0, 1), ("z", "d", 5.0, 2)], "fact_id string, document_id string, value double, pos int")
    assert sorted((r[0], r[2]) for r in ops.upsert(old, new).collect()) == [("x", 400.0), ("y", 2.0), ("z", 5.0)]
    assert sorted(r[0] for r in ops.replace_document(old, "d", new).collect()) == ["x", "z"]
    with pytest.raises(ValueError, match="a, b"):
        ops.replace_document(old, "d", new.withColumn("document_id", F.when(F.col("pos") == 0, "b").otherwise("a")))


@pytest.mark.parametrize(
    "label,annual",
    [("2025 annual report", True), ("2025", True), ("2025年", True), ("FY 2025 Full_Year", True), ("2025年度报告", True), ("Q3 2025 annual report", False), ("annual report 2021-11-30", False), ("2025 interim", False), ("", False), (None, False), ("report 2025", False), ("2025年前三季度报告", False)],
)
def test_annual(spark, label, annual):
    assert spark.createDataFrame([(label,)], "p string").select(periods.is_annual(F.col("p"))).collect()[0][0] is annual


@pytest.mark.parametrize(
    "unit,currency,scale",
    [("RMB million", "CNY", 1e6), ("人民币千元", "CNY", 1e3), ("HK$ thousand", "HKD", 1e3), ("百万", None, 1e4), ("欧元", "CNY", 1.0), ("亿元", "CNY", 1e8), ("", None, None), (None, None, None), ("USD", "USD", 1.0)],
)
def test_units(spark, unit, currency, scale):
    r = spark.createDataFrame([(unit,)], "u string").select(units.currency(F.col("u")), units.scale(F.col("u"))).collect()[0]
    assert tuple(r) == (currency, scale)


@pytest.mark.parametrize(
    "value,currency,scale,quote,want",
    [
        (100.0, "CNY", 1e6, "", ("fallback_global", "CNY", 1e6, True)),
        (100.0, "CNY", 1e6, "revenue 100 亿元", ("resolved", "CNY", 1e8, True)),
        (100.0, "CNY", 1e6, "revenue １００ 亿元", ("resolved", "CNY", 1e8, True)),
        (100.0, "CNY", 1e6, "HKD million 100", ("needs_review", "HKD", 1e6, False)),
        (100.0, "CNY", 1e6, "100 亿元 and again 100 万元 and more words here", ("needs_review", "CNY", 1e6, False)),
        (100.0, "CNY", 1e6, "nothing of it: 7 亿元", ("needs_review", "CNY", 1e6, False)),
        (100.0, "CNY", 1e6, "just 100 with no unit", ("fallback_global", "CNY", 1e6, True)),
        (100.0, "CNY", 1e6, "RMB 100", ("fallback_global", "CNY", 1e6, True)),
        (100.0, None, None, "RMB 100", ("needs_review", None, None, False)),
        (337532.0, "CNY", 1e6, "337,532 150,181", ("fallback_global", "CNY", 1e6, True)),
    ],
)
def test_quote_units(value, currency, scale, quote, want):
    status, cur, sc, _, allowed, _, _ = quote_units.resolve(value, currency, scale, "global", quote)
    assert (status, cur, sc, allowed) == want


def test_quote_units_column(spark):
    df = spark.createDataFrame([(100.0, "CNY", 1e6, "RMB million", "100 亿元"), (None, None, None, None, None)], "v double, c string, s double, r string, q string")
    got = df.select(quote_units.resolve_column(*(F.col(c) for c in "vcsrq")).alias("u")).select("u.*").collect()
    assert got[0]["reason"] == "quote_local_unit_global_ignored" and "global_unit_ignored=RMB million" in got[0]["note"] and got[1]["status"] == "fallback_global"
