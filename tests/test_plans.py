"""Whole plans: records to facts to an answer, and hybrid search."""

import json

import pytest

from tracefolio import schemas
from tracefolio.plans import answers, backfill, hybrid
from tracefolio.sources.artifacts import FactTable


def field(value=None, page=None, quote=None, citations=()):
    return {"value": value, "evidence_page": page, "evidence_quote": quote, "citations": [{"document_id": "d", "source_path": "p", "page_number": p, "quote": q} for p, q in citations]}


def record(doc, company, revenue, period="2025年年度报告", unit="人民币百万元", **more):
    return {"document_id": doc, "source_path": f"{doc}.pdf", "company_name": field(company), "fiscal_period": field(period), "unit": field(unit), "revenue": revenue, "roe": field("12")} | more


def facts(spark, *records):
    df = spark.read.schema(schemas.HEADLINE).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))
    return backfill.convert(df)


def rows(spark, *records):
    return {(r["document_id"], r["metric_id"]): r for r in facts(spark, *records).collect()}


def test_conversion(spark):
    got = rows(
        spark,
        record("a", "甲", field("1,000", 3, "营业收入 1,000"), net_profit=field("n/a"), total_assets=field("5", None, "", [(None, "x"), (9, " 总资产 5 ")])),
        record("b", "乙", field("7", 1, "营业收入 7 亿元")),
        record("c", "丙", field("7", 1, "营业收入 7 港元"), period="全年"),
        record("d", "丁", field("7", None, ""), unit=""),
    )
    assert set(got) == {("a", "revenue"), ("a", "total_assets"), ("b", "revenue"), ("c", "revenue"), ("d", "revenue")}
    a, t, b, c, d = (got[k] for k in sorted(got))
    assert (a["normalized_value"], a["normalized_unit"], a["review_status"], a["fiscal_year"], a["period_type"]) == (1e9, "CNY", "verified", 2025, "period")
    assert (t["evidence_page"], t["evidence_quote"], t["period_type"]) == (9, "总资产 5", "end_of_period")
    assert b["normalized_value"] == 7e8 and b["unit_raw"] == "亿元" and b["review_status"] == "verified" and "global_unit_ignored=人民币百万元" in b["notes"]
    assert c["normalized_value"] is None and c["review_status"] == "needs_review" and "fiscal_year, currency_conflict" in c["notes"]
    assert d["notes"].startswith("missing: unit_currency_or_scale, evidence_page, evidence_quote") and d["normalized_value"] is None


def test_backfill_twice_is_once(spark, tmp_path):
    store = FactTable(spark, f"file://{tmp_path}/facts")
    df = spark.read.schema(schemas.HEADLINE).json(spark.sparkContext.parallelize([json.dumps(record("a", "甲", field("1", 3, "营业收入 1")))]))
    backfill.backfill(df, store)
    first = store.read().collect()
    backfill.backfill(df, store)
    assert store.read().collect() == first and len(first) == 1


def test_answer(spark):
    f = facts(spark, *(record(d, n, field(str(v), 2, f"营业收入 {v}")) for d, n, v in (("a", "甲", 100), ("b", "乙|丙", 300), ("c", "丁", 200))))
    got = answers.answer(f, "当前 KB 里 2025 年营业收入最高的两家公司")
    assert got["status"] == "success" and [r["document_id"] for r in got["rows"]] == ["b", "c"]
    assert "| 1 | 乙\\|丙 | 3.00 亿元 | 2 |" in got["text"] and got["funnel"]["candidate_count"] == 3
    assert answers.answer(f, "营业收入是多少？") is None
    assert answers.answer(f, "当前KB 2024年收入 top3")["text"] == answers.REFUSALS["year_unsupported"]
    assert answers.answer(f, "当前KB 2025年收入 top5")["status"] == "partial"
    assert [r["document_id"] for r in answers.answer(f, "当前KB 2025年收入 top5", documents=["a"])["rows"]] == ["a"]


def test_hybrid(spark):
    pages = spark.createDataFrame([(1, "apple pie", [1.0, 0.0], "page_text"), (2, "apple tart", [0.0, 1.0], "page_text"), (3, "apple apple", [1.0, 0.0], "table_row"), (4, "nothing", [0.9, 0.1], "page_text")], "doc_id long, text string, embedding array<double>, chunk_kind string")
    q = spark.createDataFrame([(7, "pie", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    got = hybrid.search(pages, q).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 4, 2] and got[0]["score"] == pytest.approx(0.4 / 21 + 0.6 / 21)
    assert hybrid.search(pages.where("doc_id = 3"), q).count() == 0


def test_steps_wait_for_each_other():
    from tracefolio.plans import workflow

    order = workflow.in_order(workflow.STEPS)
    assert all(order.index(w) < order.index(s) for s, waits in workflow.STEPS.items() for w in waits)
    with pytest.raises(ValueError):
        workflow.in_order({"a": ("b",), "b": ("a",)})
