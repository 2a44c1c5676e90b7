"""Line tables, stated figures, page sources and stored artifacts."""

import json

import pytest
from pyspark.sql import functions as F

from tracefolio.functions import phrases
from tracefolio.operators import line_tables as L
from tracefolio.sources import artifacts, registry

ANNUAL = """主要会计数据
人民币百万元
2025年
2024年
营业收入
337,532
330,000
归属于本行股东的净利润
(1)
148,391
146,602
总资产
11,657,537
11,028,483
1
2"""


def test_figures_of_the_reports_year():
    found = L.headline_figures([(3, ANNUAL)], "annual_report", "2025年年度报告")
    assert {f: c[1] for f, c in found.items()} == {"revenue": 337532.0, "net_profit": 148391.0, "total_assets": 11657537.0}
    assert found["revenue"][5] == "人民币百万元" and found["revenue"][2] == 3
    assert L.headline_figures([(3, ANNUAL)], "annual_report", "2024年年度报告")["revenue"][1] == 330000.0


def test_labels_over_lines_and_what_rules_them_out():
    assert L.find_label(["归属于上市公司", "股东的净利润", "100"], 0, "net_profit")[:2] == ("归属于上市公司 股东的净利润", 1)
    assert L.label_score("revenue", "占营业收入的比例") == 0 and L.label_score("roe", "ROAA") == 0 and L.label_score("roe", "加权平均净资产收益率") == 68
    assert L.label_score("total_liabilities", "Total liabilities and equity") == 0
    assert L.headline_figures([(1, "第四季度\n营业收入\n5\n500")], "annual_report", "2025") == {}
    assert L.headline_figures([(1, "非国际准则\n归属于股东的净利润\n500")], "annual_report", "2025") == {}


def test_interim_tables():
    text = "2025年1-9月\n营业收入\n100.5\n3.2\n300.5\n4.1"
    assert L.headline_figures([(1, text)], "interim_report", "2025年第三季度报告")["revenue"][1] == 300.5
    assert L.headline_figures([(1, "营业收入\n100\n900")], "interim_report", "2025")["revenue"][1] == 900.0


def test_best_candidate():
    got = L.headline_figures([(1, "Revenue\n5,000"), (2, "营业收入\n7,000"), (4, "营业收入\n8,000")], "other", "")
    assert got["revenue"][1:3] == (7000.0, 2)


@pytest.mark.parametrize(
    "text,want",
    [
        ("The return on equity was 12.5%", (12.5, 1)),
        ("年化后扣除非经常性损益后归属于普通股股东的加权平均净资产收益率 15.02％", (15.02, 4)),
        ("总资产收益率(ROAA)和净资产收益率(ROAE)分别为 1.21% 和 14.03%", (14.03, 4)),
        ("净资产收益率(ROAE)和总资产收益率(ROAA)分别为 14.03% 和 1.21%", (14.03, 4)),
        ("总资产收益率 1.2%", None),
        ("nothing", None),
        (None, None),
    ],
)
def test_roe(text, want):
    got = phrases.roe(text)
    assert (got and (got[0], got[2])) == want


def test_attributable_profit():
    assert phrases.attributable_profit("归属于本行股东的净利润 1,483.91 亿元")[0] == 1483.91
    assert phrases.attributable_profit("扣除非经常性损益后归属于本行股东的净利润 1,400 亿元") is None
    assert phrases.attributable_profit("Profit attributable to owners was 12")[0] == 12.0 and phrases.attributable_profit(None) is None


def test_page_sources(spark):
    rows = [("a.html", b"<body>Hello <script>x</script></body>"), ("b.txt", "one\n---\n\n---\ntwo".encode()), ("c.pdf", b"%PDF"), ("d.html", b""), ("e", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = sorted(((r["path"], r["page_number"], r["text"], r["error"]) for r in artifacts.page_sources(files).collect()), key=str)
    assert ("a.html", 1, "Hello", None) in got and ("b.txt", 1, "one", None) in got and ("b.txt", 3, "two", None) in got
    assert [g[3] for g in got if g[0] in ("d.html", "e")] == ["no text", "no text"]
    assert [r["text"] for r in artifacts.page_sources(files.where("path = 'c.pdf'"), lambda b: ["p1", "p2"]).collect()] == ["p1", "p2"]


def test_fact_table_versions(spark, tmp_path):
    t = artifacts.FactTable(spark, f"file://{tmp_path}/facts")
    assert t.current() is None and t.read().count() == 0
    row = ("f1", "d", "c", None, "p", "revenue", "营业收入", "revenue", "period", "2025", 2025, 1.0, "RMB", "CNY", 1.0, 1.0, "CNY", 1, "q", "verified", "headline_metrics", None)
    t.write(spark.createDataFrame([row], t.read().schema))
    first = t.current()
    t.write(t.read().unionByName(spark.createDataFrame([("f2", *row[1:10], 2024, *row[11:])], t.read().schema)))
    assert t.current() != first and sorted(r["fact_id"] for r in t.read().collect()) == ["f1", "f2"]
    with pytest.raises(ValueError, match="f1: fact_id must be there once"):
        t.write(t.read().unionByName(t.read()))
    assert t.read().count() == 2
    assert "PartitionFilters: [isnotnull(fiscal_year" in t.read().where("fiscal_year = 2024")._jdf.queryExecution().toString()


def test_registry_files(spark, tmp_path):
    assert registry.scan_files(spark, f"{tmp_path}/none").count() == 0
    for name, content in (("Acme Bank_2025_annual report_H股.pdf", b"x" * 2000), ("sub/Acme Bank_2025_年报.zip", b"y"), ("sub/copy.html", b"x" * 2000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r["file_name"]: r for r in registry.entries(registry.scan_files(spark, str(tmp_path))).collect()}
    a = rows["Acme Bank_2025_annual report_H股.pdf"] if "Acme Bank_2025_annual report_H股.pdf" in rows else next(r for k, r in rows.items() if k.endswith(".pdf"))
    assert (a["fiscal_year"], a["doc_type"], a["market"]) == (2025, "annual_report", "h_share") and a["warnings"] == ["duplicate_checksum"]
    z = next(r for k, r in rows.items() if k.endswith(".zip"))
    assert z["warnings"] == ["unsupported_suffix", "suspiciously_small_file"] and not z["is_supported"]
    assert registry.summary(registry.entries(registry.scan_files(spark, str(tmp_path)))).collect()[0]["duplicate_checksum_groups"] == 1


def test_headline_records(spark, tmp_path):
    record = {"document_id": "d", "source_path": "p", "revenue": {"value": "1,000", "evidence_page": 3, "evidence_quote": "营业收入 1,000", "citations": []}}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps(record, ensure_ascii=False))
    (tmp_path / "skip.txt").write_text("{}")
    got = artifacts.read_headlines(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["revenue"]["evidence_quote"] == "营业收入 1,000" and got[0]["artifact_path"].endswith("a.json")


def test_import_names():
    assert artifacts.import_name("../x/a.PDF", 1, set(), "T") == "a.PDF"
    assert artifacts.import_name("a.pdf", 1, {"a.pdf"}, "T") == "a_T.pdf" and artifacts.import_name("a.pdf", 1, {"a.pdf", "a_T.pdf", "a_T_2.pdf"}, "T") == "a_T_3.pdf"
    for name, size in (("a.exe", 1), (".pdf", 1), ("a.pdf", 0)):
        with pytest.raises(ValueError):
            artifacts.import_name(name, size, set(), "T")


def test_terms_of_questions(spark):
    from tracefolio.operators import cases

    def reference(q):
        import re

        plain = re.sub(f"({'|'.join(cases.STOP_WORDS)})", " ", re.sub(f"[{re.escape(cases.PUNCTUATION)}]+", " ", q))
        out = []
        for part in (p.strip() for p in re.findall("[一-鿿]{2,}|[A-Za-z][A-Za-z0-9&./ -]{1,}", plain)):
            if re.fullmatch("[一-鿿]+", part) and len(part) > 8:
                cut = [part[i : i + n] for n in (4, 5, 6) for i in range(len(part) - n + 1)]
                out += [w for w in cut if sum(c in cases.STOP_CHARS for c in w) < max(2, len(w) - 1)]
            elif len(part) >= 2:
                out.append(part)
        seen = {}
        for t in out:
            seen.setdefault("".join(t.lower().split()), t)
        return list(seen.values())

    questions = ["招商银行如何管控房地产风险？", "房地产贷款集中度管理情况说明如下文所述", "Revenue growth, revenue  Growth & R&D; 研发", "", "的的的的的的的的的的多少多少"]
    rows = spark.createDataFrame(list(enumerate(questions)), "k int, q string")
    got = {r["k"]: r["t"] for r in rows.select("k", cases.query_terms(F.col("q")).alias("t")).collect()}
    assert [got[k] for k in range(len(questions))] == [reference(q) for q in questions]


def test_unknown_and_repeated_cases_raise(spark):
    from tracefolio.operators import cases

    c = spark.createDataFrame([("a", "smoke"), ("b", "full")], "case_id string, tier string")
    assert [r["case_id"] for r in cases.select_cases(c, case_ids=["a", "b"], tiers=["full"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="zz: unknown"):
        cases.select_cases(c, case_ids=["a", "zz"])
    pages = "array<bigint>"
    m = spark.createDataFrame([("x",), ("x",)], "case_id string").withColumns({k: F.array(F.lit(1)).cast(pages) for k in ("human_confirmed_pages", "human_corrected_pages", "human_supporting_pages")} | {"document_key": F.lit("d"), "manifest_readiness": F.lit("c"), "auto_anchor_status": F.lit("a"), "human_missing_fields": F.array().cast("array<string>")})
    with pytest.raises(ValueError, match="x: duplicate"):
        cases.manifest_cases(m)


def test_answers_are_checked(spark):
    from tracefolio.operators import cases

    schema = "id int, answer string, items array<string>, route string, expected_route string, document_pages array<int>, external_urls array<string>, n_document int, n_external int, required_terms array<string>, required_groups array<array<string>>, forbidden_terms array<string>, min_document int, min_external int, expected_pages array<int>"
    ask = ("document_only", [3, 5, None], [None], 2, 0, ["98,361.30"], [["50.79", "49"]], ["请告知"], 2, 0, [5, 9])
    row = lambda i, answer, items, *more: (i, answer, items, "document_only", *more)
    rows = [row(0, "客户存款98361.30亿元", ["占50.79%"], *ask), row(1, "客户存款（、）DOC_3", None, *ask), row(2, None, None, *ask), row(3, "98,361.30 49", ["请告知"], "mixed", [5, 5], ["u", "u"], 1, 0, *ask[5:])]
    got = {r["id"]: (r["failed_checks"], r["passed"]) for r in cases.quality_checks(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == ([], True) and got[2] == (None, False)
    assert got[1] == (["required_answer_terms", "required_answer_term_groups", "empty_citation_markers", "internal_markers"], False)
    assert got[3] == (["route", "forbidden_answer_terms", "document_citation_count", "duplicate_document_pages", "duplicate_external_urls"], False)


def test_files_are_taken_in_and_indexed_once(spark, tmp_path):
    from tracefolio.sources import artifacts

    root = f"file://{tmp_path}"
    folders = artifacts.ensure_folders(spark, root)
    assert set(folders) == set(artifacts.FOLDERS) and artifacts.ensure_folders(spark, root) == folders
    first = artifacts.import_file(spark, folders["raw"], "../a/report.pdf", b"one", "20250101")
    second = artifacts.import_file(spark, folders["raw"], "report.pdf", b"two", "20250101")
    assert first.endswith("/report.pdf") and second.endswith("/report_20250101.pdf")
    assert sorted(bytes(r["content"]) for r in spark.read.format("binaryFile").load(folders["raw"]).collect()) == [b"one", b"two"]
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert artifacts.index_once(spark, folders["indexes"], "sum", build).count() == 3
    assert built == [1]
    assert artifacts.prewarm(spark, folders["indexes"], "other", lambda: 1 / 0).startswith("ZeroDivisionError") and artifacts.prewarm(spark, folders["indexes"], "sum", build) is None


@pytest.mark.parametrize(
    "text,want",
    [
        ("ROAA 和 ROAE 分 别 为 1.2% 和 13.4%", (13.4, 4)),
        ("ROAE 及 ROAA 分別為 13.4 ％ 及 1.2％", (13.4, 4)),
        ("归属于本行普通股股东的加权平均净资产收益率为 13.44%", (13.44, 2)),
        ("扣除非经常性损益后归属于本行普通股股东的加权平均净资产收益率（年化）为 12.1%", (12.1, 4)),
        ("weighted average return on equity was -3.5 %", (-3.5, 1)),
        ("return on equity: 8% year-on-year growth", (8.0, 1)),
        ("return on equity yoy 8%", None),
        ("ROE rose; net margin" + " x" * 80 + " 9%", None),
        ("净资产收益率 100% 完成", (100.0, 1)),
        ("总资产 5%", None),
    ],
)
def test_return_on_equity_phrases(text, want):
    got = phrases.roe(text)
    assert (got and (got[0], got[2])) == want
    if got and "归属于" in text:
        assert got[1].startswith("归属于")
