import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefolio.bindings import documents as bindings
from tracefolio.functions import answers, numbers, questions
from tracefolio.operators import documents as D
from tracefolio.operators import sections as S


@given(words=st.lists(st.sampled_from(["a", "bb.", "ccc", "\n", "dd!"]), max_size=120), size=st.integers(2, 20), overlap=st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_every_word(words, size, overlap):
    text = " ".join(words)
    spans = D.chunk_text(text, size, min(overlap, size - 1))
    assert all(len(text[a:b].split()) <= size for a, b in spans)
    assert all(a < c and b < d and c <= b + 1 for (a, b), (c, d) in zip(spans, spans[1:]))
    covered = set()
    for a, b in spans:
        covered.update(range(a, b))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace()) and (spans == []) == (not text.strip())


BODY = "本集团持续加强信用风险管理，优化资产结构，完善制度流程，提升风险识别与处置能力，资产质量保持稳定，各项监管指标均达到要求，拨备水平充足，抵补能力进一步增强。"


def titles(*pages, company=""):
    return [(p, t) for p, _, t, _, _ in S.sections(list(enumerate(pages, 1)), company)]


def test_sections_by_hand():
    pages = [(1, f"1.2 信用风险管理\n{BODY}\n零售贷款：\n{BODY}"), (2, BODY + BODY), (3, "市场风险\n太短"), (4, f"管理层讨论与分析\n{BODY}")]
    got = S.sections(pages)
    # page 3 gives no section of its own, and too little text for the heading before it
    assert [(p, t) for p, _, t, _, _ in got] == [(1, "1.2 信用风险管理"), (1, "零售贷款"), (2, "零售贷款"), (4, "管理层讨论与分析")]
    assert got[0][4].startswith("1.2 信用风险管理\n本集团") and all(len(x[4]) <= 2200 for x in got) and {x[3] for x in got} == {"risk_asset_quality"}
    # a generic heading gives way to the one below it, and pages after a generic one belong to nothing
    assert titles(f"业务回顾\n公司贷款\n{BODY}") == [(1, "公司贷款")] and titles(f"管理层讨论与分析\n{BODY}", BODY) == [(1, "管理层讨论与分析")]


H = S.Headings()


def test_what_is_a_heading():
    assert H.at("3", "流动性风险") == S.Heading("3. 流动性风险", lines=2) and H.at("2.", "人才管理風險").title == "2. 人才管理風險"
    for line in ("2025年集团业务发展稳健", "123 apples were sold today", "12 月份数据", "第三章", "第三节 贷款", "3.1.2 % of all"):
        assert not H.numbered(line) and (not H.at(line, "") or H.at(line, "").title != line), line
    assert H.at("第三章 管理层讨论与分析", "") and H.at("4 財務風險管理", "") and H.at("3.8.5 践行战略", "") and H.at("3.8.5AI战略", "")
    # plain: only with a long line below that is no heading itself
    assert H.at("前景展望", BODY) == S.Heading("前景展望") and not H.at("前景展望", "短") and not H.at("前景展望", "1.2 风险管理") and not H.at("前景展望", "")
    assert H.at("以下為二零二五年我們主要服務的重點表現：", "") == S.Heading("主要服務的重點表現")
    # with the body in the same line: the line is kept whole, an opener is needed, numbers and lists are none
    line = f"利息收入。截至年末{BODY}"
    assert H.at(line, "") == S.Heading("利息收入", line) and not H.at(f"利息收入。不过{BODY}", "") and not H.at(f"利息2。截至{BODY}", "") and not H.at(f"收入如下。截至{BODY}", "")
    lede = f"展望2026年，{BODY}"
    assert H.at(lede, "") == S.Heading("展望2026年", lede) and not H.at("展望2026年，稳健", "")


def test_frames_are_no_text():
    page = f"某某银行股份有限公司\n2025年度报告（A股）\n43\n82 企業管治報告\n信用风险\n{BODY}\n{BODY}\n44"
    assert S.page_lines(page) == ["信用风险", BODY]
    assert S.page_lines("某某 银行 概览\n一\n某某银行", "某某银行") == ["一"] and S.page_lines("某某 银行 概览") == ["某某 银行 概览"]
    assert titles(page) == [(1, "信用风险")]


def test_several_inline_topics_on_a_page():
    topics = ("銷售及市場推廣開支", "一般及行政開支", "利息收入", "財務成本")
    page = "管理層討論及分析\n" + "\n".join(f"{t}。截至本年末止的{t}同比有所增加，主要由於業務規模擴大以及相關投入增加所致，\n同時反映若干安排帶來的影響，詳情載於財務報表附註並應與其一併閱讀理解。" for t in topics)
    assert titles(page) == [(1, t) for t in topics]
    got = S.sections([(1, page)])
    assert all(x[4].startswith(f"{x[2]}。截至") for x in got) and {x[3] for x in got} == {"financial_summary"}


def test_pages_after_an_inline_topic_and_types():
    first = f"管理層討論及分析\n收入。截至本年末的{BODY}"
    assert titles(first, BODY) == [(1, "收入"), (2, "收入")]
    # a chapter above a plain heading leaves no section of its own; the next page belongs to the last heading
    assert titles(f"第三章 管理层讨论与分析\n消费信贷风险管控\n{BODY}", BODY) == [(1, "消费信贷风险管控"), (2, "消费信贷风险管控")]
    # of no type: left out, unless asked for
    plain = "1.1 天气\n" + "今天天气晴朗适合出门散步" * 8
    assert titles(plain) == [] and len(S.sections([(1, plain)], keep_other=True)) == 1
    assert S.sections([(1, "經營資料\n" + "月活躍賬戶數與訂閱會員數均有增長，用戶使用時長亦同比上升。" * 3)])[0][3] == "product_user_metrics"


@pytest.mark.parametrize(
    "page,quote,found",
    [
        ("Revenue (RMB million) 1,234.5 for the year", "Revenue RMB million 1234.5", "Revenue RMB million 1234.5"),
        ("营业收入：人民币1,234百万元，同比增长。", "营业收入人民币1234百万元", "营业收入人民币1234百万元"),
        ("营业收入：\n人民币1,234\n百万元", "营业收入 人民币 1234 百万元", "营业收入 人民币 1234 百万元"),
        ("a\n總收入一二三四五六七八九十\nb", "其中總收入一二三四五六七八九十有所增長", "總收入一二三四五六七八九十"),
        ("...\n--\nthe net margin was 10", "(the net margin was 10)", "(the net margin was 10)"),
    ],
)
def test_quotes_without_punctuation(page, quote, found):
    assert D.find_quote(page, quote) == found


@pytest.mark.parametrize(
    "page,quote,found",
    [
        ("Revenue grew by\n12 percent in 2025", "revenue grew by 12 percent", "revenue grew by 12 percent"),
        ("alpha beta gamma\ndelta", "nothing ... alpha beta gamma", "alpha beta gamma"),
        ("the margin was 10 percent\nother", "we found that the margin was 10 percent", "the margin was 10 percent"),
        ("first clause here now\nx\nsecond clause there", "first clause here now and more words beyond；second clause there", "first clause here now first clause here now x second clause there"),  # windows in order: the third one already has the second clause
        ("unrelated", "short", None),
        (None, "quote of something", None),
    ],
)
def test_quotes(page, quote, found):
    assert D.find_quote(page, quote) == found


@pytest.mark.parametrize(
    "line,values",
    [("Revenue 1,234.5 (67) 8", [1234.5, -67.0, 8.0]), ("(3)", []), ("12", []), ("123", [123.0]), ("2025年12月31日 500", [500.0]), ("100 下降 5", [100.0]), ("下降 5", []), ("", []), (None, [])],
)
def test_line_values(line, values):
    assert numbers.values(line) == values


def test_line_years():
    assert numbers.years("2025年 2024年") == [2025, 2024] and numbers.years("二零二五年") == [2025] and numbers.years("九九九九年") == []


@pytest.mark.parametrize(
    "text,clean",
    [
        ("Revenue [Chunk 12] rose DOC_3 (、 )", "Revenue rose"),
        ("1,234 RMB million in fy2025", "1,234 RMB million，即 12.34 亿元 in 2025年"),
        ("500（单位：港币百万元）", "500 港币百万元，即 5 亿港元"),
        ("500 人民币百万元，即 5 亿元", "500 人民币百万元，即 5 亿元"),
        ("q3_2025_ytd and h1_2024 score=0.53", "2025年前三季度累计 and 2024年上半年"),
        ("（第 3 页 fy2025 period）text", "text"),
        ("a\r\n\n\n\n b |", "a\n\nb"),
    ],
)
def test_sanitize(text, clean):
    assert answers.sanitize(text) == clean


@pytest.mark.parametrize(
    "question,want",
    [
        ("当前 KB 里 2025 年营业收入最高的三家公司", (True, "revenue", 2025, 3, None)),
        ("Which company has the highest total assets in 2025", (False, None, None, None, None)),
        ("which companies are top 3 by Net Profit in 2025?", (True, "net_profit_attributable", 2025, 3, None)),
        ("当前KB 2024年总资产 top5", (True, "total_assets", 2024, 5, "year_unsupported")),
        ("KB 总负债排名前十名", (True, "total_liabilities", None, 10, "year_missing")),
        ("知识 KB 2025 毛利率最高", (True, None, 2025, None, "metric")),
        ("当前KB 2025年收入排名", (True, "revenue", 2025, None, "limit_missing")),
        ("当前KB 2025年收入最高的公司", (True, "revenue", 2025, 1, None)),
        ("What was revenue in 2025?", (False, None, None, None, None)),
        (None, (False, None, None, None, None)),
    ],
)
def test_rank_questions(spark, question, want):
    got = spark.createDataFrame([(question,)], "q string").select(questions.parse(F.col("q")).alias("p")).select("p.*").collect()[0]
    assert tuple(got) == want


def test_citations_equal_all_pairs(spark, sf):
    """Every tier, with quotes that have no three long words; then the query's own tables."""
    quotes = [(1, "We do as we say"), (2, "资产质量保持稳定"), (3, "go on … as it was then"), (4, "we had a good run; it was all as set out"), (5, "x x x the sum of it all is as we had it in May x x x"), (6, "ΤΕΛΟΣ ΣΑΣ"), (7, None), (8, "a b"), (1, "ﬁnd it here")]
    pages = [(1, "It is so: we do\nas we say."), (2, "各项监管指标，资产质量\n保持稳定。"), (3, "now as it was then, too"), (4, "Oh, we had a good run\n-\nand it was all as set out here"), (5, "a\nthe sum of it all is\nas we had it in May\nb"), (6, "ΤΕΛΟΣ ΣΑΣ\nΚΑΙ"), (7, None), (8, "a b find it here")]
    got = D.cite(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(pages, "doc_id long, text string")).collect()
    want = sorted((i, d, f) for i, q in quotes for d, t in pages if (f := D.find_quote(t, q)))
    assert sorted(map(tuple, got)) == want and {i for i, *_ in want} == {1, 2, 3, 4, 5, 6}
    quotes = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, d, f) for d, t in pages for i, q in quotes if (f := D.find_quote(t, q)))
    assert sorted(map(tuple, bindings.citation_fuzzy(spark, sf).collect())) == want


@pytest.mark.parametrize(
    "text,clean",
    [
        ("see (Chunk 3) and [chunk a b] (DOC_1、WEB_2)", "see and"),
        ("source = annual_1 ok, score=-0.5.", "ok,."),
        ("resource=fine and x = 3", "resource=fine and x = 3"),
        ("存款16日均余额与 16 占比，共16个", "存款日均余额与占比，共16个"),
        ("profit (page 12, table row) rose (page 12) in FY2025", "profit rose (page 12) in 2025年"),
        ("-1,250.5 USD million；3 million hkd", "-1,250.5 USD million，即 -12.51 亿美元；3 HKD million，即 0.03 亿港元"),
        ("7（單位：人民幣百萬元）", "7 百万元，即 0.07 亿元"),
        ("如下： - 一。 * 二", "如下：\n- 一。\n* 二"),
        ("a ( ( ) ) b ，c", "a b，c"),
        ("x |\n\n\n\n| y", "x\n\ny"),
    ],
)
def test_sanitize_tokens(text, clean):
    assert answers.sanitize(text) == clean
