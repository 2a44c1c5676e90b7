"""Ranking questions to the fact store, read from a column of questions in native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefolio.functions.periods import has_any
from tracefolio.functions.text import nfkc_compact

SUPPORTED_YEAR = 2025
# Fixed values, compacted: what names a scope, a rank, an unsupported metric, and the metrics' names in the order in which they are tried.
KB_SCOPE = ("当前kb", "kb", "currentkb", "current-kb", "currentknowledgebase", "事实库", "事實庫", "结构化事实库", "結構化事實庫", "factstore", "factdatabase", "factdb", "knowledgebase")
COMPANY_SCOPE = (
    "哪家公司", "哪些公司", "哪几家公司", "哪三家公司", "哪家企业", "哪些企业", "哪几家企业", "哪三家企业", "哪个公司", "哪些个公司", "几家公司", "三家公司", "3家公司", "几家企业", "三家企业", "3家企业",
    "公司排名", "企业排名", "whichcompanies", "whichcompany", "topcompanies", "topcompany",
)
RANK_WORDS = ("最高", "最大", "最多", "top", "topk", "排名", "排行")
TOP_ONE = ("最高", "最大", "最多", "highest", "largest", "biggest")
OTHER_METRICS = ("经营现金流", "经营活动现金流", "经营活动产生的现金流量净额", "经营活动现金流净额", "operatingcashflow", "cashflowfromoperations", "netcashgeneratedfromoperatingactivities", "roe", "roae", "grossmargin", "毛利率", "资本开支", "capex")
METRIC_NAMES = (
    ("net_profit_attributable", ("net_profit", "netprofit", "netprofitattributable", "profitattributable", "attributablenetprofit", "归母净利润", "归属于母公司股东的净利润", "归属于上市公司股东的净利润", "归属于本行股东的净利润", "歸母淨利潤", "歸屬於母公司股東的淨利潤", "歸屬於上市公司股東的淨利潤", "歸屬於本行股東的淨利潤")),
    ("total_liabilities", ("total_liabilities", "totalliabilities", "liabilitiestotal", "总负债", "負債總額", "總負債")),
    ("total_assets", ("total_assets", "totalassets", "assetstotal", "总资产", "資產總額", "總資產")),
    ("revenue", ("revenue", "营业收入", "營業收入", "收入")),
)
NUMERALS = "一二两三四五六七八九十"
VALUE_OF = {c: n for c, n in zip(NUMERALS, (1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10))}


def _number(c: Column) -> Column:
    spelled = reduce(lambda out, kv: out.when(c == kv[0], F.lit(kv[1])), list(VALUE_OF.items())[1:], F.when(c == "一", F.lit(1)))
    return F.coalesce(c.try_cast("int"), spelled)


def limit_of(q: Column) -> Column:
    """The number of rows asked for: the first pattern that is there."""
    patterns = (r"top(\d+)", r"前(\d+)", r"哪(\d+)家", r"(\d+)家", f"([{NUMERALS}])家", f"前([{NUMERALS}])")
    return F.coalesce(*(_number(F.nullif(F.regexp_extract(q, p, 1), F.lit(""))) for p in patterns))


def parse(question: Column) -> Column:
    """struct<recognized, metric_id, fiscal_year, limit, refusal>. refusal: null, metric, year_missing, year_unsupported or limit_missing, in this order."""
    q = nfkc_compact(F.coalesce(question, F.lit("")))
    metric = reduce(lambda out, m: out.when(has_any(q, m[1]), F.lit(m[0])), METRIC_NAMES[1:], F.when(has_any(q, METRIC_NAMES[0][1]), F.lit(METRIC_NAMES[0][0])))
    scope = has_any(q, KB_SCOPE) | has_any(q, COMPANY_SCOPE)
    ranked = has_any(q, RANK_WORDS) | q.rlike(f"前(?:[0-9]+|[{NUMERALS}])")
    counted = F.contains(q, F.lit("topk")) | q.rlike(rf"top\d+|前(?:[0-9]+|[{NUMERALS}])|[{NUMERALS}0-9]+家")
    known = metric.isNotNull() | has_any(q, OTHER_METRICS)
    recognized = ranked & (scope | (counted & known))
    year = F.nullif(F.regexp_extract(q, "(20[0-9]{2})", 1), F.lit("")).cast("int")
    limit = F.coalesce(limit_of(q), F.when(metric.isNotNull() & scope & has_any(q, TOP_ONE), F.lit(1)))
    refusal = F.when(metric.isNull(), "metric").when(year.isNull(), "year_missing").when(year != SUPPORTED_YEAR, "year_unsupported").when(limit.isNull(), "limit_missing")
    only = lambda c: F.when(recognized, c)
    return F.struct(recognized.alias("recognized"), only(metric).alias("metric_id"), only(year).alias("fiscal_year"), only(limit).alias("limit"), only(refusal).alias("refusal"))
