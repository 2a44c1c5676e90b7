"""Fiscal periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of a label (lower case, no white space, - for _) that mark a year's report, and those that rule it out.
ANNUAL = ("annualreport", "full-year", "fullyear", "yearended", "fortheyear", "年度报告", "年度報告", "年报", "年報", "全年")
INTERIM = (
    "q1", "q2", "q3", "quarter", "quarterly", "interim", "half-year", "halfyear", "sixmonths", "ninemonths", "threemonths", "1-3", "1-6", "1-9",
    "季度", "一季", "三季", "前三季", "中期", "半年", "半年度", "1-3月", "1-6月", "1-9月", "1至3月", "1至6月", "1至9月",
)


def label_key(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), "(?U)\\s+", ""), F.lit("_"), F.lit("-"))


def has_any(c: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(m)) for m in marks))


def is_annual(c: Column) -> Column:
    """A year's report by its label. The interim marks are substrings, so ``11-30`` in a label makes it interim."""
    key = label_key(c)
    return F.coalesce((key != "") & ~has_any(key, INTERIM) & (has_any(key, ANNUAL) | key.rlike("^(?:19|20)[0-9]{2}年?$")), F.lit(False))


def fiscal_year(c: Column) -> Column:
    """The leftmost 19xx or 20xx."""
    return F.expr("int(null)") if c is None else F.regexp_extract(c, "(20[0-9]{2}|19[0-9]{2})", 1).try_cast("int")


def period_hint(c: Column, halves: tuple[str, ...] = ("半年", "中期", "1-6月"), thirds: tuple[str, ...] = ("三季度", "第三季度", "1-9月")) -> Column:
    """fyYYYY, h1_YYYY or q3_YYYY_ytd by the label's marks (in this order: thirds, halves); null without a 20xx."""
    year = F.nullif(F.regexp_extract(c, "(20[0-9]{2})", 1), F.lit(""))
    return F.when(year.isNull(), F.lit(None)).when(has_any(c, thirds), F.concat(F.lit("q3_"), year, F.lit("_ytd"))).when(has_any(c, halves), F.concat(F.lit("h1_"), year)).otherwise(F.concat(F.lit("fy"), year))


QUARTERS = {"1": "第一", "一": "第一", "2": "第二", "二": "第二", "3": "第三", "三": "第三", "4": "第四", "四": "第四"}


def period_label(period: Column, doc_type: Column, market: Column) -> Column:
    """The standard label of a report's period, with its market; null without a year or for other document types."""
    year = F.nullif(F.regexp_extract(period, "(20[0-9]{2})", 1), F.lit(""))
    suffix = F.when(market == "a_share", F.lit("（A股）")).when(market == "h_share", F.lit("（H股）")).otherwise(F.lit(""))
    found = [F.nullif(F.regexp_extract(period, p, 1), F.lit("")) for p in ("(?i)Q([1-4])", "第([一二三四1-4])季度", "([1-4])季度")]
    token = F.coalesce(*found)
    name = None
    for t, n in QUARTERS.items():
        name = F.when(token == t, F.lit(n)) if name is None else name.when(token == t, F.lit(n))
    interim = F.when(token.isNotNull(), F.concat(year, F.lit("年"), name, F.lit("季度报告"))).when(period.rlike("(?i)H1|半年"), F.concat(year, F.lit("年半年度报告"))).when(F.contains(period, F.lit("中期")), F.concat(year, F.lit("年中期报告")))
    label = F.when(doc_type == "annual_report", F.concat(year, F.lit("年度报告"))).when(doc_type == "interim_report", interim)
    return F.coalesce(F.concat(label, suffix), F.when(doc_type == "earnings_release", F.concat(year, F.lit("业绩公告"))))
