"""Headline figures from tables that a parser left as lines: a label on one to four lines, then a value a line."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, wraps

from pyspark.sql import DataFrame

from tracefolio.functions.numbers import CHANGES, values, years
from tracefolio.operators.documents import each, split_lines

PUNCTUATION = re.compile(r"[\s,.;:，。；：()\[\]{}<>％%/\\\-—_]")


#: Answers that are kept for lines and labels, and how long these may be.
KEPT, KEPT_LENGTH = 1 << 14, 120


def kept(f: Callable) -> Callable:
    """``f``, whose last argument is a text; answers for short ones are kept: labels come again in every report, and each line is asked for by several labels."""
    again = lru_cache(KEPT)(f)
    return wraps(f)(lambda *args: again(*args) if len(args[-1]) <= KEPT_LENGTH else f(*args))


@kept
def key(text: str) -> str:
    return PUNCTUATION.sub("", unicodedata.normalize("NFKC", text)).lower()


@dataclass(frozen=True)
class Label:
    """What names a field: score if every group has a word in the label. The first rule that fits decides; a score of zero rules the label out."""

    score: int
    groups: tuple[tuple[str, ...], ...]
    whole: bool = False

    def fits(self, k: str) -> bool:
        return all(any(k == w if self.whole else w in k for w in g) for g in self.groups)


# Labels of the five fields.
LABELS: dict[str, tuple[Label, ...]] = {
    "revenue": (
        Label(0, (("占营业收入", "佔營業收入", "revenuepercentage", "营业收入利息收入", "營業收入利息收入"),)),
        Label(70, (("营业收入", "營業收入"),)),
        Label(64, (("收入", "收益"),), whole=True),
        Label(55, (("总收入", "總收入", "revenue"),)),
    ),
    "net_profit": (
        Label(0, (("非国际", "非國際", "nonifrs", "nongaap"),)),
        Label(35, (("非经常性", "非經常性", "nonrecurring"),)),
        Label(78, (("归属于", "歸屬於"), ("股东", "股東"), ("净利润", "淨利潤"))),
        Label(78, (("权益持有人", "權益持有人"), ("应占", "應佔"), ("盈利", "利润", "利潤"))),
        Label(70, (("profitattributable", "netincomeattributable"),)),
    ),
    "total_assets": (Label(78, (("总资产", "總資產", "资产总计", "資產總計", "资产合计", "資產合計", "totalassets", "assetstotal"),)),),
    "total_liabilities": (
        Label(0, (("totalliabilitiesandequity", "totalliabilitiesandshareholdersequity", "liabilitiesandequity"),)),
        Label(78, (("总负债", "總負債", "负债合计", "負債合計", "负债总计", "負債總計", "totalliabilities", "liabilitiestotal"),)),
    ),
    "roe": (
        Label(0, (("roaa", "returnonassets", "总资产收益率", "總資產收益率"),)),
        Label(60, (("roe", "returnonequity", "净资产收益率", "淨資產收益率"),)),
    ),
}
ROE_EXTRAS = ((10, ("普通股", "commonshare")), (8, ("加权平均", "加權平均", "weightedaverage")), (6, ("年化", "annualized")), (-3, ("非经常性", "非經常性", "nonrecurring")))
HIGHLIGHTS = ("主要会计数据", "主要會計數據", "主要财务数据", "主要財務數據", "主要财务指标", "主要財務指標", "会计数据和财务指标", "會計數據和財務指標")
SUMMARIES = ("财务比率", "財務比率", "经营业绩", "經營業績", "经营概要", "業績摘要", "业绩摘要", "financialhighlights", "financialsummary", "selectedfinancial", "balancesheet", "statementoffinancialposition", "资产负债表", "資產負債表", "财务状况表", "財務狀況表")
QUARTERLY = ("按季度披露", "季度披露", "第四季度", "三个月", "三個月", "环比", "環比")
STATEMENTS = ("财务报表", "財務報表", "合并利润表", "合併利潤表", "综合损益表", "綜合損益表", "资产负债表", "資產負債表", "现金流量表", "現金流量表")
HEADERS = ("2025年", "2024年", "2023年", "同比增减", "比上年", "上年末", "报告期", "財務比率", "财务比率")
INTERIM = ("16月", "13月", "19月", "q1", "q2", "q3")
UNIT = re.compile(r"((?:人民[币幣]|港[币幣元])(?:百万|百萬|千|万|萬|亿|億)元[^;\n，。)]*|(?:RMB|HKD|USD)\s+million|million\s+(?:RMB|HKD|USD))", re.I)


def has(k: str, words: tuple[str, ...]) -> bool:
    return any(w in k for w in words)


FOOTNOTE, WORDS, SENTENCES = re.compile(r"[(（]?\d{1,2}[)）]?"), re.compile("[一-鿿A-Za-z]"), re.compile("[。；;]|报告期内|實現|实现")
figures = kept(lambda line: tuple(values(line)))


@kept
def footnote(line: str) -> bool:
    return bool(FOOTNOTE.fullmatch(line.strip()))


@kept
def changed(line: str) -> bool:
    return unicodedata.normalize("NFKC", line).strip().lower().startswith(CHANGES)


@kept
def numeric(line: str) -> bool:
    return footnote(line) or bool(figures(line)) and not WORDS.search(line)


@kept
def label_score(field: str, label: str) -> int:
    if len(label) > 90 or SENTENCES.search(label):
        return 0
    k = key(label)
    score = next((r.score for r in LABELS[field] if r.fits(k)), 0)
    return score + sum(n for n, words in ROE_EXTRAS if has(k, words)) if score and field == "roe" else score


def find_label(lines: list[str], at: int, field: str) -> tuple[str, int, int] | None:
    """The best label that begins at a line: text, its last line, score. The longest of equally good ones."""
    if numeric(lines[at]):
        return None
    best = None
    for n in range(1, 5):
        if at + n > len(lines) or n > 1 and (numeric(lines[at + n - 1]) or has(key(lines[at + n - 1]), HEADERS)):
            break
        text = " ".join(lines[at : at + n])
        score = label_score(field, text)
        if score and (best is None or score >= best[2]):
            best = (text, at + n - 1, score)
    return best


@kept
def fresh(line: str) -> bool:
    """A row's label begins here, or a heading."""
    return not numeric(line) and not changed(line) and (has(key(line), HEADERS) or any(label_score(f, line) for f in LABELS) or bool(WORDS.search(line)) and not figures(line))


def row_values(lines: list[str], after: int) -> list[tuple[float, str]]:
    """Values on the lines below a label, up to the next label."""
    out: list[tuple[float, str]] = []
    for line in lines[after + 1 : after + 13]:
        if footnote(line):
            continue
        found = figures(line)
        if out and fresh(line):
            break
        if found:
            out += [(v, line) for v in found]
        elif out and key(line) not in ("", "注", "note", "notes") and not changed(line):
            break
    return out


def choose(row: list[tuple[float, str]], context: list[str], doc_type: str, period: str) -> tuple[float, str] | None:
    """The report's own column: the last one of an interim table (the third of four that alternate with ratios), a year's report's by the year in its headings, else the first."""
    if not row:
        return None
    if doc_type == "interim_report" or has(key(" ".join([*context, period])), INTERIM):
        if len(row) >= 4 and abs(row[1][0]) < 200 and abs(row[3][0]) < 200:
            return row[2]
        if len(row) >= 2:
            return row[-1]
    if doc_type == "annual_report":
        heads = [y for line in context for y in years(line)]
        target = next(iter(years(period)), None)
        if heads and target is not None:
            mine = heads[-len(row) :] if len(heads) > len(row) else heads
            if target in mine:
                return row[mine.index(target)]
        if len(heads) > 1:
            return None
    return row[0]


def candidates(page: int, text: str, doc_type: str, period: str) -> list[tuple[str, float, int, str, str, str | None, int]]:
    """(field, value, page, label, line of the value, unit, score)."""
    lines = [unicodedata.normalize("NFKC", x) for x in split_lines(text)]
    keys = [key(x) for x in lines]
    out = []
    for at in range(len(lines)):
        if numeric(lines[at]):  # no label begins with a value
            continue
        around = "".join(keys[max(0, at - 60) : at + 1])
        if doc_type == "annual_report" and has(around, QUARTERLY):
            continue
        for field in LABELS:
            sheet = field in ("total_assets", "total_liabilities") and has(around, ("balancesheet", "statementoffinancialposition"))
            if not sheet and has(around, STATEMENTS) and not has(around, HIGHLIGHTS):
                continue
            label = find_label(lines, at, field)
            if not label or field == "net_profit" and has("".join(keys[max(0, at - 3) : at + 1]), ("非国际", "非國際", "nonifrs", "nongaap")):
                continue
            row = row_values(lines, label[1])
            got = choose(row, lines[max(0, at - 80) : label[1] + 1], doc_type, period)
            if got is None or not (0 < got[0] < 100 if field == "roe" else abs(got[0]) >= 1):
                continue
            score = label[2] + (16 if has(around, HIGHLIGHTS) else 6 if has(around, SUMMARIES) else 0) + (4 if has(around, ("人民币百万元", "人民幣百萬元", "rmbmillion")) else 0)
            score += 4 if doc_type == "interim_report" and len(row) >= 2 and got == row[-1] else 0
            unit = next((m[1].strip(" （()，,") for line in lines[max(0, at - 35) : at + 1][::-1] if (m := UNIT.search(line))), None)
            out.append((field, got[0], page, label[0], got[1], unit, score))
    return out


def headline_figures(pages: list[tuple[int, str]], doc_type: str = "annual_report", period: str = "") -> dict[str, tuple]:
    """The best candidate of each field: highest score, then the shorter label, then the earlier page."""
    every = [c for number, text in pages for c in candidates(number, text, doc_type, period)]
    best: dict[str, tuple] = {}
    for c in every:
        if c[0] not in best or (c[6], -len(c[3]), -c[2]) > (best[c[0]][6], -len(best[c[0]][3]), -best[c[0]][2]):
            best[c[0]] = c
    return best


def line_table_metrics(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, doc_type, fiscal_period, pages) to a row for each field found. Reading is dearer than moving: documents of a few large files are dealt over all tasks."""

    def make(r: tuple) -> list[tuple]:
        found = headline_figures(sorted((p["page_number"], p["text"]) for p in r[3] or []), r[1] or "", r[2] or "")
        return [(r[0], f, c[1], c[2], "; ".join(x for x in (c[5], f"{c[3]} {c[4]}") if x), c[5], c[6]) for f, c in found.items()]

    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = [doc_id, "doc_type", "fiscal_period", "pages"]
    return each(documents.select(*columns).repartition(parts), columns, make, f"{doc_id} long, field string, value double, page_number long, quote string, unit string, score long")
