"""A ranking question answered from the facts: parsed, counted, ranked and written as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.functions import questions, units
from tracefolio.operators import facts as ops

REFUSALS = {
    "metric": "当前结构化事实库只支持营业收入、归母净利润、总资产和总负债的 TopK 查询。",
    "year_missing": "请明确查询年份。",
    "year_unsupported": "不支持该年份。",
    "limit_missing": "请明确 TopK 数量，例如“三家公司”或“Top3”。",
}


def read_question(facts: DataFrame, question: str) -> dict:
    df = facts.sparkSession.createDataFrame([(question,)], "q string")
    return df.select(questions.parse(F.col("q")).alias("p")).select("p.*").collect()[0].asDict()


def answer(facts: DataFrame, question: str, documents: list[str] | None = None) -> dict | None:
    """None for a question that is none of ours; else its status, rows, counters and text. At most ``limit`` rows reach the driver."""
    q = read_question(facts, question)
    if not q["recognized"]:
        return None
    if q["refusal"]:
        return {"status": "unsupported", "rows": [], "text": REFUSALS[q["refusal"]], "funnel": None}
    asked = dict(metric_id=q["metric_id"], fiscal_year=q["fiscal_year"], limit=q["limit"], documents=documents)
    funnel = ops.funnel(facts, **asked).collect()[0].asDict()
    shown = units.display_amount(F.col("normalized_value"), F.col("normalized_unit"))
    rows = [r.asDict() for r in ops.top_facts(facts, **asked).select("document_id", "company_name", "normalized_value", "evidence_page", "evidence_quote", shown.alias("shown")).collect()]
    return {"status": funnel["status"], "rows": rows, "text": write(q, rows, funnel), "funnel": funnel}


def write(q: dict, rows: list[dict], funnel: dict) -> str:
    label = ops.METRICS[q["metric_id"]][0]
    lines = [f"{q['fiscal_year']} 年{label} Top{q['limit']}", "", "| 排名 | 公司 | 金额 | 页码 |", "|---|---|---|---|"]
    lines += [f"| {i} | {(r['company_name'] or r['document_id']).replace('|', chr(92) + '|')} | {r['shown']} | {r['evidence_page']} |" for i, r in enumerate(rows, 1)]
    if funnel["note"]:
        lines += ["", funnel["note"]]
    return "\n".join(lines)
