"""Queries that once left out rows: held to their SQL over a larger table, and to cases by hand."""

import glob
import itertools
import os
import re
import unicodedata

import duckdb
import pytest
from test_queries import QUERIES, SQL, plain

from pyspark.sql import functions as F

from tracefolio.functions import questions as Q
from tracefolio.operators import chat

@pytest.mark.parametrize("name", ["hybrid_topk", "evidence_union", "gold_page_coverage", "rescue_report", "live_observations", "artifact_reuse", "citation_dedupe", "primary_fallback"])
def test_whole(name, spark):
    sf = "/root/testdata/sf0.01"  # it has documents without vectors
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(SQL[name])
    names = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == names
    assert sorted(str([plain(r[c]) for c in names]) for r in df.collect()) == sorted(str([plain(r[k]) for k in at]) for r in cursor.fetchall())


def test_quotes_that_begin_alike_stay(spark):
    rows = [(1, 0, k, f"chat-citation-{k + 1}", "document", None, q, None, None) for k, q in enumerate(("Revenue rose by a tenth", "Revenue rose by a half", " Revenue rose by a tenth"))]
    rows += [(1, 0, 3, "chat-citation-4", "document", 7, "x", None, None), (1, 0, 4, "chat-citation-5", "document", 7, "y", None, None), (1, 1, 5, "w1", "external", None, None, "u", "t"), (1, 1, 6, "w2", "external", None, None, "u", "s"), (1, 1, 7, "w3", "external", None, None, "", "s"), (1, 1, 8, "w4", "external", None, None, None, "")]
    c = spark.createDataFrame(rows, "conv_id long, part int, pos long, citation_id string, source_type string, page_number long, quote string, url string, title string")
    assert sorted(r["pos"] for r in chat.dedupe_citations(c, ["conv_id"]).collect()) == [0, 1, 3, 5, 7, 8]


def test_chat_defaults(spark):
    q = lambda *ws: spark.createDataFrame([(w,) for w in ws], "q string")
    got = q("存货周转的变化请解释", "库存为什么偏高", "渠道效率描述一下", "净利润为什么下降", "存 货 变化", None).select(chat.intent_hint(F.col("q"))).collect()
    assert [r[0] for r in got] == ["metric_attribution"] * 3 + [None] * 3
    one = spark.range(1)
    parts = one.select(chat.answer_sections(F.lit("document_only"), F.array(F.lit("d")), F.array(F.lit("e")), F.lit(None).cast("array<string>"), F.lit(True)).alias("p")).first()["p"]
    assert [(p["section_type"], p["title"]) for p in parts] == [("document_evidence", "文档证据"), ("external_evidence", "外部解释"), ("analysis_and_limits", "分析与边界")] and parts[2]["items"] == [chat.EXTERNAL_PARTLY]
    assert one.select(chat.answer_sections(F.lit("unsupported"), F.lit(None).cast("array<string>"), F.array(F.lit("e")), F.array(F.lit("a")), F.lit(False)).alias("p")).first()["p"][0]["section_type"] == "analysis_and_limits"


def parsed(text):
    """SF-18 in plain Python."""
    q = "".join(unicodedata.normalize("NFKC", text or "").split()).lower()
    has = lambda words: any(w in q for w in words)
    number = lambda t: int(t) if t.isdecimal() else Q.VALUE_OF[t]
    metric = next((name for name, words in Q.METRIC_NAMES if has(words)), None)
    scope = has(Q.KB_SCOPE) or has(Q.COMPANY_SCOPE)
    ranked = has(Q.RANK_WORDS) or re.search(f"前([0-9]+|[{Q.NUMERALS}])", q)
    counted = "topk" in q or re.search(rf"top[0-9]+|前([0-9]+|[{Q.NUMERALS}])|[{Q.NUMERALS}0-9]+家", q)
    if not (ranked and (scope or counted and (metric or has(Q.OTHER_METRICS)))):
        return (False, None, None, None, None)
    year = re.search("20[0-9]{2}", q)
    year = int(year[0]) if year else None
    found = next((m[1] for p in ("top([0-9]+)", "前([0-9]+)", "哪([0-9]+)家", "([0-9]+)家", f"([{Q.NUMERALS}])家", f"前([{Q.NUMERALS}])") if (m := re.search(p, q))), None)
    limit = number(found) if found else 1 if metric and scope and has(Q.TOP_ONE) else None
    refusal = "metric" if not metric else "year_missing" if not year else "year_unsupported" if year != Q.SUPPORTED_YEAR else None if limit else "limit_missing"
    return (True, metric, year, limit, refusal)


def test_questions_of_a_table_are_parsed(spark, sf, tmp_path):
    parts = (["当前 KB 里", "which companies", "", "factstore："], ["2025年", " 2024 ", ""], ["营业收入", "Ｎｅｔ Profit", "毛利率", "总资产", "the"], ["最高的三家公司", " top 5", "排名前十名", "largest", "ＴＯＰ３", "哪12家公司排名", "公司排名", "最高"])
    texts = ["".join(p) for p in itertools.product(*parts)] + [None, "", "the largest in 2025"]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(0, 1, "assistant", texts[0]), (0, 2, "system", texts[0])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in (str(tmp_path), sf):
        turns = [(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{folder}/conversations.parquet").where("role = 'user'").collect()]
        got = QUERIES["kb_question_parse"](spark, folder)
        assert got.columns == ["conv_id", "turn", "recognized", "metric_id", "fiscal_year", "limit", "refusal"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((c, t, *parsed(x)) for c, t, x in turns), key=str)
    made = [parsed(t) for t in texts]
    assert {m[4] for m in made if m[0]} == {None, "metric", "year_missing", "year_unsupported", "limit_missing"} and {m[3] for m in made} >= {1, 3, 5, 10, 12}


def test_rows_of_a_long_document_stay(spark, tmp_path):
    """Up to the operator's own caps: 24 rows a label, 120 a document."""
    text = lambda n: "\n".join(f"{word} number {i}" for word in ("license", "token", "a@b") for i in range(n))
    spark.createDataFrame([(1, text(20)), (2, text(30)), (3, text(1))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["row_label"]) for r in QUERIES["table_row_evidence"](spark, str(tmp_path)).collect()]
    assert {k: got.count(k) for k in set(got)} == {(d, label): n for d, n in ((1, 20), (2, 24), (3, 1)) for label in ("licence", "secret", "mail")}
