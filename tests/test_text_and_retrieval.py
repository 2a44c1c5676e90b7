import math

import pytest
from pyspark.sql import functions as F

from tracefolio.functions import text as T
from tracefolio.operators import evaluation, retrieval
from tracefolio.sources import html


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).collect()[0][0]


@pytest.mark.parametrize(
    "text,tokens",
    [("营业收入 2025年", ["营业", "业收", "收入", "2025", "年"]), ("Foo-bar_Baz 1,234.5% x", ["foo-bar_baz", "1,234.5%", "x"]), ("café", ["caf"]), ("", []), ("a中b", ["a", "中", "b"])],
)
def test_bm25_tokens(spark, text, tokens):
    assert one(spark, text, T.bm25_tokens) == tokens


def test_lines_windows_context(spark):
    text = " a \r\n\n b\x0bc 　\nd"
    assert one(spark, text, T.lines) == ["a", "b", "c", "d"]
    got = spark.createDataFrame([(["a", "b", "c"],), ([],)], "x array<string>").select(T.windows(F.col("x")).alias("w"), T.context(F.col("x"), F.lit(0), 1, 1).alias("c")).collect()
    assert [(w["i"], w["n"], w["text"]) for w in got[0]["w"]] == [(0, 1, "a"), (0, 2, "a b"), (0, 3, "a b c"), (1, 1, "b"), (1, 2, "b c"), (2, 1, "c")]
    assert got[1]["w"] == [] and got[0]["c"] == ["a", "b"]


def test_truncate_and_deltas(spark):
    assert one(spark, "abcdef", lambda c: T.truncate(c, 5)) == "ab..." and one(spark, "abcde", lambda c: T.truncate(c, 5)) == "abcde"
    assert one(spark, "  " + "x" * 40 + " ", T.deltas) == ["x" * 36, "xxxx"] and one(spark, "  ", T.deltas) == []


def test_nfkc(spark):
    assert one(spark, "ＡＢ　c，Ｄ", T.nfkc_compact) == "abc,d" and one(spark, "ＡＢ　c，Ｄ", T.nfkc_letters) == "abcd"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("c", 1, "apple apple pie"), ("c", 2, "apple tart with cream"), ("c", 3, ""), ("d", 4, "apple")], "corpus string, doc_id long, text string")
    q = spark.createDataFrame([(7, "apple apple")], "query_id long, text string")
    got = {(r["corpus"], r["doc_id"]): r["score"] for r in retrieval.bm25_search(docs, q, top_k=5).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    score = lambda tf, dl: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (7 / 3)))
    assert got["c", 1] == pytest.approx(score(2, 3)) and got["c", 2] == pytest.approx(score(1, 4)) and ("c", 3) not in got and ("d", 4) in got


def test_fusion_keeps_ranks_and_first_seen_order(spark):
    rows = [(1, "b", "semantic", 1), (1, "a", "semantic", 2), (1, "a", "bm25", 1), (1, "a", "bm25", 2), (1, "c", "bm25", 3)]
    lists = spark.createDataFrame(rows, "query_id long, page string, source string, rank long")
    got = retrieval.fuse(lists, {"semantic": 1.0, "bm25": 1.0}, k=60).orderBy("rank").collect()
    assert [r["page"] for r in got] == ["a", "b", "c"]
    assert [(s["source"], s["rank"]) for s in got[0]["rank_sources"]] == [("bm25", 1), ("semantic", 2)]
    assert got[2]["score"] == pytest.approx(1 / 63)  # the repeat before it is not closed up
    only = retrieval.fuse(lists, {"semantic": 0.0, "bm25": 1.0}, k=60)
    assert {r["page"] for r in only.collect()} == {"a", "c"}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    got = retrieval.vector_search(v, q, top_k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 6, 3] and got[0]["query_id"] == 9


TRUTH = [  # observed, expected, executed -> overlap, subset
    ([], [1], True, False, False), ([], [1], False, None, None), ([1], [], True, None, None), ([1], [1, 2], True, True, False), ([1, 2], [1, 2], True, True, True), ([3], [1], True, False, False), (None, [1], True, False, False),
]


@pytest.mark.parametrize("observed,expected,executed,overlap,subset", TRUTH)
def test_three_valued(spark, observed, expected, executed, overlap, subset):
    df = spark.createDataFrame([(observed, expected, executed)], "o array<int>, e array<int>, x boolean")
    r = df.select(evaluation.overlap_score(F.col("o"), F.col("e"), F.col("x")), evaluation.subset_score(F.col("o"), F.col("e"), F.col("x"))).collect()[0]
    assert tuple(r) == (overlap, subset)


def test_summary_rates_are_null_without_scores(spark):
    df = spark.createDataFrame([(True, None), (False, None), (None, None)], "a boolean, b boolean")
    got = {r["score"]: (r["scored"], r["passed"], r["rate"]) for r in evaluation.score_summary(df, ["a", "b"]).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, None)}


def test_html():
    page = "<html><head><style>x{}</style></head><body>Out<section>One <b>t</b>wo &amp; three<script>no()</script></section><section> </section><section>Four</section></body></html>"
    assert " ".join(" ".join(html.read(page).nodes).split()) == "Out One t wo & three Four"
    assert html.pages_of(page) == ["One t wo & three", "", "Four"]
    assert html.pages_of("<p>only text</p>") == ["only text"] and html.pages_of(None) == [""]
    assert html.decode("中".encode("gb18030")) == "中" and html.decode("﻿a".encode()) == "a"
