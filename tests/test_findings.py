"""Findings of reviews: cases that went wrong before."""

import os

import duckdb
import pytest
from test_queries import QUERIES, SQL, plain

from tracefolio.operators import bm25_blocks, line_tables, retrieval


def versus_sql(spark, folder, name):
    """The rows of a query and of its SQL over the tables in a folder."""
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}{'/*.parquet' if os.path.isdir(f'{folder}/{file}') else ''}'")
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(str([plain(v) for v in r]) for r in cursor.fetchall())
    return sorted(str([plain(r[c]) for c in names]) for r in QUERIES[name](spark, str(folder)).collect()), want


@pytest.mark.parametrize("name", ["display_amount", "format_value", "coalesce_priority"])
def test_rounding_at_ties(spark, tmp_path, name):
    rows = [(i, p) for i, p in enumerate([640850.0, 641150.0, 100050.0, 123450.0, 41450.0, 41850.0, 1000.005, 1001.015, 999.995, 1234.5])]
    spark.createDataFrame([(2 * i, 1, "F", p) for i, p in rows], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = versus_sql(spark, tmp_path, name)
    assert got == want and len(got) == 10


def pages(spark, folder, numbers, url=lambda k: f"https://a.example/{k}"):
    spark.createDataFrame([(k, url(k), f"<p>{k}</p>") for k in numbers], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_catalogue_of_pages_that_share_a_url(spark, tmp_path):
    pages(spark, tmp_path, range(8), lambda k: f"https://a.example/{k // 3}")
    got, want = versus_sql(spark, tmp_path, "document_catalog")
    assert got == want and len(got) == 8


@pytest.mark.parametrize("name", ["filename_metadata", "registry_entries", "registry_scan"])
def test_page_numbers_in_names_are_no_years(spark, tmp_path, name):
    pages(spark, tmp_path, [5, 1999, 2000, 2001, 2007, 2025, 2099, 2100, 12007, 20071])
    got, want = versus_sql(spark, tmp_path, name)
    assert got == want


def report(k):
    return f"Financial highlights\nRMB million\n2025年\n2024年\nRevenue\n{1000 + k:,}.50\n{900 + k:,}.25\nTotal assets\n{5000 + k:,}\n1"


def test_a_line_is_read_once_and_one_file_keeps_all_tasks_busy(spark, monkeypatch):
    read = []
    monkeypatch.setattr(line_tables, "values", lambda line, f=line_tables.values: read.append(line) or f(line))
    found = line_tables.headline_figures([(1, report(7777))], "annual_report", "2025")
    assert found["revenue"][1] == 8777.5 and len(read) == len(set(read)) <= 10
    docs = spark.createDataFrame([(k, "annual_report", "2025", [(1, report(k))]) for k in range(20)], "doc_id long, doc_type string, fiscal_period string, pages array<struct<page_number:int,text:string>>").coalesce(1)
    out = line_tables.line_table_metrics(docs)
    assert sorted(r["value"] for r in out.where("field = 'revenue'").collect()) == [1000.5 + k for k in range(20)] and out.rdd.getNumPartitions() >= 4


def corpus(spark, rows):
    return spark.createDataFrame(rows, "corpus string, doc_id long, text string")


def test_blocks_give_what_joined_postings_give(spark, monkeypatch):
    words = [f"w{chr(97 + k)}" for k in range(26)]
    rows = [("ab"[k % 2], k, " ".join(words[(k * j * 7 + j) % (5 + k % 21)] for j in range(1 + k % 37))) for k in range(900)]
    rows += [("a", 900 + k, rows[10][2]) for k in range(40)] + [("a", None, "wa wb"), (None, 2000, "wa"), ("b", 2001, None), ("c", 2002, "")]
    asked = spark.createDataFrame([(q, " ".join(words[q % 20 : q % 20 + 1 + q % 6] * (1 + q % 2))) for q in range(300)] + [(900, None), (901, "unknown")], "query_id long, text string")
    monkeypatch.setattr(bm25_blocks, "HELD", 500)
    found = lambda f, d: sorted(((r["corpus"], r["query_id"], r["doc_id"] or -1, r["rank"], round(r["score"], 9)) for r in f(d, asked, top_k=4).collect()), key=str)
    got, plan = found(retrieval.bm25_search, corpus(spark, rows)), retrieval.bm25_search(corpus(spark, rows), asked, top_k=4)._jdf.queryExecution().toString()
    assert got == found(retrieval.joined_search, corpus(spark, rows)) and len(got) == 2 * 300 * 4
    assert "HashAggregate" not in plan and "Join" not in plan  # no posting is joined or moved
    twice = corpus(spark, rows + [("a", 3, "wa wa"), ("b", 5, rows[5][2])])
    assert found(retrieval.bm25_search, twice) == found(retrieval.joined_search, twice)


def test_terms_are_counted_without_moving_postings(spark):
    rows = [("a", k, "one two two") for k in range(5)]
    count = lambda rows: {(r["term"], r["count"]) for r in retrieval.term_frequencies(corpus(spark, rows)).groupBy("corpus", "term").count().collect()}
    assert "Exchange" not in retrieval.term_frequencies(corpus(spark, rows))._jdf.queryExecution().toString()
    assert count(rows) == count([*rows, rows[0]]) == {("one", 5), ("two", 5)}


def test_settings_are_worked_out_once_for_questions_that_are_alike(spark, tmp_path):
    rows = [(q, p * 7 + (q * 3 + p) % 7, 0, n, float(1 + (q * p + n) % 5), float(100 + (q % 4) * p), 0.05, 0.02) for q in range(70) for n, p in enumerate(range(1 + q % 9), 1)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("rrf_grid", "grid_leaderboard", "guard_variants"):
        got, want = versus_sql(spark, tmp_path, name)
        assert got == want, name
    plan = QUERIES["rrf_grid"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [t#" in plan  # questions are counted before they meet the settings


def test_pages_go_to_python_in_small_batches(spark, tmp_path):
    pages(spark, tmp_path, range(5))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("html_raw_text", "html_visible_text", "html_pages"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        assert sorted(r["text"] for r in QUERIES[name](spark, str(tmp_path)).collect()) == list("01234")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_compact_strips_before_it_lowers(spark):
    from pyspark.sql.functions import col

    from tracefolio.functions.text import compact

    texts = ["ΟΔΟΣ ΑΒΓ", "ΟΔΟΣ", "Σ Σ", "Total Σ\n2025", "  a B　C "]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", compact(col("t"))).orderBy("k").collect()]
    assert got == ["".join(t.split()).lower() for t in texts]
