"""The stored text index: equal to the search without it, with what it reads counted; kept between searches; whole after a build that was broken off."""

import random

import pytest
from pyspark.sql import functions as F

from tracefolio.operators import block_index, retrieval
from tracefolio.operators.block_index import TextIndex, index_of


def rows(df):
    return sorted((r["corpus"], r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    common, rare = [f"c{k}" for k in range(20)], [f"r{k}" for k in range(3000)]
    # documents of one time speak of the same things, as pages of a filing do
    texts = [" ".join(r.choices(common, k=20) + r.choices(rare[k // 2 : k // 2 + 15], k=10)) for k in range(5000)]
    made = [("big" if k % 5 else f"s{k % 3}", k, t) for k, t in enumerate(texts)] + [("big", 9001, ""), ("big", 9002, None), ("none", 9003, "")]
    return spark.createDataFrame(made, "corpus string, doc_id long, text string").repartition(6)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}").build(docs)


QUESTIONS = [(1, "r100 r101 c1"), (2, "r1500 r1503 c1 c2 c3"), (3, "c1 c2 C2"), (4, "r7 r2400"), (5, "unknown words"), (6, ""), (7, None)]


@pytest.mark.parametrize("everything", [False, True])
def test_equals_the_search_without_an_index(spark, docs, index, everything):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    plain = docs.withColumn("corpus", F.lit("all")) if everything else docs
    for k in (1, 50):
        assert rows(index.search(asked, top_k=k, everything=everything)) == rows(retrieval.bm25_search(plain, asked, top_k=k))
    other = {"k1": 0.9, "b": 0.4}
    assert rows(index.search(asked, top_k=3, everything=everything, **other)) == rows(retrieval.bm25_search(plain, asked, top_k=3, **other))


def test_only_blocks_that_can_reach_the_best_are_read(spark, index):
    asked = spark.createDataFrame(QUESTIONS[:2], "query_id long, text string")
    most, weights = index.bounds(asked, everything=True)
    held = most.select("query_id", "block").distinct().count()
    chosen = index.chosen(most, weights, top_k=3, everything=True)
    found = index.candidates(chosen, weights, everything=True)
    assert held > 150 and chosen.count() <= held / 8 and found.count() < 64 * chosen.count() / 2
    # terms that are left for last are read for candidates alone
    assert any(r["last"] for r in chosen.collect())


def test_files_of_other_terms_are_not_opened(spark, index):
    rows_ = index._of_terms(spark.createDataFrame([("r100", 0)], "term string, shard int").withColumn("shard", block_index.shard(F.col("term"))), "block", "n")
    scan = next(x for x in rows_._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n") if "Scan parquet" in x and "PartitionFilters" in x)
    assert "shard" in scan.split("PartitionFilters")[1].split("\n")[0] and "postings" not in scan.split("ReadSchema")[1]


def test_it_is_built_once_and_anew_for_other_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([("c", 1, "apple pie"), ("c", 2, "apple tart")], "corpus string, doc_id long, text string").write.parquet(path)
    built = []
    build = TextIndex.build
    monkeypatch.setattr(TextIndex, "build", lambda self, d: built.append(1) or build(self, d))
    asked = spark.createDataFrame([(1, "pie")], "query_id long, text string")
    for _ in range(2):
        assert [x[2] for x in rows(index_of(spark.read.parquet(path), f"file://{tmp_path}").search(asked, top_k=5))] == [1]
    assert len(built) == 1
    assert rows(index_of(spark.read.parquet(path).where("doc_id = 2"), f"file://{tmp_path}").search(asked, top_k=5)) == []
    spark.createDataFrame([("c", 3, "pie")], "corpus string, doc_id long, text string").write.mode("append").parquet(path)
    assert [x[2] for x in rows(index_of(spark.read.parquet(path), f"file://{tmp_path}").search(asked, top_k=5))] == [1, 3]
    assert len(built) == 3


def test_a_build_that_is_broken_off(spark, index, monkeypatch):
    asked = spark.createDataFrame(QUESTIONS[:1], "query_id long, text string")
    before = rows(index.search(asked, top_k=2))
    with monkeypatch.context() as m:
        m.setattr(block_index, "block_rows", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.build(spark.createDataFrame([("c", 1, "r100")], "corpus string, doc_id long, text string"))
    assert rows(index.search(asked, top_k=2)) == before


def test_an_empty_table(spark, tmp_path):
    empty = TextIndex(spark, f"file://{tmp_path}/e").build(spark.createDataFrame([], "corpus string, doc_id long, text string"))
    assert rows(empty.search(spark.createDataFrame(QUESTIONS, "query_id long, text string"), top_k=3)) == []


def test_both_ways_are_equal(spark, index, monkeypatch):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    monkeypatch.setattr(block_index, "BROAD", 0)
    broad = rows(index.search(asked, top_k=9))
    monkeypatch.setattr(block_index, "BROAD", 1e9)
    assert rows(index.search(asked, top_k=9)) == broad and broad


def test_broad_questions_move_no_block_and_a_build_no_posting(spark, docs, index, monkeypatch):
    plan = block_index.block_rows(index.read("forward"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr(TextIndex, "bounds", lambda *a, **k: 1 / 0)
    asked = spark.createDataFrame([(k, f"c{k} c{k + 1} c{k + 2}") for k in range(10)], "query_id long, text string")
    assert rows(index.search(asked, top_k=2)) == rows(retrieval.bm25_search(docs, asked, top_k=2))


def test_blocks_that_go_on_in_the_next_batch(spark, docs, index, monkeypatch):
    whole = lambda df: sorted(str((r["term"], r["corpus"], r["block"], r["n"], sorted(map(tuple, r["peaks"])), [tuple(p) for p in r["postings"]])) for r in df.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    few = whole(block_index.block_rows(index.read("forward").coalesce(1)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    assert few == whole(index.read("blocks")) and len(few) > 1000
