"""The stored vector index: recall against the exact search, exact with all cells, every row in it, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefolio.bindings import retrieval as bindings
from tracefolio.operators import retrieval, vector_index
from tracefolio.operators.vector_index import VectorIndex


def rows(df):
    return sorted((r["query_id"], r["vec_id"], round(r["score"], 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, scale):
    folder = f"/root/testdata/{scale}"
    found, exact = bindings.semantic_indexed(spark, folder), bindings.semantic_topk(spark, folder)
    assert vector_index.recall(found, exact) >= 0.9
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    assert vector_index.index_of(e).lists().select("vec_id").exceptAll(e.select("vec_id")).count() == 0 and vector_index.index_of(e).lists().count() == e.count()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 6000)] + 0.15 * rng.normal(size=(6000, 16))
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)


def test_clusters_are_found_in_few_cells(spark, clustered, tmp_path, monkeypatch):
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(clustered, cells=40)
    centroids, probes = index.centroids()
    assert len(centroids) == 40 and probes <= 6
    asked = clustered.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = retrieval.vector_search(clustered, asked, top_k=6)
    assert vector_index.recall(index.search(asked, top_k=6), exact) >= 0.9
    assert rows(index.search(asked, top_k=6, probes=40)) == rows(exact)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 3)
    assert rows(index.search(asked, top_k=6, probes=40)) == rows(exact)


def test_the_sample_is_bounded_and_every_row_is_in(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE", 500)
    monkeypatch.setattr(vector_index, "CELL_ROWS", 100)
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(clustered)
    assert index.lists().select("vec_id").distinct().count() == 6000 and len(index.centroids()[0]) == 6000 // vector_index.CELL_AIM
    one = index.lists().withColumn("f", F.input_file_name()).groupBy("f").count().agg(F.max("count")).first()[0]
    assert one <= 100


def test_edges(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"
    made = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, -2.0]), (5, [0.0, 1.0])], schema)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/a").build(made)
    assert rows(index.search(asked, top_k=2, probes=9)) == rows(retrieval.vector_search(made, asked, top_k=2))
    empty = VectorIndex(spark, f"file://{tmp_path}/b").build(made.where("false"))
    assert rows(empty.search(asked, top_k=2)) == []


def test_queries_do_not_go_through_the_driver(spark, clustered, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(clustered, cells=40)
    asked = clustered.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.search(asked, top_k=6, probes=40)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the one join that is sent holds a row a cell
    assert plan.count("SortMergeJoin") >= 1 and plan.split("Initial Plan")[0].count("BroadcastHashJoin") <= 1
