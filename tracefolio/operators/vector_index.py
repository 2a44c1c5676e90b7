"""A stored vector index: inverted lists by centroid.

``build`` trains centroids by Lloyd's rounds on a sample of at most SAMPLE unit vectors (the only bound on rows here: every vector is in the index), and writes
each vector, with its unit form, into the folder of its nearest centroid; a cell with more than CELL_ROWS rows is spread over several files. How many cells a search opens is calibrated: the fewest that
find TARGET of the true neighbours of CALIBRATE vectors of the sample among the sample. ``search`` ranks the
centroids for each query, opens the folders of the ``probes`` nearest ones, and ranks their vectors by exact cosine. With ``probes`` of all cells it is exact.

Ties go to the lower vec_id, as in ``retrieval.vector_search``; null and zero vectors are in no list, and zero queries find what the exact search finds for them, vectors at 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.operators.retrieval import _unit, ranked
from tracefolio.session import content_key, settle, shared_dir
from tracefolio.sources.artifacts import Versions

SAMPLE, ROUNDS, SEED = 65_536, 8, 7
#: Vectors a cell aimed at, the most cells, and rows of a cell in one file.
CELL_AIM, MOST_CELLS, CELL_ROWS = 256, 4096, 100_000
#: Share of neighbours that the calibrated number of probes finds, how many vectors it is tried with, and neighbours of each.
TARGET, CALIBRATE, NEIGHBOURS = 0.97, 256, 6
#: Queries that meet a cell's vectors at once.
QUERY_BLOCK = 2_000


def train(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors. An empty cell takes the vector that lies farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = vectors[np.sort(rng.choice(len(vectors), cells, replace=False))].copy()
    for _ in range(rounds):
        near = vectors @ c.T
        of = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, vectors)
        empty = np.flatnonzero(np.bincount(of, minlength=cells) == 0)
        if len(empty):
            sums[empty] = vectors[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1)
        c = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], c)
    return c


def calibrated(vectors: np.ndarray, centroids: np.ndarray) -> int:
    """The fewest cells in which TARGET of the neighbours lie."""
    asked = vectors[np.linspace(0, len(vectors) - 1, min(CALIBRATE, len(vectors))).astype(int)]
    scores = asked @ vectors.T
    k = min(NEIGHBOURS, len(vectors))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    of = (vectors @ centroids.T).argmax(axis=1)
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), axis=1)
    seen = np.sort(np.take_along_axis(place, of[best], axis=1).ravel())
    return int(seen[min(len(seen) - 1, int(np.ceil(TARGET * len(seen))))]) + 1


class VectorIndex:
    """The index in a folder; it is there from when its pointer is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def build(self, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """Index (vec_id, embedding)."""
        n = vectors.where("embedding is not null").count()
        share = min(1.0, 1.2 * SAMPLE / max(n, 1))
        drawn = vectors.where("embedding is not null").select("embedding")
        taken = (drawn if share >= 1 else drawn.sample(share, seed=SEED)).limit(SAMPLE).collect()
        unit = _unit([r[0] for r in taken]) if taken else np.zeros((0, 1))
        unit = unit[np.linalg.norm(unit, axis=1) > 0]
        cells = min(cells or max(1, min(MOST_CELLS, n // CELL_AIM)), len(unit))
        centroids = train(unit, cells) if cells else unit
        version = self.versions.new()
        at = f"{self.versions.folder}/{version}"
        probes = calibrated(unit, centroids) if cells else 1
        self.spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centroids)], "cell int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{at}/centroids")
        placed = self._placed(vectors.select("vec_id", "embedding").where("embedding is not null"), centroids)
        # a cell of any size, in files of bounded size
        counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("files", F.expr(f"1 + n div {CELL_ROWS}")).select("cell", "files")
        spread = placed.join(F.broadcast(counts), "cell").withColumn("file", F.pmod(F.xxhash64("vec_id"), F.col("files")))  # as many rows as there are cells, MOST_CELLS at most
        spread.repartition("cell", "file").select("vec_id", "unit", "cell").write.partitionBy("cell").option("maxRecordsPerFile", CELL_ROWS).parquet(f"{at}/lists")
        self.versions.switch(version)
        return self

    def _placed(self, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
        """(cell, vec_id, unit)."""
        import pyarrow as pa

        sent = self.spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator) -> Iterator:
            c = sent.value
            for b in batches:
                m = np.array(b.column(1).to_pylist(), float)
                norms = np.linalg.norm(m, axis=1) if len(m) else np.zeros(0)
                live = np.flatnonzero(norms > 0)
                u = m[live] / norms[live][:, None] if len(live) else np.zeros((0, 1))
                of = (u @ c.T).argmax(axis=1) if len(live) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), b.column(0).take(pa.array(live)), pa.array(list(u), pa.list_(pa.float64()))], names=["cell", "vec_id", "unit"])

        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "cell int, vec_id long, unit array<double>")

    def lists(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, unit array<double>, cell int").parquet(f"{self.versions.path()}/lists")

    def centroids(self) -> tuple[np.ndarray, int]:
        """The centroids, and the calibrated number of probes."""
        rows = self.spark.read.parquet(f"{self.versions.path()}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r["centroid"] for r in rows], float), rows[0]["probes"] if rows else 1

    def search(self, queries: DataFrame, *, top_k: int, probes: int | None = None) -> DataFrame:
        """The best vectors of the ``probes`` nearest cells for (query_id, embedding): query_id, vec_id, score, rank."""
        import pyarrow as pa

        c, fit = self.centroids()
        probes = probes or fit
        if not len(c):
            return self.spark.createDataFrame([], "query_id long, vec_id long, score double, rank long")
        sent = self.spark.sparkContext.broadcast(c)

        def probe(batches: Iterator) -> Iterator:
            for b in batches:
                u = _unit(b.column(1).to_pylist())
                if not len(u):
                    continue
                n = min(probes, len(sent.value))
                cells = np.argsort(-(u @ sent.value.T), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(u)), n))), pa.array(cells.ravel().astype(np.int32)), pa.array([list(u[k]) for k in np.repeat(np.arange(len(u)), n)], pa.list_(pa.float64()))], names=["query_id", "cell", "q"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        probed = settle(asked.mapInArrow(probe, "query_id long, cell int, q array<double>"), "probes")
        cells = [r[0] for r in probed.select("cell").distinct().collect()]  # MOST_CELLS at most: the folders to open
        block = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.expr(f"n div {QUERY_BLOCK} + 1")))
        sized = probed.join(F.broadcast(probed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))), "cell")
        blocks = sized.withColumn("block", block).groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
        rows = self.lists().where(F.col("cell").isin(cells))
        packed = rows.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("vec_id", "unit")).alias("rows"))
        # queries times cells: on disk they look small enough to be sent to every task, but by way of the driver they are not
        met = packed.join(blocks.hint("merge"), "cell").select("asked", "rows")

        def score(batches: Iterator) -> Iterator:
            for b in batches:
                for k in range(b.num_rows):
                    asked, rows = b.column(0)[k].values, b.column(1)[k].values
                    q, v = (x.field(1).flatten().to_numpy().reshape(len(x), -1) for x in (asked, rows))
                    ids, keys = asked.field(0).to_numpy(), rows.field(0).to_numpy()
                    scores = q @ v.T
                    n = min(top_k, scores.shape[1])
                    cut = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
                    i, j = np.nonzero(scores >= cut[:, None] - 1e-12)  # ties at the cut stay
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(keys[j]), pa.array(scores[i, j])], names=["query_id", "vec_id", "score"])

        found = met.mapInArrow(score, "query_id long, vec_id long, score double")
        return ranked(found, ["query_id"], [F.round("score", 9).desc(), "vec_id"], top_k)


def index_of(vectors: DataFrame, folder: str | None = None) -> VectorIndex:
    """The index of (vec_id, embedding), built unless it is there."""
    spark = vectors.sparkSession
    index = VectorIndex(spark, f"{folder or shared_dir(spark)}/tracefolio/vector-index/{content_key(vectors)}")
    return index if index.versions.path() else index.build(vectors)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact search's (query_id, vec_id) that was found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(exact.count(), 1)
