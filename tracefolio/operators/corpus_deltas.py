"""Statistics of a corpus as signed deltas: a document that is replaced changes them without the others being read again.

Each ``apply`` writes what its documents add (documents taken in) and take away (documents taken out): the number of documents and of tokens of each corpus, and of each term the documents
that have it. The sums over all runs are those of a count from scratch. A run holds from when the pointer is renamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.functions.text import bm25_tokens
from tracefolio.operators.retrieval import idf
from tracefolio.sources.artifacts import Versions


def counts_of(docs: DataFrame, sign: int) -> DataFrame:
    """(corpus, term, n, tokens) of (corpus, doc_id, text), times ``sign``; the row of the null term counts documents and tokens. Terms count within each text before they move."""
    tokens = docs.select("corpus", bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    terms = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tokens"))
    rows = tokens.select("corpus", F.size("tokens").cast("long").alias("dl"), F.explode(terms).alias("term"))
    size = F.sum(F.when(F.col("term").isNull(), F.col("dl")).otherwise(0))
    return rows.groupBy("corpus", "term").agg((F.count(F.lit(1)) * sign).alias("n"), (size * sign).alias("tokens"))


class CorpusStatistics:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def runs(self) -> list[str]:
        path = self.versions.path()
        return [r[0] for r in self.spark.read.parquet(f"{path}/runs").orderBy("seq").select("version").collect()] if path else []

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Take documents in and out, in one step: a replaced document is in both."""
        parts = [counts_of(d, s) for d, s in ((added, 1), (removed, -1)) if d is not None]
        if not parts:
            return
        delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("corpus", "term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
        earlier, version = self.runs(), self.versions.new()
        at = f"{self.versions.folder}/{version}"
        delta.where("n <> 0 or tokens <> 0").write.parquet(f"{at}/deltas")
        self.spark.createDataFrame([(v, k) for k, v in enumerate([*earlier, version])], "version string, seq int").coalesce(1).write.parquet(f"{at}/runs")
        self.versions.switch(version)

    def totals(self) -> DataFrame:
        """(corpus, term, n, tokens): sums over all runs; what no document has any more is left out."""
        paths = [f"{self.versions.folder}/{v}/deltas" for v in self.runs()]
        schema = "corpus string, term string, n long, tokens long"
        every = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return every.groupBy("corpus", "term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("n <> 0")

    def corpora(self) -> DataFrame:
        """corpus, n_docs, avg_len, as ``retrieval.corpus_stats`` counts them."""
        return self.totals().where("term is null").select("corpus", F.col("n").alias("n_docs"), (F.col("tokens") / F.col("n")).alias("avg_len"))

    def frequencies(self) -> DataFrame:
        """corpus, term, df, idf."""
        terms = self.totals().where("term is not null").select("corpus", "term", F.col("n").alias("df"))
        return terms.join(self.corpora(), "corpus").select("corpus", "term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))

    def compact(self) -> None:
        """All runs to one."""
        version = self.versions.new()
        at = f"{self.versions.folder}/{version}"
        self.totals().write.parquet(f"{at}/deltas")
        self.spark.createDataFrame([(version, 0)], "version string, seq int").coalesce(1).write.parquet(f"{at}/runs")
        self.versions.switch(version)
