"""A stored text index: postings in blocks of documents, each with what its best document could score.

``build`` writes two tables beside each other:

* *forward*: corpus, doc_id, block, dl, and the document's terms with their counts. Documents are dealt by range of corpus and doc_id, and a block is
  BLOCK documents after each other;
* *blocks*: for each term and block the postings (doc_id, tf, dl), and for each tf the least length (``peaks``). Files are partitioned by a
  hash of the term and sorted by term and block, so that a search opens the files of its terms, and of these the pages of its blocks. A block's documents lie
  in one task, which turns them into the block's rows: a build moves texts once, and no posting.

Nothing in the tables depends on k1, b, or the corpus' average length: these, idf and the documents' number are added up from the asked terms' block
headers and the lengths. So one index serves searches in each corpus and over all of them, and another one (``add``) can stand beside it.

``search`` adds up from the headers how many postings its questions ask for. Where these are more than there are documents, next to nothing can be left out, and what is moved for skipping is more than
the postings: then *forward* is read, and documents meet the questions where they lie (``bm25_blocks``); only each task's best ones are moved.

Else it skips in three steps, none of which loses a document. (1) For each question and block it sums up what a document could score at most; the most promising blocks
are scored, and the k-th best score among them is the question's *floor*. (2) Terms whose highest scores sum up to less than the floor can't lift a document over it by
themselves: these (the common ones, with the long postings) are left for last, and of the others' blocks only those are read whose sum can reach the floor. (3) Documents whose
score so far, with the most that their block's common terms can add, reaches the floor are *candidates*; the common terms' postings are read for these alone. That
gives exactly what ``retrieval.bm25_search`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefolio.functions.text import bm25_tokens
from tracefolio.operators import bm25_blocks
from tracefolio.operators.retrieval import K1, MOST_PAIRS, MOST_TERMS, B, counted, idf, ranked, repeated
from tracefolio.session import content_key, settle, shared_dir, small_batches, split_bytes
from tracefolio.sources.artifacts import Versions

#: Documents of a block; folders of terms.
BLOCK, SHARDS = 64, 64
#: Postings that the questions ask for, to a document: beyond it nothing is skipped.
BROAD = 1
#: Blocks of each question that are scored first.
SEEDS = 2
#: Rows of a Parquet page of the blocks: what is skipped is skipped in pages.
PAGE_ROWS = 128
#: Bytes of *forward* that a task turns into rows of blocks and sorts: some thirty times as many in memory.
TASK_BYTES = 16 << 20
#: Sums of floating numbers may differ by their order.
SLACK = 1e-8


def shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def forward_rows(docs: DataFrame) -> DataFrame:
    """corpus, doc_id, block, dl, terms of (corpus, doc_id, text); documents without terms, too."""
    ordered = docs.select("corpus", "doc_id", "text").repartitionByRange(F.col("corpus"), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("corpus", "doc_id")
    # a task's numbers begin at a multiple of 2^33: no block lies in two tasks
    numbered = ordered.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
    tokens = numbered.select("corpus", "doc_id", "block", F.sort_array(bm25_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    return tokens.select("corpus", "doc_id", "block", F.size("tokens").cast("long").alias("dl"), counted("tokens").alias("terms"))


def block_rows(forward: DataFrame) -> DataFrame:
    """shard, term, corpus, block, n, peaks, postings; by term and block within each task. Documents of a block stand after each other; if they come to two tasks, each gives a row of its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = []
        for b in batches:
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            block = t.column("block").to_numpy()
            # the last block may go on in the next batch
            end = int(np.flatnonzero(np.r_[True, block[1:] != block[:-1]])[-1]) if len(block) else 0
            if end:
                yield grouped(t.slice(0, end))
            held = t.slice(end).combine_chunks().to_batches()
        if held:
            yield grouped(pa.Table.from_batches(held))

    rows = small_batches(forward.select("corpus", F.col("doc_id").cast("long").alias("doc_id"), "block", "dl", "terms")).mapInArrow(run, "term string, corpus string, block long, n long, peaks array<struct<tf:bigint,dl:bigint>>, postings array<struct<doc_id:bigint,tf:bigint,dl:bigint>>")
    return rows.select(shard(F.col("term")).alias("shard"), "*").sortWithinPartitions("shard", "term", "block")


def grouped(t):
    """The rows of whole blocks, as an Arrow batch of term, corpus, block, n, peaks, postings."""
    import pyarrow as pa

    t = t.combine_chunks()
    corpus, doc_id, block, dl, terms = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (t.column(k) for k in ("corpus", "doc_id", "block", "dl", "terms")))
    row = np.repeat(np.arange(len(block)), np.asarray(terms.value_lengths()))
    words, tf = (terms.flatten().field(k) for k in (0, 1))
    words, corpora, dl, tf = words.dictionary_encode(), corpus.dictionary_encode("encode"), dl.to_numpy()[row], tf.to_numpy()
    _, number = np.unique(block.to_numpy(), return_inverse=True)
    key = (number[row] * len(corpora.dictionary) + corpora.indices.to_numpy()[row]) * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, int)
    lists = lambda at, n, **columns: pa.ListArray.from_arrays(pa.array(np.r_[at, n], pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))
    first = pa.array(order[starts])
    low = np.lexsort((dl, tf, key))
    low = low[np.r_[True, (key[low][1:] != key[low][:-1]) | (tf[low][1:] != tf[low][:-1])]] if len(low) else low
    peaks = lists(np.searchsorted(key[low], key[order][starts]), len(low), tf=pa.array(tf[low]), dl=pa.array(dl[low]))
    postings = lists(starts, len(order), doc_id=doc_id.take(pa.array(row[order])), tf=pa.array(tf[order]), dl=pa.array(dl[order]))
    whose = pa.array(row[order[starts]])
    columns = [words.dictionary.take(words.indices.take(first)), corpus.take(whose), block.take(whose), pa.array(np.diff(np.r_[starts, len(order)])), peaks, postings]
    return pa.RecordBatch.from_arrays(columns, names=["term", "corpus", "block", "n", "peaks", "postings"])


class TextIndex:
    """The index in a folder; it is there from when its pointer is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def build(self, docs: DataFrame) -> TextIndex:
        """Index (corpus, doc_id, text). A build that is broken off leaves the earlier index."""
        version = self.versions.new()
        at = f"{self.versions.folder}/{version}"
        forward_rows(docs).write.parquet(f"{at}/forward")
        with split_bytes(self.spark, TASK_BYTES):
            block_rows(self.spark.read.parquet(f"{at}/forward")).write.partitionBy("shard").option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(f"{at}/blocks")
        self.versions.switch(version)
        return self

    def read(self, what: str) -> DataFrame:
        path = self.versions.path()
        if not path:
            raise FileNotFoundError(f"no index in {self.versions.folder}")
        schemas = {
            "forward": "corpus string, doc_id long, block long, dl long, terms array<struct<term:string,tf:bigint>>",
            "blocks": "term string, corpus string, block long, n long, peaks array<struct<tf:bigint,dl:bigint>>, postings array<struct<doc_id:bigint,tf:bigint,dl:bigint>>, shard int",
        }
        return self.spark.read.schema(schemas[what]).parquet(f"{path}/{what}")

    def corpus(self, everything: bool) -> Column:
        return F.lit("all") if everything else F.col("corpus")

    def bounds(self, queries: DataFrame, *, everything: bool = False, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
        """(corpus, query_id, term, block, most): what the term adds to a document of the block at most; and the asked terms (corpus, query_id, term, weight, avg_len, highest, shard). Both are written."""
        asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = settle(asked.withColumn("shard", shard(F.col("term"))), "asked-terms")
        headers = self._of_terms(asked, "block", "n", "peaks").withColumn("corpus", self.corpus(everything))
        sizes = self.read("forward").select(self.corpus(everything).alias("corpus"), "dl").groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_len"))
        found = headers.groupBy("corpus", "term").agg(F.sum("n").alias("df")).join(sizes, "corpus")
        known = settle(found.select("corpus", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len"), "known-terms")
        peak = F.array_max(F.transform("peaks", lambda p: saturation(p["tf"], p["dl"], F.col("avg_len"), k1, b)))
        # peaks are weighed once a corpus and term, and then go to the questions
        peaked = settle(headers.join(_near(known), ["corpus", "term"]).select("corpus", "term", "block", (F.col("idf") * peak).alias("peak")), "peaks")
        highest = peaked.groupBy("corpus", "term").agg(F.max("peak").alias("highest"))
        weights = known.join(highest, ["corpus", "term"]).join(_near(asked), "term")
        weights = weights.select("corpus", "query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight"), "avg_len", (F.col("highest") * F.col("qtf")).alias("highest"), "shard")
        most = peaked.join(_near(asked), "term").select("corpus", "query_id", "term", "block", (F.col("qtf") * F.col("peak")).alias("most"))
        return most, settle(weights, "term-weights")

    def _of_terms(self, asked: DataFrame, *columns: str) -> DataFrame:
        """Block rows of the asked terms. Other folders are not opened."""
        shards = [r[0] for r in asked.select("shard").distinct().collect()]  # SHARDS at most
        return self.read("blocks").where(F.col("shard").isin(shards)).select("term", "corpus", *columns).join(_near(asked.select("term").distinct()), "term", "left_semi")

    def chosen(self, most: DataFrame, weights: DataFrame, *, top_k: int, everything: bool = False, k1: float = K1, b: float = B) -> DataFrame:
        """The blocks that can reach their question's floor: corpus, query_id, block, floor, rest (what terms that are left for last can add), last (these terms). Written."""
        by = ["corpus", "query_id"]
        whole = settle(most.groupBy(*by, "block").agg(F.sum("most").alias("most")), "block-bounds")
        seeds = ranked(whole, by, [F.desc("most"), "block"], SEEDS, "place").select(*by, "block")
        first = ranked(self._scores(settle(seeds, "seeds"), weights, everything, k1, b), by, [F.desc("score"), "doc_id"], top_k, "place")
        floor = settle(first.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= top_k, F.min("score") - SLACK).otherwise(0.0).alias("floor")), "floors")
        ascending = Window.partitionBy(*by).orderBy("highest", "term").rowsBetween(Window.unboundedPreceding, 0)
        summed = weights.join(_near(floor), by).withColumn("so_far", F.sum("highest").over(ascending))
        last = summed.groupBy(*by, "floor").agg(F.collect_list(F.when(F.col("so_far") < F.col("floor"), F.col("term"))).alias("last"))
        reaching = whole.join(_near(settle(last, "last-terms")), by).where(F.col("most") >= F.col("floor"))
        rest = most.join(_near(summed.where("so_far < floor").select(*by, "term")), [*by, "term"]).groupBy(*by, "block").agg(F.sum("most").alias("rest"))
        return settle(reaching.join(rest, [*by, "block"], "left").select(*by, "block", "floor", F.coalesce("rest", F.lit(0.0)).alias("rest"), "last"), "chosen-blocks")

    def _postings(self, blocks: DataFrame, weights: DataFrame, everything: bool) -> DataFrame:
        """The asked terms' postings of (corpus, query_id, block, ...), with the columns of ``blocks`` and ``weights``."""
        lo, hi = blocks.agg(F.min("block"), F.max("block")).first()
        rows = self._of_terms(weights, "block", "postings").where(F.col("block").between(lo or 0, hi or 0)).withColumn("corpus", self.corpus(everything))
        return rows.join(_near(weights), ["corpus", "term"]).join(_near(blocks), ["corpus", "query_id", "block"])

    def _scores(self, blocks: DataFrame, weights: DataFrame, everything: bool, k1: float, b: float) -> DataFrame:
        """corpus, query_id, doc_id, score of all documents in (corpus, query_id, block)."""
        posted = self._postings(blocks, weights, everything).select("corpus", "query_id", "weight", "avg_len", F.explode("postings").alias("p"))
        return posted.select("corpus", "query_id", F.col("p.doc_id").alias("doc_id"), one(k1, b)).groupBy("corpus", "query_id", "doc_id").agg(F.sum("one").alias("score"))

    def candidates(self, blocks: DataFrame, weights: DataFrame, *, everything: bool = False, k1: float = K1, b: float = B) -> DataFrame:
        """corpus, query_id, doc_id, block, so_far, last: documents that can reach the floor. Written."""
        met = self._postings(blocks, weights, everything).where(~F.array_contains("last", F.col("term")))
        posted = met.select("corpus", "query_id", "block", "floor", "rest", "weight", "avg_len", F.explode("postings").alias("p"))
        so_far = posted.select("corpus", "query_id", "block", "floor", "rest", F.col("p.doc_id").alias("doc_id"), one(k1, b)).groupBy("corpus", "query_id", "doc_id", "block", "floor", "rest").agg(F.sum("one").alias("so_far"))
        return settle(so_far.where(F.col("so_far") + F.col("rest") >= F.col("floor")).select("corpus", "query_id", "doc_id", "block", "so_far"), "candidates")

    def search(self, queries: DataFrame, *, top_k: int, everything: bool = False, k1: float = K1, b: float = B) -> DataFrame:
        """The best documents of each corpus (``everything``: of all of them, as corpus ``all``) for (query_id, text): corpus, query_id, doc_id, score, rank."""
        by = ["corpus", "query_id"]
        found = self._broad(queries, top_k, everything, k1, b)
        if found is not None:
            return ranked(found, by, [F.round("score", 9).desc(), "doc_id"], top_k)
        most, weights = self.bounds(queries, everything=everything, k1=k1, b=b)
        blocks = self.chosen(most, weights, top_k=top_k, everything=everything, k1=k1, b=b)
        found = self.candidates(blocks, weights, everything=everything, k1=k1, b=b)
        wanted = found.groupBy(*by, "block").agg(F.collect_list("doc_id").alias("docs")).join(blocks.select(*by, "block", "last"), [*by, "block"])
        left = self._postings(wanted, weights, everything).where(F.array_contains("last", F.col("term")))
        posted = left.select(*by, "weight", "avg_len", F.explode(F.filter("postings", lambda p: F.array_contains("docs", p["doc_id"]))).alias("p"))
        rest = posted.select(*by, F.col("p.doc_id").alias("doc_id"), one(k1, b))
        scored = found.select(*by, "doc_id", F.col("so_far").alias("one")).unionByName(rest).groupBy(*by, "doc_id").agg(F.sum("one").alias("score"))
        return ranked(scored, by, [F.round("score", 9).desc(), "doc_id"], top_k)

    def _broad(self, queries: DataFrame, top_k: int, everything: bool, k1: float, b: float) -> DataFrame | None:
        """Each task's best documents of (corpus, query_id), where the questions ask for so much that nothing is skipped; else, where there are too many of them, or where documents have several rows, nothing."""
        asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        pairs = asked.limit(MOST_PAIRS + 1).collect()
        if not pairs or len(pairs) > MOST_PAIRS or not all(isinstance(r["query_id"], int) for r in pairs):
            return None
        terms = sorted({r["term"] for r in pairs})
        place = {t: i for i, t in enumerate(terms)}
        docs = self.read("forward").withColumn("corpus", self.corpus(everything)).where("corpus is not null")
        sizes = docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_len"))
        sizes = sizes.orderBy("corpus").limit(MOST_TERMS // len(terms) + 1).collect()
        if len(sizes) * len(terms) > MOST_TERMS:
            return None
        number = {r["corpus"]: i for i, r in enumerate(sizes)}
        wanted = F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string"))  # MOST_PAIRS at most
        held = self.read("blocks").select("term", self.corpus(everything).alias("corpus"), "n").where("corpus is not null").join(wanted, "term", "left_semi")
        df = np.zeros((len(sizes), len(terms)))
        for r in held.groupBy("corpus", "term").agg(F.sum("n").alias("df")).collect():
            df[number[r["corpus"]], place[r["term"]]] = r["df"]
        times = np.bincount([place[r["term"]] for r in pairs], minlength=len(terms))
        if (df @ times).sum() <= BROAD * sum(r["n_docs"] for r in sizes) or repeated(docs):
            return None
        n = np.array([[r["n_docs"]] for r in sizes])
        weight = np.where(df > 0, np.log(1.0 + (n - df + 0.5) / (df + 0.5)), 0.0)
        listed = [(r["query_id"], place[r["term"]], r["qtf"]) for r in pairs]
        return bm25_blocks.best(bm25_blocks.stored(docs, terms), listed, {r["corpus"]: r["avg_len"] for r in sizes}, weight, top_k=top_k, k1=k1, b=b)


def one(k1: float, b: float) -> Column:
    """What a term adds, from the weight and the posting ``p``."""
    return (F.col("weight") * saturation(F.col("p.tf"), F.col("p.dl"), F.col("avg_len"), k1, b)).alias("one")


def saturation(tf: Column, dl: Column, avg_len: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avg_len))


def _near(df: DataFrame) -> DataFrame:
    """Sent to every task where it has no more rows than MOST_TERMS, else shuffled."""
    return F.broadcast(df) if df.limit(MOST_TERMS + 1).count() <= MOST_TERMS else df


def index_of(docs: DataFrame, folder: str | None = None) -> TextIndex:
    """The index of (corpus, doc_id, text), built unless it is there: it goes by the files that ``docs`` reads and by its columns."""
    spark = docs.sparkSession
    index = TextIndex(spark, f"{folder or shared_dir(spark)}/tracefolio/text-index/{content_key(docs)}")
    return index if index.versions.path() else index.build(docs)
