"""Retrieval: documents as pages of their source, benchmark items as questions, embeddings as vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.functions import text as T
from tracefolio.operators import cases, vector_index
from tracefolio.operators import retrieval as ops
from tracefolio.operators.block_index import index_of
from tracefolio.operators.corpus_deltas import CorpusStatistics
from tracefolio.plans import hybrid
from tracefolio.session import shared_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def bind(sql: str):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


TOKEN = "[A-Za-z]+(?:[-_][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*%?"  # the fixture has no ideographs
TOKENS = f"SELECT source AS corpus, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda t: lower(t)) AS tokens FROM documents"
BM25 = f"""WITH d AS ({TOKENS}), s AS (SELECT corpus, count(*) AS n_docs, sum(len(tokens)) / count(*) AS avg_len FROM d GROUP BY corpus),
tf AS (SELECT corpus, doc_id, dl, term, count(*) AS tf FROM (SELECT corpus, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
df AS (SELECT corpus, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: lower(t))) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT corpus, query_id, doc_id, sum(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) * qtf) AS score
  FROM tf JOIN df USING (corpus, term) JOIN s USING (corpus) JOIN q USING (term) GROUP BY ALL)
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), "doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@bind(f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM ({TOKENS})")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-01."""
    tokens = T.bm25_tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("digest"))


@bind(f"SELECT corpus, term, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS total FROM (SELECT corpus, doc_id, term, count(*) AS tf FROM (SELECT corpus, doc_id, unnest(tokens) AS term FROM ({TOKENS})) GROUP BY ALL) GROUP BY ALL")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-02: postings and occurrences of every term."""
    return ops.term_frequencies(corpus(spark, sf_dir)).groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("total"))


@bind(BM25 + "SELECT corpus, term, df, round(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df JOIN s USING (corpus)")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21."""
    docs = corpus(spark, sf_dir)
    df = ops.term_frequencies(docs).groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(ops.corpus_stats(docs), "corpus").select("corpus", "term", "df", F.round(ops.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@bind(SQL["bm25_idf"].replace("FROM documents", "FROM documents WHERE lang <> 'de'"))
def idf_by_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21: all documents in, then those of one language out again, without the others being read a second time."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), "doc_id", "text", "lang")
    store = CorpusStatistics(spark, f"{shared_dir(spark)}/tracefolio/statistics-{uuid.uuid4().hex}")
    store.apply(added=docs.drop("lang"))
    store.apply(removed=docs.where("lang = 'de'").drop("lang"))
    return store.frequencies().select("corpus", "term", "df", F.round("idf", 6).alias("idf"))


@bind(BM25 + "SELECT corpus, query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY corpus, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-03, WN-03, FP-06: five best of each corpus and question."""
    found = ops.bm25_search(corpus(spark, sf_dir), questions(spark, sf_dir), top_k=5)
    return found.select("corpus", "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@bind(SQL["bm25_topk"])
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-02, RT-03: the same by the stored index, which is built at the first search."""
    found = index_of(corpus(spark, sf_dir)).search(questions(spark, sf_dir), top_k=5)
    return found.select("corpus", "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@bind(SQL["bm25_topk"].replace("source AS corpus", "'all' AS corpus"))
def indexed_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-03: all corpora as one, by the same index."""
    found = index_of(corpus(spark, sf_dir)).search(questions(spark, sf_dir), top_k=5, everything=True)
    return found.select("corpus", "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@bind(f"SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 5) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 6")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-04: every hundredth vector against all."""
    e = table(spark, sf_dir, "embeddings")
    found = ops.vector_search(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), top_k=6)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@bind("")
def semantic_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-04, SK-04: the same by the stored vector index, which holds every row; recall is measured in tests/test_vector_index.py."""
    e = table(spark, sf_dir, "embeddings")
    found = vector_index.index_of(e.select("vec_id", "embedding")).search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), top_k=6)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@bind(f"SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 5) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b JOIN documents d ON d.doc_id = b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND d.source = 'src3' AND d.lang = 'en' QUALIFY rank <= 3")
def semantic_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-05: vector search in one document's evidence of one kind; both are exact."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    evidence = e.join(d.select(F.col("doc_id").alias("vec_id"), F.col("source").alias("document_id"), F.col("lang").alias("chunk_kind")), "vec_id")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    found = ops.vector_search(evidence, asked, top_k=3, filters={"document_id": "src3", "chunk_kind": "en"})
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@bind(
    BM25.replace("source AS corpus", "'all' AS corpus")
    + f""", b AS (SELECT query_id, doc_id AS page, 'bm25' AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5),
v AS (SELECT a.vec_id AS query_id, b.vec_id AS page, 'semantic' AS source, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 5),
f AS (SELECT query_id, page, sum(CASE source WHEN 'semantic' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END / (20.0::DOUBLE + rank)) AS score, min((CASE source WHEN 'semantic' THEN 0 ELSE 1 END) * 1000 + rank) AS seen FROM (SELECT * FROM b UNION ALL SELECT * FROM v) GROUP BY ALL)
SELECT query_id, page, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen, page) AS rank FROM f QUALIFY rank <= 6"""
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-07: BM25 over all documents and vector search over all embeddings, fused by page (k = 20, 0.4 semantic), best six."""
    e = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("corpus"), "doc_id", "text")
    bm25 = ops.bm25_search(docs, questions(spark, sf_dir), top_k=5).select("query_id", F.col("doc_id").alias("page"), F.lit("bm25").alias("source"), "rank")
    vector = ops.vector_search(e, e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding"), top_k=5).select("query_id", F.col("vec_id").alias("page"), F.lit("semantic").alias("source"), "rank")
    return ops.fuse(vector.unionByName(bm25), {"semantic": 0.4, "bm25": 0.6}, k=20, top_k=6).select("query_id", "page", F.round("score", 6).alias("score"), "rank")


@bind(
    BM25.replace("source AS corpus", "'all' AS corpus").replace("FROM documents", "FROM documents WHERE lang = 'en'")
    + f""", b AS (SELECT query_id, doc_id AS page, 'bm25' AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5),
v AS (SELECT a.vec_id AS query_id, b.vec_id AS page, 'semantic' AS source, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b JOIN documents d ON d.doc_id = b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND d.lang = 'en' QUALIFY rank <= 5),
f AS (SELECT query_id, page, sum(CASE source WHEN 'semantic' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END / (20.0::DOUBLE + rank)) AS score, min((CASE source WHEN 'semantic' THEN 0 ELSE 1 END) * 1000 + rank) AS seen FROM (SELECT * FROM b UNION ALL SELECT * FROM v) GROUP BY ALL)
SELECT query_id, page, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen, page) AS rank FROM f QUALIFY rank <= 6"""
)
def hybrid_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-06, RT-07: the whole plan over evidence of several kinds (here: languages), of which page texts alone take part; a page without a vector can still be found by its words."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "page_text").otherwise("section_text")
    evidence = d.join(e, F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", "text", "embedding", kind.alias("chunk_kind"))
    asked = questions(spark, sf_dir).join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return hybrid.search(evidence, asked).select("query_id", F.col("doc_id").alias("page"), F.round("score", 6).alias("score"), "rank")


# Two ranked lists for each question: an order's lines, dear ones first and small ones first; pages repeat.
LISTS = """WITH l AS (SELECT l_orderkey AS query_id, l_partkey % 7 AS page, * FROM lineitem),
sem AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM l WHERE l_discount <= 0.07), bm AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS rank FROM l WHERE l_tax >= 0.01),
al AS (SELECT 'semantic' AS source, * FROM sem UNION ALL SELECT 'bm25', * FROM bm), one AS (SELECT query_id, page, source, min(rank) AS rank FROM al GROUP BY ALL)
"""


def ranked_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem").withColumns({"query_id": F.col("l_orderkey"), "page": F.col("l_partkey") % 7})
    tie = ["l_linenumber", "l_partkey", "l_suppkey"]
    sem = ops.ranked(l.where("l_discount <= 0.07"), ["query_id"], [F.desc("l_extendedprice"), *tie]).select("query_id", "page", "rank")
    bm = ops.ranked(l.where("l_tax >= 0.01"), ["query_id"], ["l_quantity", *tie]).select("query_id", "page", "rank")
    return sem, bm


def sourced(sem: DataFrame, bm: DataFrame) -> DataFrame:
    return sem.withColumn("source", F.lit("semantic")).unionByName(bm.withColumn("source", F.lit("bm25")))


def fused_sql(ws: float, wb: float, k: float) -> str:
    return f"(SELECT query_id, page, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen, page) AS rank FROM (SELECT query_id, page, sum(CASE source WHEN 'semantic' THEN {ws}::DOUBLE ELSE {wb}::DOUBLE END / ({k}::DOUBLE + rank)) AS score, min((CASE source WHEN 'semantic' THEN 0 ELSE 1 END) * 1000 + rank) AS seen FROM one GROUP BY ALL))"


@bind(LISTS + f"SELECT query_id, page, round(score, 6) AS score, rank FROM {fused_sql(0.4, 0.6, 20)}")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-05."""
    return ops.fuse(sourced(*ranked_lists(spark, sf_dir)), {"semantic": 0.4, "bm25": 0.6}, k=20).select("query_id", "page", F.round("score", 6).alias("score"), "rank")


@bind(LISTS + f"SELECT query_id, page, round(score, 6) AS score, rank FROM {fused_sql(1, 1, 60)}")
def rrf_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-06."""
    return ops.fuse(sourced(*ranked_lists(spark, sf_dir)), {"semantic": 1.0, "bm25": 1.0}, k=60).select("query_id", "page", F.round("score", 6).alias("score"), "rank")


def fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sem, bm = ranked_lists(spark, sf_dir)
    return ops.fuse(sourced(sem, bm), {"semantic": 0.4, "bm25": 0.6}, k=20), sem, bm


F20 = LISTS + f", fz AS {fused_sql(0.4, 0.6, 20)} "


@bind(F20 + """, fl AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY r, page) AS pos FROM (SELECT query_id, page, min(rank) AS r FROM sem GROUP BY ALL) QUALIFY pos <= 2)
SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY part, pos, page) AS pos2 FROM (SELECT query_id, page, 0 AS part, pos FROM fl UNION ALL SELECT query_id, page, 1, rank FROM fz WHERE (query_id, page) NOT IN (SELECT (query_id, page) FROM fl)) QUALIFY pos2 <= 4""".replace("pos2", "place").replace("AS place", "AS place"))
def guard_semantic_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-12."""
    f, sem, _ = fused(spark, sf_dir)
    return ops.semantic_floor(f, sem, count=2, top_k=4).withColumnRenamed("pos", "place")


@bind(F20 + """, m AS (SELECT fz.*, (query_id, page) NOT IN (SELECT (query_id, page) FROM sem) AS alone FROM fz), c AS (SELECT *, sum(CAST(alone AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM m)
SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM c WHERE NOT alone OR so_far <= 1 QUALIFY pos <= 4""")
def guard_bm25_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-11."""
    f, sem, _ = fused(spark, sf_dir)
    return ops.bm25_cap(f, sem, cap=1, top_k=4)


@bind(F20 + """SELECT query_id, page, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank) AS pos FROM (SELECT *, score + CASE WHEN (query_id, page) IN (SELECT (query_id, page) FROM sem) AND (query_id, page) IN (SELECT (query_id, page) FROM bm) THEN 0.5::DOUBLE / 21 ELSE 0 END AS s FROM fz)""")
def guard_overlap_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-13."""
    f, sem, bm = fused(spark, sf_dir)
    return ops.overlap_boost(f, sem, bm, weight=0.5, k=20).withColumn("score", F.round("score", 6))


VARIANTS = ((0, 0.4, 20), (1, 0.6, 20), (2, 0.5, 60))


@bind(LISTS + " UNION ALL ".join(f"SELECT CAST({v} AS BIGINT) AS variant, query_id, page, rank FROM {fused_sql(a, round(1 - a, 1), k)} WHERE rank <= 3" for v, a, k in VARIANTS))
def guard_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-14: several fusions of the same lists."""
    return ops.fuse_variants(sourced(*ranked_lists(spark, sf_dir)), [(v, {"semantic": a, "bm25": round(1 - a, 1)}, k) for v, a, k in VARIANTS], top_k=3)


GRID = """, g AS (SELECT s.unnest AS ks, b.unnest AS kb, k.unnest AS k, a.unnest / 10.0 AS alpha FROM unnest([1, 2, 3, 4]) s, unnest([1, 2, 3, 4]) b, unnest([20, 60]) k, unnest([3, 4, 5, 6, 7]) a)"""


@bind(
    LISTS + GRID + """, e AS (SELECT g.*, al.query_id, al.page, al.source, min(al.rank) AS rank FROM g, al WHERE (source = 'semantic' AND rank <= ks) OR (source = 'bm25' AND rank <= kb) GROUP BY ALL),
f AS (SELECT ks, kb, k, alpha, query_id, page, sum(CASE source WHEN 'semantic' THEN alpha::DOUBLE ELSE 1 - alpha::DOUBLE END / (k + rank)) AS score, min((CASE source WHEN 'semantic' THEN 0 ELSE 1 END) * 1000 + rank) AS seen FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ks, kb, k, alpha, query_id ORDER BY round(score, 9) DESC, seen, page) AS rank FROM f)
SELECT ks, kb, k, CAST(round(alpha * 10) AS BIGINT) AS a10, count(DISTINCT query_id) FILTER (page = query_id % 7) AS hits FROM r WHERE rank <= 3 GROUP BY ALL""".replace("ks, kb, k, CAST", "CAST(ks AS BIGINT) AS ks, CAST(kb AS BIGINT) AS kb, CAST(k AS BIGINT) AS k, CAST")
)
def rrf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-13, TK-07: 160 settings in one job over the cached lists; a hit is the page query % 7 among the first three."""
    rows = [(s, b, k, a) for s in (1, 2, 3, 4) for b in (1, 2, 3, 4) for k in (20, 60) for a in (3, 4, 5, 6, 7)]
    grid = spark.createDataFrame(rows, "ks long, kb long, k long, a10 long")
    # no setting looks beyond the fourth rank; a question's pages are few: one row holds them with their ranks. What a setting gives depends only on the ranks, and on which pages are less than the one asked for:
    # questions that are alike in these are counted, and every setting is worked out once for all of them, so nothing of the 160 settings grows with the questions
    one = sourced(*ranked_lists(spark, sf_dir)).where("rank <= 4").groupBy("query_id", "page").agg(F.min(F.when(F.col("source") == "semantic", F.col("rank"))).alias("s"), F.min(F.when(F.col("source") == "bm25", F.col("rank"))).alias("b"))
    mine = F.col("page") == F.col("query_id") % 7
    row = one.groupBy("query_id").agg(F.max(F.when(mine, F.struct("page", "s", "b"))).alias("t"), F.collect_list(F.when(~mine, F.struct("page", "s", "b"))).alias("others")).where("t is not null")
    others = F.array_sort(F.transform("others", lambda x: F.struct((x["page"] < F.col("t.page")).alias("less"), x["s"].alias("s"), x["b"].alias("b"))))
    row = row.withColumn("others", others).select(F.struct("t.s", "t.b").alias("t"), "others").groupBy("t", "others").agg(F.count(F.lit(1)).alias("n"))
    alpha, k = F.col("a10") / 10.0, F.col("k")
    in_s, in_b = lambda x: F.coalesce(x["s"] <= F.col("ks"), F.lit(False)), lambda x: F.coalesce(x["b"] <= F.col("kb"), F.lit(False))
    score = lambda x: F.round(F.when(in_s(x), alpha / (k + x["s"])).otherwise(0.0) + F.when(in_b(x), (1 - alpha) / (k + x["b"])).otherwise(0.0), 9)
    seen = lambda x: F.when(in_s(x), x["s"]).otherwise(1000 + x["b"])
    every = row.crossJoin(F.broadcast(grid)).where(in_s(F.col("t")) | in_b(F.col("t"))).withColumns({"score": score(F.col("t")), "seen": seen(F.col("t"))})

    def before(x):
        """Does this page stand before the one asked for?"""
        same, earlier = score(x) == F.col("score"), (seen(x) < F.col("seen")) | ((seen(x) == F.col("seen")) & x["less"])
        return (in_s(x) | in_b(x)) & ((score(x) > F.col("score")) | (same & earlier))

    hits = every.groupBy("ks", "kb", "k", "a10").agg(F.sum(F.when(F.size(F.filter("others", before)) < 3, F.col("n")).otherwise(0)).alias("hits"))
    return F.broadcast(grid).join(hits, ["ks", "kb", "k", "a10"], "left").na.fill(0, ["hits"])


@bind("SELECT conv_id, turn, CASE WHEN intent = 'metric_value' THEN 'page_text' WHEN intent IN ('metric_attribution', 'business_narrative') THEN 'section_text' WHEN regexp_matches(q, 'would|the') THEN 'section_text' ELSE 'page_text' END AS primary_kind, CASE WHEN intent = 'metric_value' THEN NULL WHEN intent IN ('metric_attribution', 'business_narrative') THEN 'page_text' WHEN regexp_matches(q, 'would|the') THEN 'page_text' END AS fallback_kind FROM (SELECT *, CASE turn % 4 WHEN 0 THEN 'metric_value' WHEN 2 THEN CASE WHEN conv_id % 3 = 0 THEN 'metric_attribution' WHEN conv_id % 3 = 1 THEN 'business_narrative' END END AS intent, regexp_replace(lower(text), '\\s+', '', 'g') AS q FROM conversations WHERE role = 'user')")
def strategy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-08, RT-15."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    intent = F.when(F.col("turn") % 4 == 0, "metric_value").when(F.col("turn") % 4 == 2, F.when(F.col("conv_id") % 3 == 0, "metric_attribution").when(F.col("conv_id") % 3 == 1, "business_narrative"))
    out = ops.strategy(c.withColumn("intent", intent), "page_text_hybrid", question="text", section_terms=("would", "t h e"), page_terms=("page",))
    return out.select("conv_id", "turn", "primary_kind", "fallback_kind")


KEYWORDS = ["thing", "license", "the and"]


@bind("SELECT corpus, doc_id, score, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, doc_id) AS rank FROM (SELECT source AS corpus, doc_id, CAST(contains(t, 'thing') AS BIGINT) + CAST(contains(t, 'license') AS BIGINT) AS score FROM (SELECT *, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') AS t FROM documents)) WHERE score > 0 QUALIFY rank <= 2")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-10: the third keyword has a blank and matches nothing."""
    return ops.keyword_fallback(corpus(spark, sf_dir), KEYWORDS)


@bind("SELECT p_brand, p_partkey, b AS boost, row_number() OVER (PARTITION BY p_brand ORDER BY b DESC, p_partkey) AS rank FROM (SELECT *, CASE WHEN p_size > 40 THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(p_type, 'PROMO') THEN 1.5::DOUBLE ELSE 0 END AS b FROM part) QUALIFY rank <= 6")
def boost_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-11: rows moved up by rules that are data."""
    rules = [(F.col("p_size") > 40, 2.0), (F.contains("p_type", F.lit("PROMO")), 1.5)]
    out = ops.boosted(table(spark, sf_dir, "part"), rules, ["p_partkey"])
    return ops.ranked(out, ["p_brand"], [F.desc("boost"), "__order"], 6).select("p_brand", "p_partkey", "boost", "rank")


@bind(LISTS + "SELECT query_id, page, pos FROM (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY part, r, page) AS pos FROM (SELECT query_id, page, min(part) AS part, min(CASE WHEN part = 0 THEN rank END) AS r0, coalesce(min(CASE WHEN part = 0 THEN rank END), min(rank)) AS r FROM (SELECT query_id, page, rank, 0 AS part FROM sem WHERE rank <= 2 UNION ALL SELECT query_id, page, rank, 1 FROM bm WHERE rank <= 2) GROUP BY query_id, page)) WHERE pos <= 3")
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-02: primary rows, then fallback rows, each page once."""
    sem, bm = ranked_lists(spark, sf_dir)
    return ops.union_dedupe(sem.where("rank <= 2"), bm.where("rank <= 2"), ["page"], "rank", 3, ["query_id"]).select("query_id", "page", "pos")


@bind(LISTS + "SELECT query_id, page, rank, 'primary' AS source FROM sem UNION ALL SELECT query_id, page, rank, 'fallback' FROM bm WHERE query_id NOT IN (SELECT query_id FROM sem) OR query_id % 5 = 0")
def primary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-09: the fallback list where there is no primary row, or where it is asked for."""
    sem, bm = ranked_lists(spark, sf_dir)
    return ops.primary_or_fallback(sem, bm, "query_id", F.col("query_id") % 5 == 0)


@bind(
    BM25.replace("source AS corpus", "'all' AS corpus")
    + f""", hits AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS pos FROM scored QUALIFY pos <= 5),
qt AS (SELECT query_id, t, count(*) AS n, min(p) AS p FROM (SELECT query_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: lower(t)) AS ts FROM benchmark)) WHERE length(t) > 1 GROUP BY ALL),
h AS (SELECT query_id, doc_id, t, n, p FROM hits JOIN qt USING (query_id) JOIN (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') AS x FROM documents) USING (doc_id) WHERE contains(x, t))
SELECT query_id, doc_id, array_to_string(list(t ORDER BY n DESC, p)[1:8], ' ') AS terms FROM h GROUP BY ALL"""
)
def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-26: the most frequent terms of a question that its five best hits have, eight at most each."""
    q, d = questions(spark, sf_dir), table(spark, sf_dir, "documents")
    terms = q.select("query_id", F.posexplode(T.bm25_tokens(F.col("text"))).alias("p", "t")).where("length(t) > 1").groupBy("query_id", "t").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    asked = terms.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p", "t"))), lambda x: x["t"]).alias("ts"))
    found = ops.bm25_search(d.select(F.lit("all").alias("corpus"), "doc_id", "text"), q, top_k=5).select("query_id", "doc_id")
    # texts stay where they lie: the few rows found go to them
    few = asked.limit(ops.MOST_PAIRS + 1).count() <= ops.MOST_PAIRS
    near = F.broadcast if few else lambda df: df
    met = d.join(near(found), "doc_id").select("query_id", "doc_id", T.compact(F.coalesce("text", F.lit(""))).alias("x")).join(near(asked), "query_id")
    hits = met.select("query_id", "doc_id", F.filter("ts", lambda t: F.contains(F.col("x"), t)).alias("h")).where("size(h) > 0")
    return hits.select("query_id", "doc_id", F.array_join(F.slice("h", 1, 8), " ").alias("terms"))


@bind(LISTS + """, m AS (SELECT 'semantic_only' AS mode, query_id, page, rank FROM sem WHERE rank <= 2 UNION ALL SELECT 'bm25_only', query_id, page, rank FROM bm WHERE rank <= 5),
f AS (SELECT mode, query_id, page, min(rank) AS rank FROM m GROUP BY ALL) SELECT mode, query_id, page, row_number() OVER (PARTITION BY mode, query_id ORDER BY rank, page) AS rank FROM f QUALIFY rank <= 6""".replace("QUALIFY rank", "QUALIFY row_number() OVER (PARTITION BY mode, query_id ORDER BY f.rank, page)"))
def mode_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-22: how many rows each mode looks at is its own: the strategy's number for vectors, a larger one for the others."""
    sem, bm = ranked_lists(spark, sf_dir)
    both = sem.where("rank <= 2").withColumn("mode", F.lit("semantic_only")).unionByName(bm.where("rank <= 5").withColumn("mode", F.lit("bm25_only")))
    first = both.groupBy("mode", "query_id", "page").agg(F.min("rank").alias("r"))
    return ops.ranked(first, ["mode", "query_id"], ["r", "page"], 6).select("mode", "query_id", "page", "rank")


@bind(F20 + "SELECT q.query_id, bool_or(src = 'semantic') AS semantic, bool_or(src = 'bm25') AS bm25, bool_or(src = 'fused') AS fused FROM (SELECT DISTINCT query_id FROM fz) q LEFT JOIN (SELECT 'semantic' AS src, query_id, page FROM sem WHERE rank <= 2 UNION ALL SELECT 'bm25', query_id, page FROM bm WHERE rank <= 2 UNION ALL SELECT 'fused', query_id, page FROM fz WHERE rank <= 2 UNION ALL SELECT 'none', query_id, query_id % 7 FROM fz) h ON h.query_id = q.query_id AND h.page = q.query_id % 7 GROUP BY q.query_id")
def guard_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-25: is the expected page among the first two of each list?"""
    f, sem, bm = fused(spark, sf_dir)
    lists = f.select("query_id", "page", "rank").withColumn("src", F.lit("fused")).unionByName(sem.withColumn("src", F.lit("semantic"))).unionByName(bm.withColumn("src", F.lit("bm25")))
    hit = (F.col("page") == F.col("query_id") % 7) & (F.col("rank") <= 2)
    return lists.groupBy("query_id").agg(*(F.bool_or(hit & (F.col("src") == s)).alias(s) for s in ("semantic", "bm25", "fused")))


@bind(
    """WITH f AS (SELECT source AS company, max(doc_id) AS doc FROM documents GROUP BY source), d AS (SELECT company, CAST(doc AS VARCHAR) AS document_key, doc, unnest(['version', 'licensed', 'trademark']) AS query_id FROM f),
h AS (SELECT source AS company, q AS query_id, count(*) AS pages FROM documents, (SELECT unnest(['version', 'licensed', 'trademark']) AS q) WHERE contains(lower(text), q) GROUP BY ALL)
SELECT document_key || '::' || query_id AS case_id, company, query_id, document_key, CASE WHEN pages > 0 THEN 'candidate' ELSE 'needs_manual_probe' END AS search_status, coalesce(pages, 0) AS score, CASE WHEN doc % 2 = 0 AND query_id = 'version' THEN doc % 9 || CASE WHEN doc % 9 <> 3 THEN ',3' ELSE '' END ELSE '' END AS expected,
  CASE WHEN doc % 3 = 0 AND query_id = 'version' AND doc % 2 = 0 THEN 'needs_anchor_confirmation' WHEN doc % 2 = 0 AND query_id = 'version' THEN 'ready_for_manifest' WHEN pages > 0 THEN 'needs_anchor_confirmation' ELSE 'needs_manual_probe' END AS readiness FROM d LEFT JOIN h USING (company, query_id)"""
)
def universal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-24: every question on its company's last filing, with what the search found, what people noted, and what it needs yet."""
    d, asked = table(spark, sf_dir, "documents"), ("version", "licensed", "trademark")
    companies = d.groupBy(F.col("source").alias("company")).agg(F.max("doc_id").alias("doc"), *(F.count_if(F.contains(F.lower("text"), F.lit(q))).alias(q) for q in asked))
    filings = d.select(F.col("source").alias("company"), F.col("doc_id").cast("string").alias("document_key"), F.array(*(F.lit(q) for q in asked)).alias("universal_candidates"), F.col("doc_id").alias("pos"))
    each = companies.select("company", "doc", F.explode(F.array(*(F.struct(F.lit(q).alias("query_id"), F.col(q).alias("n")) for q in asked))).alias("r")).select("company", "doc", "r.*")
    hits = each.where("n > 0").select("query_id", F.col("doc").cast("string").alias("document_key"), F.array(F.lit(1).cast("long")).alias("candidate_pages"), F.col("n").alias("score"))
    notes = companies.where("doc % 2 = 0").select(
        "company", F.lit("version").alias("query_id"), F.array(F.col("doc") % 9).alias("human_confirmed_pages"), F.array(F.lit(3).cast("long")).alias("human_corrected_pages"), F.when(F.col("doc") % 3 == 0, F.array(F.lit("unit"))).otherwise(F.array().cast("array<string>")).alias("human_missing_fields")
    )
    out = cases.universal_matrix(each.select("query_id", "company"), filings, hits, notes)
    return out.withColumn("expected", F.array_join(F.transform("expected_pages", lambda p: p.cast("string")), ",")).drop("expected_pages")


@bind("SELECT ks, kb, k, a10, hits, row_number() OVER (ORDER BY hits DESC, ks + kb, k, abs(a10 - 5), ks, a10) AS place FROM (" + SQL["rrf_grid"] + ") QUALIFY place <= 10")
def grid_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-07: the ten best of the grid's 160 settings: most hits, then the smaller lists, the smaller k and the more even weights."""
    order = [F.desc("hits"), F.col("ks") + F.col("kb"), "k", F.abs(F.col("a10") - 5), "ks", "a10"]
    top = rrf_grid(spark, sf_dir).orderBy(*order).limit(10)
    return ops.ranked(top.withColumn("all", F.lit(1)), ["all"], order, None, "place").drop("all")


@bind("SELECT turn, intent, CASE intent WHEN 'metric_value' THEN 'page_text' ELSE 'section_text' END AS primary_kind, CASE intent WHEN 'metric_value' THEN NULL ELSE 'page_text' END AS fallback_kind, CASE intent WHEN 'metric_value' THEN 6 ELSE 4 END AS primary_k, CASE intent WHEN 'metric_value' THEN 0 ELSE 4 END AS fallback_k FROM (SELECT DISTINCT turn, ['metric_value', 'metric_attribution', 'business_narrative'][turn % 3 + 1] AS intent FROM conversations)")
def no_table_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-15: the plan of each intent without table rows; the strategies are a table."""
    plans = [(i, *p) for i, p in ops.STRATEGIES["page_text_hybrid"].items()]
    table_ = spark.createDataFrame(plans, "intent string, primary_kind string, fallback_kind string, always boolean, primary_k int, fallback_k int").drop("always")
    turns = table(spark, sf_dir, "conversations").select("turn").distinct()
    intent = F.element_at(F.array(*(F.lit(i) for i, *_ in plans)), (F.col("turn") % 3 + 1).cast("int"))
    return turns.withColumn("intent", intent).join(F.broadcast(table_), "intent").select("turn", "intent", "primary_kind", "fallback_kind", "primary_k", "fallback_k")
