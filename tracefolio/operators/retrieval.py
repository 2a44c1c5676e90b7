"""Text retrieval: BM25, exact vector search, reciprocal-rank fusion, guards on fused lists, strategies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.functions.text import bm25_tokens, compact
from tracefolio.operators import bm25_blocks
from tracefolio.operators.blocks import against
from tracefolio.session import settle

K1, B = 1.5, 0.75
#: Query terms, or vectors, that are sent to every task, at most; beyond it terms are joined by a shuffle, and vectors are a table in blocks.
MOST_TERMS, VECTOR_BLOCK = 500_000, 2_000
#: (question, term) pairs that meet documents in blocks, at most; beyond it postings are joined.
MOST_PAIRS = 50_000


def ranked(df: DataFrame, by: list[str], order: list, top_k: int | None = None, name: str = "rank") -> DataFrame:
    """1, 2, ... within each group of ``by``; ``order`` must break all ties."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out.where(F.col(name) <= top_k) if top_k else out


def corpus_stats(docs: DataFrame) -> DataFrame:
    """corpus, n_docs, avg_len of (corpus, doc_id, text): empty documents count."""
    sized = docs.select("corpus", F.size(bm25_tokens(F.coalesce("text", F.lit("")))).alias("dl"))
    return sized.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_len"))


def counted(tokens: str) -> Column:
    """array<struct<term, tf>> of a column of sorted tokens: lengths of the runs of equal ones."""
    t = F.col(tokens)
    starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, 2, F.size(t)), F.array(F.size(t) + 1))
    runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct(F.element_at(t, r["a"]).alias("term"), (r["b"] - r["a"]).cast("long").alias("tf")))
    return F.when(F.size(t) > 0, runs).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def repeated(docs: DataFrame) -> bool:
    """Whether a document has several rows."""
    return docs.groupBy("corpus", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0


def term_frequencies(docs: DataFrame, terms: DataFrame | None = None, lengths: bool = False) -> DataFrame:
    """corpus, doc_id, dl, term, tf; of the terms only, where given: postings of other terms are never moved. With ``lengths`` every document has a row for the empty term, too.

    Terms are counted within each text. Where documents have several rows, or ``terms`` are asked for, rows are dealt out by document, and what is grouped by document and anything more need not be moved again; else nothing is moved.
    """
    tokens = docs.select("corpus", "doc_id", F.sort_array(bm25_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    runs = counted("tokens")
    listed = F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"))), runs) if lengths else runs
    rows = tokens.select("corpus", "doc_id", F.size("tokens").cast("long").alias("dl"), F.explode(listed).alias("r")).select("corpus", "doc_id", "dl", "r.*")
    if terms is not None:
        wanted = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")) if lengths else terms
        few = terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS
        rows = rows.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    elif not repeated(docs):
        return rows
    return rows.repartition("corpus", "doc_id").groupBy("corpus", "doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_search(docs: DataFrame, queries: DataFrame, *, top_k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The best documents of each corpus for each (query_id, text): corpus, query_id, doc_id, score, rank.

    Texts are read and cut to tokens once: counts, lengths and scores all read the asked terms' postings, a row a document (``bm25_blocks``); only each task's best ``top_k`` of every question are shuffled.
    Beyond MOST_PAIRS, where ids are no numbers, or where documents have several rows, postings are joined (``joined_search``).
    """
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    pairs = asked.limit(MOST_PAIRS + 1).collect()
    numbered = dict(docs.dtypes)["doc_id"] in ("int", "bigint") and all(isinstance(r["query_id"], int) for r in pairs)
    if len(pairs) > MOST_PAIRS or not numbered or repeated(docs):
        return joined_search(docs, queries, top_k=top_k, k1=k1, b=b)
    terms = sorted({r["term"] for r in pairs})
    place = {t: i for i, t in enumerate(terms)}
    rows = settle(bm25_blocks.postings(docs, terms), "asked-postings")
    sizes = rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_len"))
    if sizes.limit(MOST_TERMS // max(len(terms), 1) + 1).count() * len(terms) > MOST_TERMS:
        return joined_search(docs, queries, top_k=top_k, k1=k1, b=b)
    corpora = {r["corpus"]: (i, r["n_docs"], r["avg_len"]) for i, r in enumerate(sizes.orderBy("corpus").collect())}
    weight = np.zeros((len(corpora), len(terms)))
    for r in rows.select("corpus", F.explode("ids").alias("id")).groupBy("corpus", "id").agg(F.count(F.lit(1)).alias("df")).collect():
        i, n, _ = corpora[r["corpus"]]
        weight[i, r["id"]] = np.log(1.0 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    listed = [(r["query_id"], place[r["term"]], r["qtf"]) for r in pairs]
    found = bm25_blocks.best(rows, listed, {c: avg for c, (_, _, avg) in corpora.items()}, weight, top_k=top_k, k1=k1, b=b)
    return ranked(found, ["corpus", "query_id"], [F.round("score", 9).desc(), "doc_id"], top_k)


def joined_search(docs: DataFrame, queries: DataFrame, *, top_k: int, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25_search`` for any number of questions, and for documents of several rows: postings are dealt out by document and joined with the asked terms; scores are summed in the document's task."""
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    near = lambda df, rows: F.broadcast(df) if rows <= MOST_TERMS else df
    terms, pairs = asked.agg(F.countDistinct("term"), F.count(F.lit(1))).first()
    corpora = docs.select("corpus").distinct().limit(MOST_TERMS + 1).count()
    postings = term_frequencies(docs, asked.select("term").distinct(), lengths=True)
    stats = postings.where("term = ''").groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_len"))
    tf = postings.where("term != ''")
    df = tf.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    known = df.join(stats, "corpus").select("corpus", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len")
    weighted = tf.join(near(known, terms * corpora), ["corpus", "term"]).join(near(asked, pairs), "term")
    length = k1 * (1.0 - b + b * F.col("dl") / F.col("avg_len"))
    one = F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + length) * F.col("qtf")
    scored = weighted.groupBy("corpus", "query_id", "doc_id").agg(F.sum(one).alias("score")).where("score > 0")
    return ranked(scored, ["corpus", "query_id"], [F.round("score", 9).desc(), "doc_id"], top_k)


def vector_search(vectors: DataFrame, queries: DataFrame, *, top_k: int, filters: dict[str, object] | None = None) -> DataFrame:
    """Exact cosine search: (vec_id, embedding, ...) for (query_id, embedding): query_id, vec_id, score, rank. ``filters``: columns of ``vectors`` and the value that each must have, as document_id and chunk_kind.

    Every vector is read once and met by every query, block by block (``blocks.against``): a matrix product gives each block's own best rows for every query, and only those are shuffled.
    """
    for column, wanted in (filters or {}).items():
        vectors = vectors.where(F.col(column) == F.lit(wanted))

    def start(asked: list[tuple]):
        ids, matrix = np.array([a for a, _ in asked], np.int64), _unit([v for _, v in asked])

        def best(rows: list[tuple]) -> list[tuple]:
            if not len(ids) or not rows:
                return []
            keys, found = np.array([k for k, _ in rows], np.int64), np.array([v for _, v in rows], float)
            norms = np.linalg.norm(found, axis=1)
            keys, found = keys[norms > 0], found[norms > 0] / norms[norms > 0][:, None]
            scores = matrix @ found.T
            n = min(top_k, scores.shape[1])
            if not n:
                return []
            cut = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
            q, v = np.nonzero(scores >= cut[:, None])  # ties at the cut stay
            return list(zip(ids[q].tolist(), keys[v].tolist(), scores[q, v].tolist()))

        return best

    asked = queries.select("query_id", "embedding").where("embedding is not null")
    found = against(vectors.select("vec_id", "embedding").where("embedding is not null"), asked, start, "query_id long, vec_id long, score double", ask_block=VECTOR_BLOCK)
    return ranked(found, ["query_id"], [F.round("score", 9).desc(), "vec_id"], top_k)


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, float)
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None] if len(rows) else m


def fuse(lists: DataFrame, weights: dict[str, float], *, k: int, by: tuple[str, ...] = ("query_id",), key: tuple[str, ...] = ("page",), top_k: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of (by, key, source, rank).

    A source without a positive weight is left out. A key counts once a source, at its first rank; ranks are not closed up after repeats. Ties go to the key
    that was seen first, sources in the order of ``weights``.
    """
    live = {s: w for s, w in weights.items() if w > 0}
    order = F.create_map(*(F.lit(x) for s in live for x in (s, list(weights).index(s))))
    weight = F.create_map(*(F.lit(x) for s, w in live.items() for x in (s, float(w))))
    first = lists.where(F.col("source").isin(*live)).groupBy(*by, *key, "source").agg(F.min("rank").alias("rank"))
    scored = first.groupBy(*by, *key).agg(
        F.sum(weight[F.col("source")] / (F.lit(float(k)) + F.col("rank"))).alias("score"),
        F.min(F.struct(order[F.col("source")].alias("s"), "rank")).alias("seen"),
        F.array_sort(F.collect_list(F.struct("source", "rank"))).alias("rank_sources"),
    )
    return ranked(scored, list(by), [F.round("score", 9).desc(), "seen", *key], top_k).drop("seen")


def fuse_variants(lists: DataFrame, variants: list[tuple[int, dict[str, float], int]], *, top_k: int) -> DataFrame:
    """``fuse`` by query_id and page for each (variant, weights, k): variant, query_id, page, rank. A question's pages are gathered once, in one row, and every variant ranks them there. Scores count to nine digits."""
    sources = list(dict.fromkeys(s for _, w, _ in variants for s in w))
    ranks = [F.min(F.when(F.col("source") == s, F.col("rank"))).alias(s) for s in sources]
    pages = lists.groupBy("query_id", "page").agg(*ranks).groupBy("query_id").agg(F.collect_list(F.struct("page", *sources)).alias("pages"))

    def best(variant: int, weights: dict[str, float], k: int) -> Column:
        live = [(i, s, w) for i, (s, w) in enumerate(weights.items()) if w > 0]
        score = lambda x: F.round(sum((F.coalesce(w / (F.lit(float(k)) + x[s]), F.lit(0.0)) for _, s, w in live), F.lit(0.0)), 9)
        seen = lambda x: F.coalesce(*(F.when(x[s].isNotNull(), F.struct(F.lit(i).alias("i"), x[s].alias("r"))) for i, s, _ in live))
        known = F.filter("pages", lambda x: F.coalesce(*(x[s] for _, s, _ in live)).isNotNull())
        order = F.array_sort(F.transform(known, lambda x: F.struct((-score(x)).alias("score"), seen(x).alias("seen"), x["page"].alias("page"))))
        return F.transform(F.slice(order, 1, top_k), lambda x, at: F.struct(F.lit(variant).cast("long").alias("variant"), x["page"].alias("page"), (at + 1).cast("long").alias("rank")))

    every = F.flatten(F.array(*(best(*v) for v in variants)))
    return pages.select("query_id", F.explode(every).alias("r")).select("r.variant", "query_id", "r.page", "r.rank")


def semantic_floor(fused: DataFrame, semantic: DataFrame, *, count: int, top_k: int) -> DataFrame:
    """The first ``count`` pages of the semantic list stand first, the fused list's other pages follow: query_id, page, pos."""
    first = semantic.groupBy("query_id", "page").agg(F.min("rank").alias("rank"))
    floor = ranked(first, ["query_id"], ["rank", "page"], count, "pos").select("query_id", "page", F.lit(0).alias("part"), "pos")
    rest = fused.select("query_id", "page", F.lit(1).alias("part"), F.col("rank").alias("pos")).join(floor.select("query_id", "page"), ["query_id", "page"], "left_anti")
    return ranked(floor.unionByName(rest), ["query_id"], ["part", "pos", "page"], top_k, "place").select("query_id", "page", F.col("place").alias("pos"))


def bm25_cap(fused: DataFrame, semantic: DataFrame, *, cap: int, top_k: int) -> DataFrame:
    """At most ``cap`` pages that the semantic list lacks: query_id, page, pos."""
    marked = fused.join(semantic.select("query_id", "page", F.lit(True).alias("known")).distinct(), ["query_id", "page"], "left").withColumn("alone", F.col("known").isNull().cast("int"))
    so_far = F.sum("alone").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = marked.withColumn("so_far", so_far).where((F.col("alone") == 0) | (F.col("so_far") <= cap))
    return ranked(kept, ["query_id"], ["rank", "page"], top_k, "pos").select("query_id", "page", "pos")


def overlap_boost(fused: DataFrame, semantic: DataFrame, bm25: DataFrame, *, weight: float, k: int) -> DataFrame:
    """Pages in both lists gain weight / (k + 1); then by score, ties as before: query_id, page, score, pos."""
    both = semantic.select("query_id", "page").intersect(bm25.select("query_id", "page")).withColumn("both", F.lit(True))
    boosted = fused.join(both, ["query_id", "page"], "left").withColumn("score", F.col("score") + F.when(F.col("both"), weight / (k + 1)).otherwise(0.0))
    return ranked(boosted, ["query_id"], [F.round("score", 9).desc(), "rank"], None, "pos").select("query_id", "page", "score", "pos")


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first by ``order``; an aggregate, so rows combine before the shuffle."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def union_dedupe(primary: DataFrame, fallback: DataFrame, key: list[str], order: str, top_k: int, by: list[str]) -> DataFrame:
    """Primary rows before fallback rows, one of each key, the first ``top_k`` of each group."""
    both = primary.withColumn("__part", F.lit(0)).unionByName(fallback.withColumn("__part", F.lit(1)))
    first = dedupe_first(both, [*by, *key], ["__part", order])
    return ranked(first, by, ["__part", order, *key], top_k, "pos").drop("__part")


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, by: str, always: Column | None = None) -> DataFrame:
    """Fallback rows count where the group has no primary row, or where ``always`` holds."""
    have = primary.select(by).distinct().withColumn("__have", F.lit(True))
    used = fallback.join(have, by, "left").where(F.col("__have").isNull() | (always if always is not None else F.lit(False))).drop("__have")
    return primary.withColumn("source", F.lit("primary")).unionByName(used.withColumn("source", F.lit("fallback")))


def keyword_fallback(docs: DataFrame, terms: list[str], *, top_k: int = 2, by: str = "corpus") -> DataFrame:
    """Documents by the number of terms they have; a term with a blank never matches, for texts are compared without white space."""
    text = compact(F.coalesce("text", F.lit("")))
    n = sum((F.contains(text, F.lit(t.lower())).cast("long") for t in terms), F.lit(0))
    scored = docs.withColumn("score", n).where("score > 0")
    return ranked(scored, [by], [F.desc("score"), "doc_id"], top_k).select(by, "doc_id", "score", "rank")


#: Plans by intent: primary kind, fallback kind, whether the fallback always joins in, and how many rows each gives.
STRATEGIES = {
    "page_text_hybrid": {
        "metric_value": ("page_text", None, False, 6, 0),
        "metric_attribution": ("section_text", "page_text", True, 4, 4),
        "business_narrative": ("section_text", "page_text", True, 4, 4),
    },
    "legacy": {
        "metric_value": ("table_row", "page_text", True, 8, 4),
        "metric_attribution": ("section_text", "table_row+page_text", True, 4, 3),
        "business_narrative": ("section_text", "page_text", False, 6, 6),
    },
}


def strategy(df: DataFrame, mode: str, intent: str = "intent", question: str = "question", section_terms: tuple[str, ...] = (), page_terms: tuple[str, ...] = (), table_terms: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with primary and fallback kinds: by intent, else by terms in the question, else page text."""
    q = compact(F.coalesce(F.col(question), F.lit("")))
    has = lambda terms: F.coalesce(F.array_max(F.array(*(F.contains(q, compact(F.lit(t))) for t in terms), F.lit(False))), F.lit(False))
    by_intent = STRATEGIES[mode]
    if mode == "legacy":
        ladder = [(has(table_terms), ("table_row", "page_text")), (has(page_terms), ("page_text", None)), (has(section_terms), ("section_text", "page_text"))]
    else:
        ladder = [(has(section_terms), ("section_text", "page_text")), (has(page_terms), ("page_text", None))]
    for name, i in (("primary_kind", 0), ("fallback_kind", 1)):
        out = None
        for k, v in by_intent.items():
            out = F.when(F.col(intent) == k, F.lit(v[i])) if out is None else out.when(F.col(intent) == k, F.lit(v[i]))
        for test, kinds in ladder:
            out = out.when(test, F.lit(kinds[i]))
        df = df.withColumn(name, out.otherwise(F.lit("page_text" if not i else None)).cast("string"))
    return df


def boosted(df: DataFrame, rules: list[tuple[Column, float]], order: list) -> DataFrame:
    """Rows by the sum of the boosts of the rules that hold, ties in the old order."""
    total = sum((F.when(test, F.lit(delta)).otherwise(F.lit(0.0)) for test, delta in rules), F.lit(0.0))
    return df.withColumn("boost", total).withColumn("__order", F.struct(*order))
