"""Source divergence audit: how far the sources of a language differ in their terms, by an inverted index of corrections.

Terms are runs of letters and characters beyond ASCII, ASCII letters lowered; each language keeps the V terms that ``min_docs`` of its documents
have. A source's p of a term is 1 + floor(10^9 (count + 5) / (N + 5 V)), N the sum of its counts over kept terms. Two sources are as far apart as
the sum of |p - p'| over all kept terms.

Most terms are missing in most sources, and a missing term has one p for each source, p0. So a pair starts from V |p0 - p0'|, as if it had no
term at all, and the index adds what differs from that:

* a source's own terms: |p - p0'| - |p0 - p0'|. That depends on the term by p alone, so terms of equal count are one row;
* terms that both have: |p - p'| - |p - p0'| - |p0 - p'| + |p0 - p0'|, from the postings of the term. Tasks add them up in matrices of BLOCK x
  BLOCK sources, of which they hold few at a time; zeros are not given out.

So the work follows the postings, and not V times the pairs. Words are counted in the tasks, (language, source, term) rows move; one source that has a
third of all documents costs a row a task and term. A term's postings are as many as the sources of its language. Sums are 64-bit integers;
p is made from exact decimals.

Defined results: null text, lang and source are ''; rows are documents, be their doc_id repeated or null; very long texts are read whole; a
group without kept terms has N 0, and a language without any has V 0 and pairs of value 0; a language of one source has no pairs; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.llm.common import settle, small, small_batches

MIN_DOCS, SMOOTH, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Sources a side of a matrix, and matrices that a task holds.
BLOCK, MATRICES = 128, 64
#: Terms, and their bytes, that a task counts before it gives them out.
TASK_TERMS, TASK_BYTES = 300_000, 32 << 20
WORDS = re.compile(rb"[a-z\x80-\xff]+").findall


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) as counted in each task, and a row with a null term for each group that a task has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        terms = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in held.items():
                words = [None, *n]
                cols = [pa.array([lang] * len(words)), pa.array([source] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(of.__getitem__, n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.ascii_lower(b.column(2)).cast(pa.binary())):
                n, of = held.setdefault((lang, source), (Counter(), Counter()))
                found, before = Counter(WORDS(text.as_py())), len(n)
                n.update(found)
                of.update(found.keys())
                if len(n) > before:
                    terms += len(n) - before
                    size += sum(map(len, found))
            if terms >= TASK_TERMS or size >= TASK_BYTES:
                yield from out()
                held, terms, size = {}, 0, 0
        yield from out()

    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return small_batches(docs.select(*cols)).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH v)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, (total + SMOOTH * v).cast("decimal(20,0)"))


def inverted_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The index (lang, term, total, postings of (source, n)) of kept terms, and the groups (lang, source, sid, n, v, p0, lang_n); both written."""
    every = settle(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    postings = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("postings")
    index = settle(every.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), postings).where(F.col("docs") >= min_docs).drop("docs"), "term-index")
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n")).withColumnRenamed("lang", "l")
    sums = index.select(F.col("lang").alias("l"), F.explode("postings").alias("x")).groupBy("l", F.col("x.source").alias("s")).agg(F.sum("x.n").alias("n"))
    groups = every.where("term is null").select("lang", "source").withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.join(sums, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").drop("l", "s")
    groups = groups.join(langs, F.col("lang") == F.col("l"), "left").drop("l").fillna(0, ["n", "v", "lang_n"])
    return index, settle(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v")))), "term-groups")


def placed_terms(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, source, sid, p, p0, q): each posting with its group's p and the language's q."""
    posted = index.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("count"))
    met = posted.join(small(groups, groups.count()), ["lang", "source"])
    return met.select("lang", "term", "source", "sid", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "p0", share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))


def shared_corrections(terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, i, j, value), i < j: what terms that both sources have add, summed up within each task."""
    lists = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("at")).where(F.size("at") > 1)
    lists = lists.select("lang", "at.sid", "at.p", "at.p0")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), m in sums.items():
                if i == j:
                    m = np.triu(m, 1)
                a, b = np.nonzero(m)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a + i * block, pa.int32()), pa.array(b + j * block, pa.int32()), pa.array(m[a, b])], names=["lang", "i", "j", "value"])

        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for k, lang in enumerate(columns[0].to_pylist()):
                sid, p, p0 = (c[k].values.to_numpy() for c in columns[1:])
                order = np.argsort(sid)
                sid, p, p0 = sid[order], p[order], p0[order]
                ends = [0, *(np.flatnonzero(np.diff(sid // block)) + 1).tolist(), len(sid)]
                blocks = [slice(x, y) for x, y in zip(ends, ends[1:])]
                for x, left in enumerate(blocks):
                    for right in blocks[x:]:
                        a, b, c, d = p[left, None], p[None, right], p0[left, None], p0[None, right]
                        key = (lang, int(sid[left.start]) // block, int(sid[right.start]) // block)
                        if key not in sums:
                            if len(sums) >= MATRICES:
                                yield from out()
                                sums = {}
                            sums[key] = np.zeros((block, block), np.int64)
                        sums[key][np.ix_(sid[left] % block, sid[right] % block)] += np.abs(a - b) - np.abs(a - d) - np.abs(c - b) + np.abs(c - d)
        yield from out()

    return small_batches(lists).mapInArrow(add, "lang string, i int, j int, value long")


def distances(terms: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) of all pairs of a language's sources, both ways."""
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    ends = groups.select("lang", "source", "sid", "v", "p0")
    others = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("of"), F.col("p0").alias("q0"))
    base = ends.join(others, "lang").where("sid <> of").select("lang", "sid", "of", F.coalesce(F.col("v") * far("p0", "q0"), F.lit(0)).alias("value"))
    own = terms.groupBy("lang", "sid", "p", "p0").agg(F.count(F.lit(1)).alias("times")).join(others, "lang").where("sid <> of")
    own = own.groupBy("lang", "sid", "of").agg(F.sum(F.col("times") * (far("p", "q0") - far("p0", "q0"))).alias("value"))
    once = base.where("sid < of").unionByName(own.select("lang", F.least("sid", "of").alias("sid"), F.greatest("sid", "of").alias("of"), "value"))
    once = once.unionByName(shared_corrections(terms, block).select("lang", F.col("i").alias("sid"), F.col("j").alias("of"), "value"))
    whole = once.groupBy("lang", "sid", "of").agg(F.sum("value").alias("value"))
    both = whole.select("lang", "value", F.explode(F.array(F.struct("sid", "of"), F.struct(F.col("of").alias("sid"), F.col("sid").alias("of")))).alias("x")).select("lang", "x.*", "value")
    named = both.join(small(ends, n := groups.count()).select("lang", "sid", "source"), ["lang", "sid"]).join(small(others, n).select("lang", "of", "item"), ["lang", "of"])
    return named.select("lang", "source", "item", "value")


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: every other source by distance, and the terms that a group has most above its language."""
    index, groups = inverted_index(docs, min_docs)
    terms = settle(placed_terms(index, groups), "term-places")
    above = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = ranked(distances(terms, groups, block)).withColumn("part", F.lit("pair")), ranked(above).where(F.col("rank") <= term_ranks).withColumn("part", F.lit("term"))
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(s.n, 0) AS n FROM g LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS cnt, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (m.n + 5 * m.v) AS p
  FROM m JOIN kept k USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
above AS (SELECT p.lang, p.source, p.term AS item, p - (1 + CAST(1000000000 AS HUGEINT) * (total + 5) // (l.n + 5 * l.v)) AS value FROM p JOIN kept USING (lang, term) JOIN l USING (lang) WHERE cnt > 0)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM above WHERE value > 0) WHERE rank <= 50
"""
