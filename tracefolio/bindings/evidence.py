"""Evidence: documents as pages, their lines as lines of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefolio.bindings.retrieval import BM25
from tracefolio.functions import text as T
from tracefolio.operators import evidence as ops
from tracefolio.operators import cases, chat, locator, retrieval, review, sections
from tracefolio.operators.documents import each
from tracefolio.plans import workflow
from tracefolio.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def bind(sql: str):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


COMPACT = "regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g')"
LS = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
LINES = f"WITH l AS (SELECT doc_id, source, lang, {LS} AS ls FROM documents), x AS (SELECT doc_id, source, lang, len(ls) AS n_lines, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l) "


@bind(f"SELECT doc_id, md5({COMPACT}) AS digest FROM documents")
def normalize_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-01 (native variant)."""
    return docs(spark, sf_dir).select("doc_id", F.md5(T.compact(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@bind("SELECT doc_id, CASE WHEN length(text) <= 260 THEN text ELSE rtrim(substr(text, 1, 257), ' ' || chr(10)) || '...' END AS quote FROM documents")
def truncate_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-02."""
    return docs(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 260).alias("quote"))


@bind("SELECT doc_id, rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 180)) AS preview FROM documents")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-03."""
    return docs(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


@bind(f"SELECT doc_id, CAST(len({LS}) AS BIGINT) AS n_lines, CAST(coalesce(list_max(list_transform({LS}, lambda x: length(x))), 0) AS BIGINT) AS longest FROM documents")
def clean_lines_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-03."""
    ls = T.lines(F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.size(ls).cast("long").alias("n_lines"), F.coalesce(F.array_max(F.transform(ls, F.length)), F.lit(0)).cast("long").alias("longest"))


@bind("SELECT doc_id, CAST(k - 1 AS BIGINT) AS page, part AS text FROM (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(part) <> ''")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-08: a text cut to pages at its separator; blank pages go, numbers keep the gap."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).where("trim(text) != ''").withColumn("page", F.col("page").cast("long"))


@bind(LINES + "SELECT doc_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM x WHERE NOT (line_no <= 4 AND regexp_matches(line, '^[0-9]+$')) AND NOT contains(line, 'License')) WHERE line IS DISTINCT FROM b")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-07: frame lines go by place and content, then repeats of the line before."""
    drop = ((F.col("line_no") <= 4) & F.col("line").rlike("^[0-9]+$")) | F.contains("line", F.lit("License"))
    return ops.clean_lines(docs(spark, sf_dir), "doc_id", drop).withColumn("line_no", F.col("line_no").cast("long"))


@bind(LINES + "SELECT doc_id, line_no, md5(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING), chr(10))) AS digest FROM x")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-05: lines around every line."""
    x = docs(spark, sf_dir).select("doc_id", T.lines(F.coalesce("text", F.lit(""))).alias("ls")).select("doc_id", "ls", F.posexplode("ls").alias("line_no", "line"))
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(F.array_join(T.context(F.col("ls"), F.col("line_no"), 3, 5), "\n").cast("binary")).alias("digest"))


@bind(LINES + "SELECT doc_id, line_no AS i, CAST(k AS BIGINT) AS n, md5(t) AS digest FROM (SELECT doc_id, line_no, unnest([1, 2, 3]) AS k, unnest([line, line || ' ' || a, line || ' ' || a || ' ' || b]) AS t FROM (SELECT *, lead(line) OVER w AS a, lead(line, 2) OVER w AS b FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))) WHERE t IS NOT NULL")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-06: one to three lines."""
    ls = docs(spark, sf_dir).select("doc_id", T.lines(F.coalesce("text", F.lit(""))).alias("ls"))
    w = ls.select("doc_id", F.explode(T.windows(F.col("ls"))).alias("w"))
    return w.select("doc_id", F.col("w.i").cast("long").alias("i"), F.col("w.n").cast("long").alias("n"), F.md5(F.col("w.text").cast("binary")).alias("digest"))


TERMS = ["license", "the and", "thing", "apache"]


@bind(f"SELECT doc_id, array_to_string(list_filter(['license', 'the and', 'thing', 'apache'], lambda t: contains({COMPACT}, replace(t, ' ', ''))), ',') AS terms FROM documents")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-07."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.matched_terms(F.coalesce("text", F.lit("")), TERMS), ",").alias("terms"))


SECTION = [("legal", ["license", "apache"]), ("narrative", ["thing", "that", "with"]), ("table", ["|"])]


@bind(f"SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'other' WHEN a >= b AND a >= c THEN 'legal' WHEN b >= c THEN 'narrative' ELSE 'table' END AS section FROM (SELECT doc_id, CAST(contains(t, 'license') AS INTEGER) + CAST(contains(t, 'apache') AS INTEGER) AS a, CAST(contains(t, 'thing') AS INTEGER) + CAST(contains(t, 'that') AS INTEGER) + CAST(contains(t, 'with') AS INTEGER) AS b, CAST(contains(t, '|') AS INTEGER) AS c FROM (SELECT doc_id, {COMPACT} AS t FROM documents))")
def section_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-14."""
    return docs(spark, sf_dir).select("doc_id", ops.section_type(F.coalesce("text", F.lit("")), SECTION).alias("section"))


SEARCH = f"""WITH p AS (SELECT source, doc_id, coalesce(text, '') AS text, {COMPACT} AS t FROM documents),
s AS (SELECT *, least(40, 5 * (CAST(contains(t, 'license') AS INTEGER) + CAST(contains(t, 'theand') AS INTEGER) + CAST(contains(t, 'thing') AS INTEGER) + CAST(contains(t, 'apache') AS INTEGER))) AS term_score,
  least(12, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?\\s*(?:%|个百分点|百万元|亿元|元|TEU|吨|次)?')) // 2) AS numeric_score,
  least(16, 2 * len(list_filter({LS.replace("coalesce(text, '')", "text")}, lambda l: len(regexp_extract_all(l, '[0-9]+(?:[.,][0-9]+)?')) >= 2 AND regexp_matches(l, '[一-鿿A-Za-z]')))) AS table_score, least(12, 4 * CAST(contains(t, 'version') AS INTEGER)) AS section_score,
  CASE WHEN contains(t, 'apachelicense') THEN 10 ELSE 0 END AS exact_score FROM p),
r AS (SELECT *, term_score + numeric_score + table_score + section_score + exact_score AS score FROM s WHERE term_score > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term_score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5) """


def searched(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    return ops.search_pages(docs(spark, sf_dir), TERMS, query="Apache License", table=True, section_words=["version"], narrative=False, top_pages=top, by="source")


PARTS = ["term_score", "numeric_score", "table_score", "section_score", "exact_score", "score", "rank"]


@bind(SEARCH + f"SELECT source, doc_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in PARTS)} FROM top")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-17, RT-23."""
    return searched(spark, sf_dir, 5).select("source", "doc_id", *(F.col(c).cast("long").alias(c) for c in PARTS))


@bind(SEARCH + "SELECT source, doc_id, CASE WHEN score >= 32 THEN 'high' WHEN score >= 14 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN score >= 32 AND term_score >= 10 AND table_score > 0 THEN 'auto_anchor_high_confidence' WHEN score > 0 THEN 'auto_anchor_low_confidence' ELSE 'needs_manual_probe' END AS status FROM top")
def anchor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-18."""
    s = searched(spark, sf_dir, 5)
    return s.select("source", "doc_id", ops.confidence(F.col("score")).alias("confidence"), ops.anchor_status(F.col("score"), F.col("term_score") / 5, F.col("table_score") > 0).alias("status"))


@bind(SEARCH + "SELECT source, array_to_string(list(doc_id ORDER BY doc_id), ',') AS pages, count(*) AS n FROM top WHERE rank <= 3 AND term_score >= 5 GROUP BY source")
def anchor_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-19: the anchor pages of each file."""
    s = searched(spark, sf_dir, 3).where("term_score >= 5")
    return s.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d.cast("string")), ",").alias("pages"), F.count(F.lit(1)).alias("n"))


@bind(f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE contains({COMPACT}, 'license') OR contains({COMPACT}, 'apache') QUALIFY rank <= 4")
def keyword_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-07: the first pages with a keyword."""
    t = T.compact(F.coalesce("text", F.lit("")))
    hits = docs(spark, sf_dir).where(F.contains(t, F.lit("license")) | F.contains(t, F.lit("apache")))
    return retrieval.ranked(hits, ["source"], ["doc_id"], 4).select("source", "doc_id", "rank")


@bind("SELECT source, doc_id, CAST(CASE WHEN n <= 2 THEN n ELSE 2 + m END AS BIGINT) AS pos FROM (SELECT source, doc_id, s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS m FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS s FROM documents)) WHERE n <= 2 OR (m <= 4 AND s > 0)")
def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-05: two front pages and the four with most numbers."""
    out = ops.page_budget(docs(spark, sf_dir), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9]+")), front=2, top=4, by="source", order="doc_id")
    return out.select("source", "doc_id", F.col("pos").cast("long").alias("pos"))


@bind("WITH p AS (SELECT doc_id, [doc_id % 5, doc_id % 3, doc_id % 7, doc_id % 2] AS f, [doc_id % 5, doc_id % 3, doc_id % 7, doc_id % 2, doc_id % 4, doc_id % 6] AS a FROM documents) SELECT doc_id, array_to_string(list_filter(f, lambda v, i: list_position(f, v) = i), ',') AS pages, array_to_string(list_filter(a, lambda v, i: list_position(a, v) = i), ',') AS every FROM p")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-06: shared pages before a field's pages, each once; and the pages of all fields."""
    k = F.col("doc_id")
    shared, revenue, unit = F.array(k % 5, k % 3), F.array(k % 7, k % 2), F.array(k % 4, k % 6)
    text = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",")
    return docs(spark, sf_dir).select("doc_id", text(review.pages_for(shared, revenue)).alias("pages"), text(review.all_pages(shared, F.array(revenue, unit))).alias("every"))


@bind(LINES + """, r AS (SELECT doc_id, line_no, CASE WHEN contains(k, 'license') THEN 'licence' WHEN contains(k, 'token') THEN 'secret' WHEN contains(k, '@') THEN 'mail' END AS row_label FROM (SELECT *, regexp_replace(lower(line), '\\s+', '', 'g') AS k FROM x) WHERE length(k) > 0 AND length(k) <= 90 AND NOT (length(k) > 45 AND regexp_matches(line, '[，。；:：]'))),
c AS (SELECT doc_id, line_no, list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING) AS ctx FROM x),
j AS (SELECT doc_id, line_no, row_label, array_to_string(ctx, chr(10)) AS context FROM r JOIN c USING (doc_id, line_no) WHERE row_label IS NOT NULL),
f AS (SELECT doc_id, row_label, min(line_no) AS line_no FROM j WHERE regexp_matches(context, '[0-9]') GROUP BY doc_id, row_label, regexp_replace(lower(context), '\\s+', '', 'g')),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, row_label ORDER BY line_no) <= 24) SELECT doc_id, line_no, row_label FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no, row_label) <= 120""")
def table_row_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-04, WN-08."""
    out = ops.table_rows(docs(spark, sf_dir), [("licence", ["license"]), ("secret", ["token"]), ("mail", ["@"])])
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "row_label")


@bind("SELECT l_orderkey, l_linenumber, 'Table row: ' || l_returnflag || chr(10) || 'Metric tags: ' || l_returnflag || ', ' || l_linestatus || chr(10) || 'Page: ' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || 'Period: fy' || year(l_shipdate) ELSE '' END || chr(10) || 'Context:' || chr(10) || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS text FROM lineitem")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-23."""
    l = table(spark, sf_dir, "lineitem")
    period = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("fy"), F.year("l_shipdate").cast("string")))
    return l.select("l_orderkey", "l_linenumber", ops.compose_row(F.col("l_returnflag"), F.array("l_returnflag", "l_linestatus"), F.col("l_linenumber"), period, F.col("l_quantity").cast("long").cast("string")).alias("text"))


@bind("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS a FROM lineitem QUALIFY a <= 2) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 3")
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-08: two rows a label, then three a document."""
    one = retrieval.ranked(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"], 2, "a")
    return retrieval.ranked(one, ["l_orderkey"], ["l_linenumber", "l_partkey"], 3, "b").select("l_orderkey", "l_partkey", "l_linenumber")


@bind("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_quantity, -l_linenumber)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-06."""
    order = F.struct("l_extendedprice", -F.col("l_quantity"), -F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", order).alias("l_partkey"))


#: The best documents of all for each question, and their texts.
HITS = BM25.replace("source AS corpus", "'all' AS corpus") + ", r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS pos FROM scored QUALIFY pos <= {k}), hits AS (SELECT query_id, pos, o.* FROM r JOIN documents o USING (doc_id)) "


def hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """query_id, pos and the columns of documents, of the ``k`` best for each question of benchmark."""
    d = docs(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = retrieval.bm25_search(d.select(F.lit("all").alias("corpus"), "doc_id", "text"), asked, top_k=k)
    found = found.select("query_id", "doc_id", F.col("rank").alias("pos"))
    # texts stay where they lie: the few rows found go to them
    few = asked.limit(retrieval.MOST_PAIRS + 1).count() <= retrieval.MOST_PAIRS
    return d.join(F.broadcast(found) if few else found, "doc_id")


@bind(LINES + """, t AS (SELECT doc_id, line_no, line AS title, CASE WHEN lang = 'en' THEN 'other' ELSE 'risk' END AS section FROM x)
SELECT doc_id, line_no, concat_ws(',', CASE WHEN regexp_matches(title, '^[0-9]+(\\.[0-9]+)?\\s*[%％]$') THEN 'naked_percent' END, CASE WHEN regexp_matches(title, '^(19|20)[0-9]{2}(年|[-/.年][0-9]{1,2}(月|[-/.月][0-9]{1,2}日?)?)?$') THEN 'date_like' END, CASE WHEN regexp_matches(title, '[樓楼室街路號号]|大厦|大廈') THEN 'address_like' END,
  CASE WHEN contains(title, '...') OR ends_with(title, '…') THEN 'truncated' END, CASE WHEN length(title) BETWEEN 2 AND 4 AND section = 'other' THEN 'short_other' END, CASE WHEN regexp_matches(title, '^[0-9][0-9.,]*\\s*($|[月日%％點点倍次戶户])') THEN 'numeric_fragment' END) AS reasons
FROM (SELECT doc_id, line_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, section FROM t)""")
def suspicious_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-28: every line of every document as a title; the reasons are empty where it looks like one."""
    ls = ops.explode_lines(docs(spark, sf_dir).select("doc_id", "lang", "text"))
    section = F.when(F.col("lang") == "en", "other").otherwise("risk")
    return ls.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join(ops.suspicious(F.col("line"), section), ",").alias("reasons"))


@bind(LINES + "SELECT lang, count(*) AS n, count(DISTINCT line) AS titles, CAST(sum(CASE WHEN length(line) > 100 THEN 1 ELSE 0 END) AS BIGINT) AS noisy, round(sum(CASE WHEN length(line) > 100 THEN 1 ELSE 0 END) / count(*), 3) AS noise_rate FROM x GROUP BY lang")
def title_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-15: all lines as titles."""
    t = ops.explode_lines(docs(spark, sf_dir).select("lang", "text")).withColumnRenamed("line", "title")
    noisy = F.count_if(F.length("title") > 100)
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"), noisy.alias("noisy"), F.round(noisy / F.count(F.lit(1)), 3).alias("noise_rate"))


@bind(HITS.format(k=3) + f", m AS (SELECT query_id, {LS}[1] AS line FROM hits) SELECT query_id, CASE WHEN bool_and(length(line) > 100 OR length(line) < 4) THEN 'page_text' ELSE 'section_text' END AS kind FROM m WHERE line IS NOT NULL GROUP BY query_id")
def title_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-16: sections unless the titles of a question's first three hits are all junk."""
    t = hits(spark, sf_dir, 3).select("query_id", F.try_element_at(T.lines(F.coalesce("text", F.lit(""))), F.lit(1)).alias("line")).where("line is not null")
    junk = (F.length("line") > 100) | (F.length("line") < 4)
    return t.groupBy("query_id").agg(F.when(F.bool_and(junk), "page_text").otherwise("section_text").alias("kind"))


@bind(f"SELECT item_id AS quote_id, doc_id FROM benchmark b, documents d WHERE contains({COMPACT.replace('text', 'd.text')}, {COMPACT.replace('text', 'b.text')})")
def citation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-11: pages that hold a quote."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return ops.quote_pages(quotes, docs(spark, sf_dir).select("doc_id", "text")).select("quote_id", "doc_id")


@bind(f"SELECT item_id AS quote_id, min(doc_id) AS doc_id FROM benchmark b, documents d WHERE contains({COMPACT.replace('text', 'd.text')}, {COMPACT.replace('text', 'b.text')}) GROUP BY item_id")
def citation_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-12: the first page of each quote."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return ops.quote_pages(quotes, docs(spark, sf_dir).select("doc_id", "text")).groupBy("quote_id").agg(F.min("doc_id").alias("doc_id"))


@bind(f"WITH m AS (SELECT item_id, count(doc_id) AS pages FROM benchmark b LEFT JOIN documents d ON contains({COMPACT.replace('text', 'd.text')}, {COMPACT.replace('text', 'b.text')}) GROUP BY item_id) SELECT item_id AS point_id, CASE WHEN pages > 0 THEN 'verified' ELSE 'needs_review' END AS status, CASE WHEN pages = 0 THEN 'citation_missing' END AS issue FROM m")
def verify_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-13, ST-05: every point with its citation or an issue."""
    points = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    found = ops.quote_pages(points, docs(spark, sf_dir).select("doc_id", "text")).select("quote_id").distinct().withColumn("ok", F.lit(True))
    j = points.join(found, "quote_id", "left")
    return j.select(F.col("quote_id").alias("point_id"), F.when(F.col("ok"), "verified").otherwise("needs_review").alias("status"), F.when(F.col("ok").isNull(), "citation_missing").alias("issue"))


_COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))[1:500]"


@bind(
    f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS a, replace(coalesce(text, ''), chr(10), '  ') AS b, CASE WHEN doc_id % 2 = 0 THEN 'w ' || coalesce(text, '') END AS c FROM documents), k AS (SELECT *, {_COLLAPSED.format('a')} AS ka, {_COLLAPSED.format('b')} AS kb, {_COLLAPSED.format('c')} AS kc FROM r)
SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN ka <> '' THEN a END, CASE WHEN kb <> '' AND kb <> ka THEN b END, CASE WHEN kc <> '' AND kc <> ka AND kc <> kb THEN c END)) AS digest FROM k WHERE ka <> '' OR kb <> '' OR kc <> ''"""
)
def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-11: three readings of each page; those that begin like an earlier one go."""
    text = F.coalesce("text", F.lit(""))
    modes = [("text", text), ("blocks", F.replace(text, F.lit("\n"), F.lit("  "))), ("words", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("w "), text)))]
    readings = docs(spark, sf_dir).select("doc_id", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), t.alias("text")) for m, t in modes))).alias("r")).select("doc_id", "r.*")
    return ops.deep_pages(readings, ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@bind("SELECT source, doc_id, md5(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')[1:500]) AS k FROM documents QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY doc_id) = 1")
def dedupe_prefix500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-11: page texts of a source that begin alike count once."""
    k = F.md5(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", ""), 1, 500).cast("binary"))
    return docs(spark, sf_dir).withColumn("k", k).groupBy("source", "k").agg(F.min("doc_id").alias("doc_id"))


READ = """WITH d AS (SELECT source AS document_id, CAST(doc_id AS INTEGER) AS page, quality = 1 AS found, toxic, quality, l.doc_id FROM labels l JOIN documents USING (doc_id) WHERE n_chars > 300),
f AS (SELECT document_id, quality = 1 AS ok, CAST(doc_id AS VARCHAR) AS field FROM d WHERE toxic = 0), s AS (SELECT DISTINCT source AS document_id FROM documents), n AS (SELECT document_id, count(*) AS n FROM d GROUP BY ALL),
i AS (SELECT document_id, 'summary' AS scope, 'p' || doc_id AS item_key, 'review' AS severity, 'citation_missing' AS reason FROM d WHERE NOT found UNION ALL SELECT document_id, 'fact', field, 'review', 'citation_missing' FROM f WHERE NOT ok
  UNION ALL SELECT document_id, 'summary', 'summary_output', CASE WHEN coalesce(n, 0) = 0 THEN 'review' ELSE 'warning' END, 'summary_incomplete' FROM s LEFT JOIN n USING (document_id) WHERE coalesce(n, 0) < 6) """


def filings(spark: SparkSession, sf_dir: str) -> workflow.Result:
    """Sources as filings, texts as their pages; of labelled texts the good ones are quoted rightly."""
    d = docs(spark, sf_dir)
    j = table(spark, sf_dir, "labels").join(d, "doc_id").where("n_chars > 300")
    key = F.col("source").alias("document_id")
    good = F.col("quality") == 1
    points = j.select(key, F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("item_key"), F.lit("t").alias("text"), F.col("doc_id").cast("int").alias("evidence_page"), F.when(good, F.substring("text", 1, 120)).otherwise("qzqz wvwv zqzq vwvw").alias("evidence_quote"))
    facts = j.where("toxic = 0").select(key, F.col("doc_id").cast("string").alias("field"), F.lit(1.0).alias("value"), F.when(good, 1).otherwise(0).alias("n_citations"))
    return workflow.read_filings(d.select(key).distinct(), d.select(key, F.col("doc_id").cast("int").alias("page_number"), "text"), points, facts)


@bind(READ + "SELECT document_id, scope, item_key, severity, reason FROM i")
def workflow_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-05: what the verifier finds when both branches have ended."""
    return filings(spark, sf_dir).issues.select("document_id", "scope", "item_key", "severity", "reason")


@bind(READ + ", o AS (SELECT document_id, found AS ok FROM d UNION ALL SELECT document_id, ok FROM f) SELECT s.document_id, (SELECT count(*) FROM o WHERE ok AND o.document_id = s.document_id) AS verified, (SELECT count(*) FROM o WHERE NOT ok AND o.document_id = s.document_id) AS pending, CASE WHEN s.document_id IN (SELECT document_id FROM i WHERE severity = 'review') THEN 'needs_confirmation' ELSE 'passed' END AS status FROM s")
def workflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-05, DX-13: the state of each filing."""
    return filings(spark, sf_dir).states.select("document_id", "verified", "pending", "status")


@bind(READ + ", c AS (SELECT document_id, 'reader' AS step, count(*) AS items FROM d GROUP BY ALL UNION ALL SELECT document_id, 'fact_extractor', count(*) FROM f GROUP BY ALL UNION ALL SELECT document_id, 'verifier', count(*) FROM i GROUP BY ALL UNION ALL SELECT document_id, 'orchestrate', 1 FROM s), w AS (SELECT document_id, unnest(['orchestrate', 'reader', 'fact_extractor', 'verifier']) AS step, unnest([0, 1, 2, 3])::BIGINT AS seq FROM s) SELECT w.document_id, step, seq, coalesce(items, 0) AS items FROM w LEFT JOIN c USING (document_id, step)")
def workflow_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-05: what each step has given."""
    return filings(spark, sf_dir).progress().select("document_id", "step", "seq", "items")


@bind("SELECT kind, doc_id, source FROM (SELECT 'page_text' AS kind, doc_id, source, text FROM documents UNION ALL SELECT 'section_text', doc_id, source, text FROM documents WHERE lang = 'en' UNION ALL SELECT 'table_row', doc_id, source, text FROM documents WHERE contains(text, '|'))")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-01, SK-04, PJ-02: the kinds of evidence as one table; every document has its page text."""
    d = docs(spark, sf_dir)
    kinds = [("page_text", F.lit(True)), ("section_text", F.col("lang") == "en"), ("table_row", F.contains("text", F.lit("|")))]
    rows = F.explode(F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in kinds))))
    return d.select(rows.alias("kind"), "doc_id", "source")


@bind("SELECT e.vec_id, d.doc_id, 'page_text' AS chunk_kind, d.source, len(e.embedding) AS dims FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-04: evidence rows with their vectors."""
    e, d = table(spark, sf_dir, "embeddings"), docs(spark, sf_dir)
    return e.join(d, F.col("vec_id") == F.col("doc_id")).select("vec_id", "doc_id", F.lit("page_text").alias("chunk_kind"), "source", F.size("embedding").cast("long").alias("dims"))


@bind(
    HITS.format(k=5)
    + """, t AS (SELECT query_id, pos AS n, doc_id, lang, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM hits),
b AS (SELECT query_id, n, '[Document evidence DOC_' || n || ']' || chr(10) || 'Page: ' || CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE CAST(doc_id % 40 AS VARCHAR) END || chr(10) || 'Evidence kind: page_text' || chr(10) || CASE WHEN lang = 'en' THEN '' ELSE 'Section: ' || lang || chr(10) END
  || 'Excerpt: ' || CASE WHEN length(t) <= 700 THEN t ELSE regexp_replace(t[1:697], '\\s+$', '') || '...' END AS block FROM t)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY n)) AS digest, count(*) AS refs FROM b GROUP BY query_id"""
)
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-17: the five chunks that a question has found, with metadata and excerpts."""
    page = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 40)
    chunks = hits(spark, sf_dir, 5).select("query_id", "pos", F.col("doc_id").alias("chunk_id"), page.alias("page_number"), F.lit("page_text").alias("chunk_kind"), F.when(F.col("lang") != "en", F.col("lang")).alias("section_title"), "text")
    return chat.prompt_context(chunks, ["query_id"]).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.size("refs").cast("long").alias("refs"))


@bind(LINES + "SELECT lang, doc_id, line, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line) AS n FROM (SELECT lang, line, min(doc_id) AS doc_id FROM x GROUP BY lang, line) QUALIFY n <= 5")
def merge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-32: distinct points of each section, five at most; every line of a document is a point."""
    t = ops.explode_lines(docs(spark, sf_dir).select("lang", "doc_id", "text")).groupBy("lang", "line").agg(F.min("doc_id").alias("doc_id"))
    return retrieval.ranked(t, ["lang"], ["doc_id", "line"], 5, "n").select("lang", "doc_id", "line", "n")


@bind("SELECT lang AS section, doc_id FROM labels JOIN documents USING (doc_id) WHERE CASE WHEN doc_id % 7 > 0 THEN toxic = 1 ELSE false END = false")
def verified_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-12: only what needs no review; a point that nobody has judged is shown."""
    j = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    points = j.select(F.col("lang").alias("section"), "doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("toxic") == 1).alias("needs_review"))
    return review.verified_view(points).select("section", "doc_id")


@bind(LINES + ", h AS (SELECT doc_id, line_no, contains(lower(line), 'license') AS hit, line FROM x), c AS (SELECT doc_id, line_no, hit, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' / ') AS s FROM h) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS k, CASE WHEN length(s) <= 260 THEN s ELSE rtrim(s[1:257]) || '...' END AS snippet FROM c WHERE hit QUALIFY k < 2")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-27."""
    s = docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", F.posexplode(T.snippets(F.col("text"), ["license"])).alias("k", "snippet"))
    return s.withColumn("k", F.col("k").cast("long"))


@bind(
    r"""WITH w AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '[，。！？、；：:,.?;()\[\]（）/]+', ' ', 'g'), '(thing|with)', ' ', 'g'), '[A-Za-z][A-Za-z0-9&./ -]{1,}'), lambda t: trim(t)), lambda t: length(t) >= 2) AS ts FROM benchmark),
k AS (SELECT item_id, ts, list_transform(ts, lambda t: regexp_replace(lower(t), '\s+', '', 'g')) AS ks FROM w) SELECT item_id, array_to_string(list_filter(ts, lambda t, i: list_position(ks, ks[i]) = i), '|') AS terms FROM k"""
)
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-26: the terms of questions, with stop words of the fixture's language; ideographs are tried in tests/test_reports.py."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(cases.query_terms(F.col("text"), ("thing", "with")), "|").alias("terms"))


LEX = locator.Lexicon(
    fields={"revenue": ("thing", "apache"), "total_assets": ("license",), "total_liabilities": ("that",), "unit": ("with",)}, shared=("license", "version"), context=("the",), balance=("apache",), units=("ing",), periods=("20",),
    metrics=("revenue", "total_assets", "total_liabilities"), paired={"total_assets": "total_liabilities", "total_liabilities": "total_assets"}, front={"revenue": 1, "unit": 2},
)
_C = lambda w: f"CAST(contains(t, '{w}') AS INTEGER)"
_PAGE_LOCATOR = f"""WITH p AS (SELECT source, doc_id, {COMPACT} AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
s AS (SELECT source, doc_id, place, unnest(['shared', 'revenue', 'total_assets', 'total_liabilities', 'unit']) AS field, unnest([2, 1, 0, 0, 2]) AS front, unnest([
  8 * ({_C('license')} + {_C('version')}) + 3 * CAST(place <= 2 AS INTEGER) + 3 * {_C('the')} + {_C('ing')} + {_C('20')},
  CASE WHEN {_C('thing')} + {_C('apache')} > 0 OR place <= 1 THEN 2 * CAST(place <= 1 AS INTEGER) + 10 * ({_C('thing')} + {_C('apache')}) + CASE WHEN {_C('thing')} + {_C('apache')} > 0 THEN 4 * {_C('the')} + 2 * {_C('ing')} + {_C('20')} + CASE WHEN place <= 30 AND {_C('ing')} + {_C('20')} > 0 AND {_C('the')} > 0 THEN 8 ELSE 0 END ELSE 0 END END,
  CASE WHEN {_C('license')} > 0 THEN 10 + 4 * {_C('the')} + 2 * {_C('ing')} + {_C('20')} + 5 * {_C('apache')} + 3 * {_C('that')} + CASE WHEN place <= 30 AND {_C('ing')} + {_C('20')} > 0 AND {_C('the')} + {_C('that')} > 0 THEN 8 ELSE 0 END END,
  CASE WHEN {_C('that')} > 0 THEN 10 + 4 * {_C('the')} + 2 * {_C('ing')} + {_C('20')} + 5 * {_C('apache')} + 3 * {_C('license')} + CASE WHEN place <= 30 AND {_C('ing')} + {_C('20')} > 0 AND {_C('the')} + {_C('license')} > 0 THEN 8 ELSE 0 END END,
  CASE WHEN {_C('with')} > 0 OR place <= 2 THEN 2 * CAST(place <= 2 AS INTEGER) + 10 * {_C('with')} + 4 * {_C('ing')} END]) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source, field ORDER BY coalesce(score, 0) DESC, doc_id) AS best FROM s)
SELECT source, field, doc_id, CAST(coalesce(score, 0) AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY source, field ORDER BY CASE WHEN place <= front THEN place ELSE 1048576 + best END) AS INTEGER) AS pos FROM r WHERE place <= front OR (best <= CASE field WHEN 'shared' THEN 4 ELSE 5 END AND coalesce(score, 0) > 0)"""


@bind(_PAGE_LOCATOR)
def page_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-05, TK-05: front and best pages of each field."""
    return locator.locate(docs(spark, sf_dir).select("source", "doc_id", "text"), LEX, by="source", order="doc_id")


@bind(f"SELECT doc_id, 4 * ({_C('license')} + {_C('version')}) + 2 * {_C('thing')} + CASE WHEN {_C('apache')} + {_C('that')} > 0 THEN 4 ELSE 0 END + 4 * {_C('with')} AS score FROM (SELECT doc_id, {COMPACT} AS t FROM documents)")
def table_page_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-37, PJ-01."""
    text = ops.page_text(F.lit(""), F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", locator.table_page_score(text, ("license", "version"), ("thing",), ("apache", "that"), ("with",)).alias("score"))


@bind("SELECT doc_id AS chunk_id, source AS document_id, 'page_text' AS chunk_kind, CAST(doc_id % 40 AS INTEGER) AS page_number, md5(text) AS text_md5, CAST(NULL AS DOUBLE) AS score FROM documents")
def evidence_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-02: evidence as retrieval rows, without a score yet."""
    d = docs(spark, sf_dir).select(F.struct(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.lit("page_text").alias("chunk_kind"), (F.col("doc_id") % 40).cast("int").alias("page_number")).alias("metadata"), "text")
    return d.select("metadata.*", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(None).cast("double").alias("score"))


@bind(SEARCH + ", best AS (SELECT source, count(*) AS pages, max(score) AS score FROM top WHERE rank <= 3 GROUP BY source) SELECT d.source, CASE WHEN hash_blocked THEN 'blocked' WHEN best.source IS NULL THEN 'manual' ELSE 'searched' END AS status, CASE WHEN NOT hash_blocked THEN coalesce(pages, 0) ELSE 0 END AS pages, CAST(CASE WHEN NOT hash_blocked THEN coalesce(score, 0) ELSE 0 END AS INTEGER) AS score FROM (SELECT DISTINCT source, length(source) = 4 AS hash_blocked FROM documents) d LEFT JOIN best USING (source)")
def evidence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-23: a row for every case: blocked, without hits, or searched."""
    best = searched(spark, sf_dir, 3).groupBy("source").agg(F.count(F.lit(1)).alias("p"), F.max("score").alias("s"))
    j = docs(spark, sf_dir).select("source").distinct().join(best, "source", "left")
    blocked = F.length("source") == 4
    status = F.when(blocked, "blocked").when(F.col("p").isNull(), "manual").otherwise("searched")
    return j.select("source", status.alias("status"), F.when(~blocked, F.coalesce("p", F.lit(0))).otherwise(0).alias("pages"), F.when(~blocked, F.coalesce("s", F.lit(0))).otherwise(0).cast("int").alias("score"))


_TIDY = "trim(line, ' ：:;,.，、')"


@bind(LINES + f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {_TIDY} AS title FROM x WHERE length({_TIDY}) BETWEEN 2 AND 24 AND NOT regexp_matches({_TIDY}, '[。；;，,：:0-9]') AND regexp_matches(regexp_replace(lower({_TIDY}), '\\s+', '', 'g'), 'the|license')")
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-03: lines that sections.Headings takes for titles."""
    held: list[sections.Headings] = []

    def make(r: tuple) -> list[tuple]:
        if not held:
            held.append(sections.Headings(("the", "license")))
        return [(r[0], k, sections.tidy(line)) for k, line in enumerate(r[1]) if held[0].titled(line)]

    ls = docs(spark, sf_dir).select("doc_id", T.lines(F.coalesce("text", F.lit(""))).alias("ls"))
    return each(ls, ["doc_id", "ls"], make, "doc_id long, line_no long, title string")
