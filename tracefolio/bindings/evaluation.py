"""Evaluation: labelled documents as cases, with observations derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.operators import cases as C
from tracefolio.operators import evaluation as ops
from tracefolio.operators import review
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


CASES = """WITH c AS (SELECT l.doc_id AS case_id, quality, toxic, lang, source, n_chars, l.doc_id % 7 > 0 AS executed, CASE WHEN l.doc_id % 5 > 0 THEN CASE WHEN toxic = 1 THEN 'refuse' ELSE 'answer' END END AS route,
  CASE WHEN quality = 1 THEN 'answer' ELSE 'refuse' END AS expected_route, CASE WHEN l.doc_id % 4 = 0 THEN [] ELSE [n_chars % 10, n_chars % 7] END AS pages, CASE WHEN l.doc_id % 6 = 0 THEN [] ELSE [l.doc_id % 10, 3] END AS expected_pages,
  CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE text END AS answer FROM labels l JOIN documents d USING (doc_id)) """


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    empty = F.array().cast("array<bigint>")
    return j.select(
        k.alias("case_id"), "quality", "toxic", "lang", "source", "n_chars", (k % 7 > 0).alias("executed"), F.when(k % 5 > 0, F.when(F.col("toxic") == 1, "refuse").otherwise("answer")).alias("route"),
        F.when(F.col("quality") == 1, "answer").otherwise("refuse").alias("expected_route"), F.when(k % 4 == 0, empty).otherwise(F.array(F.col("n_chars") % 10, F.col("n_chars") % 7)).alias("pages"),
        F.when(k % 6 == 0, empty).otherwise(F.array(k % 10, F.lit(3).cast("long"))).alias("expected_pages"), F.when(k % 3 > 0, F.col("text")).alias("answer"),
    )


SCORED = CASES + """, s AS (SELECT *, CASE WHEN route IS NULL THEN CASE WHEN executed THEN false END ELSE route = expected_route END AS route_hit,
  CASE WHEN len(expected_pages) = 0 THEN NULL WHEN len(pages) = 0 THEN CASE WHEN executed THEN false END ELSE list_has_any(pages, expected_pages) END AS page_hit,
  CASE WHEN len(expected_pages) = 0 THEN NULL WHEN len(pages) = 0 THEN CASE WHEN executed THEN false END ELSE list_has_all(pages, expected_pages) END AS fields_present,
  CASE WHEN len(pages) = 0 THEN CASE WHEN executed THEN false END ELSE len(list_filter(pages, lambda p: p <= 0)) = 0 END AS anchor_valid,
  CASE WHEN answer IS NULL THEN CASE WHEN executed THEN false END ELSE NOT (contains(answer, 'License') OR contains(answer, '!!')) END AS forbidden_absent FROM c) """
SCORES = ["route_hit", "page_hit", "fields_present", "anchor_valid", "forbidden_absent"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("executed")
    return cases(spark, sf_dir).withColumns(
        {
            "route_hit": ops.equal_score(F.col("route"), F.col("expected_route"), run),
            "page_hit": ops.overlap_score(F.col("pages"), F.col("expected_pages"), run),
            "fields_present": ops.subset_score(F.col("pages"), F.col("expected_pages"), run),
            "anchor_valid": ops.anchors_valid(F.col("pages"), run),
            "forbidden_absent": ops.absent_score(F.col("answer"), F.array(F.lit("License"), F.lit("!!")), run),
        }
    )


@bind(SCORED + f"SELECT case_id, {', '.join(SCORES)} FROM s")
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-23: three-valued scores."""
    return scored(spark, sf_dir).select("case_id", *SCORES)


@bind(SCORED + "SELECT case_id, page_hit AS hit FROM s WHERE page_hit IS NOT NULL")
def intersection_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-05."""
    return scored(spark, sf_dir).where("page_hit is not null").select("case_id", F.col("page_hit").alias("hit"))


@bind(SCORED + "SELECT case_id, fields_present AS hit FROM s WHERE fields_present IS NOT NULL")
def required_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-06."""
    return scored(spark, sf_dir).where("fields_present is not null").select("case_id", F.col("fields_present").alias("hit"))


@bind(SCORED + " UNION ALL ".join(f"SELECT '{s}' AS score, count({s}) AS scored, count(*) FILTER ({s}) AS passed, round(count(*) FILTER ({s}) / nullif(count({s}), 0), 6) AS rate FROM s" for s in SCORES))
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-07: all scores in one aggregate."""
    return ops.score_summary(scored(spark, sf_dir), SCORES).withColumn("rate", F.round("rate", 6))


@bind(SCORED + "SELECT lang, source, count(*) AS cases, count(*) FILTER (page_hit) AS hits, round(count(*) FILTER (page_hit) / count(*), 6) AS rate FROM s GROUP BY ALL")
def hit_rate_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-08."""
    return ops.hit_rates(scored(spark, sf_dir), ["lang", "source"], "page_hit").withColumn("rate", F.round("rate", 6))


@bind(SCORED + "SELECT lang, case_id, quality FROM s WHERE page_hit = false")
def miss_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-09: the missed cases of each language, a row each; a list of them would have no bound."""
    return scored(spark, sf_dir).where("page_hit = false").select("lang", "case_id", "quality")


@bind(SCORED + "SELECT case_id, concat_ws(',', CASE WHEN route_hit = false THEN 'route' END, CASE WHEN page_hit = false THEN 'page' END, CASE WHEN anchor_valid = false THEN 'anchor' END) AS reasons, CASE WHEN case_id % 11 = 0 THEN 'error' WHEN route_hit = false OR page_hit = false OR anchor_valid = false THEN 'failed' ELSE 'passed' END AS status FROM s")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-24."""
    reasons = ops.failure_reasons([(F.col("route_hit"), "route"), (F.col("page_hit"), "page"), (F.col("anchor_valid"), "anchor")])
    status = F.when(F.col("case_id") % 11 == 0, "error").when(F.size("r") > 0, "failed").otherwise("passed")
    return scored(spark, sf_dir).withColumn("r", reasons).select("case_id", F.array_join("r", ",").alias("reasons"), status.alias("status"))


@bind(CASES + ", m AS (SELECT case_id, list_sort(list_intersect(pages[1:1], expected_pages)) AS h, list_sort(list_intersect(pages[1:1], [n_chars % 10, 4])) AS s FROM c) SELECT case_id, array_to_string(h, ',') AS hits, array_to_string(s, ',') AS supporting, CASE WHEN len(h) > 0 THEN 'primary_hit' WHEN len(s) > 0 THEN 'partial_support_only' ELSE 'miss' END AS status FROM m")
def page_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-12: the first page against expected and supporting pages."""
    m = C.page_match(F.col("pages"), F.col("expected_pages"), F.array(F.col("n_chars") % 10, F.lit(4).cast("long")), 1)
    text = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",")
    return cases(spark, sf_dir).select("case_id", m.alias("m")).select("case_id", text(F.col("m.hit_pages")).alias("hits"), text(F.col("m.supporting_hit_pages")).alias("supporting"), "m.status")


@bind(CASES + "SELECT case_id, array_to_string(list_sort(list_intersect(pages, expected_pages)), ',') AS hits FROM c WHERE len(list_intersect(pages, expected_pages)) > 0")
def array_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11."""
    both = F.array_sort(F.array_intersect("pages", "expected_pages"))
    return cases(spark, sf_dir).where(F.size(both) > 0).select("case_id", F.array_join(F.transform(both, lambda p: p.cast("string")), ",").alias("hits"))


RANKED = CASES + ", r AS (SELECT case_id, unnest([n_chars % 10, n_chars % 7, n_chars % 13, n_chars % 10]) AS page, unnest([1, 2, 3, 4]) AS rank FROM c), e AS (SELECT DISTINCT case_id, unnest(expected_pages) AS page FROM c) "


def ranked_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = cases(spark, sf_dir)
    n = F.col("n_chars")
    r = c.select("case_id", F.posexplode(F.array(n % 10, n % 7, n % 13, n % 10)).alias("rank", "page")).withColumn("rank", (F.col("rank") + 1).cast("long"))
    return r, c.select("case_id", F.explode("expected_pages").alias("page")).distinct()


@bind(RANKED + "SELECT e.case_id, e.page, coalesce(CAST(min(rank) AS VARCHAR), 'not_in_top_candidates') AS best_rank, coalesce(min(rank) <= 2, false) AS final_hit FROM e LEFT JOIN r USING (case_id, page) GROUP BY e.case_id, e.page")
def gold_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-04."""
    r, e = ranked_pages(spark, sf_dir)
    return ops.expected_ranks(e, r, 2)


@bind(RANKED + "SELECT case_id, page, CAST(min(rank) AS BIGINT) AS rank, row_number() OVER (PARTITION BY case_id ORDER BY min(rank), page) AS n FROM r WHERE rank <= 3 AND (case_id, page) NOT IN (SELECT (case_id, page) FROM e) GROUP BY case_id, page QUALIFY n <= 2")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-14."""
    r, e = ranked_pages(spark, sf_dir)
    return ops.false_positives(r, e, final_k=3, most=2).withColumn("rank", F.col("rank").cast("long"))


VARIANTS = ["a", "b", "d"]
VAR_SQL = CASES + ", v AS (SELECT case_id, quality = 1 AS base, toxic = 1 OR case_id % 2 = 0 AS a, case_id % 3 = 0 AS b, CASE WHEN case_id % 5 > 0 THEN quality = 1 END AS d FROM c) "


@bind(VAR_SQL + " UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) FILTER ({v}) AS hits, count(*) FILTER ({v} AND NOT base) AS rescued, count(*) FILTER (NOT coalesce({v}, false) AND base) AS regressed FROM v" for v in VARIANTS))
def variant_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-16."""
    k = F.col("case_id")
    v = cases(spark, sf_dir).select((F.col("quality") == 1).alias("base"), ((F.col("toxic") == 1) | (k % 2 == 0)).alias("a"), (k % 3 == 0).alias("b"), F.when(k % 5 > 0, F.col("quality") == 1).alias("d"))
    return ops.rescue(v, "base", VARIANTS)


SHADOW = CASES + """, w AS (SELECT case_id, quality = 1 AS passed, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS page_hit, unnest(['a', 'b', 'd']) AS mode, unnest([n_chars % 10, n_chars % 7, n_chars % 4]) AS page, expected_pages FROM c),
h AS (SELECT *, CASE WHEN contains(expected_pages, page) THEN 'primary_hit' WHEN page = 4 THEN 'partial_support_only' ELSE 'miss' END AS status FROM w) """


def shadowed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of three modes that each find one page, and a baseline."""
    c, n = cases(spark, sf_dir), F.col("n_chars")
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), (n % k).alias("page")) for m, k in (("a", 10), ("b", 7), ("d", 4)))))
    r = c.select("case_id", "expected_pages", modes.alias("x")).select("case_id", "x.mode", C.page_match(F.array("x.page"), F.col("expected_pages"), F.array(F.lit(4).cast("long")), 1)["status"].alias("status"))
    return r, c.select("case_id", (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") != 1, F.col("quality") == 1).alias("page_hit"))


@bind(SHADOW + "SELECT case_id, mode, status FROM h WHERE passed AND status <> 'primary_hit'")
def shadow_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17: cases that the baseline passed and a mode misses."""
    return C.shadow_regressions(*shadowed(spark, sf_dir)).select("case_id", "mode", "status")


@bind(SHADOW + "SELECT case_id, concat_ws(',', CASE WHEN bool_or(mode = 'b' AND status = 'primary_hit') THEN 'b' END, CASE WHEN bool_or(mode = 'd' AND status = 'primary_hit') THEN 'd' END) AS rescued_by, coalesce(string_agg(mode, ',' ORDER BY mode) FILTER (status = 'partial_support_only'), '') AS partial FROM h WHERE page_hit = false GROUP BY case_id")
def shadow_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17: the modes that find what the baseline missed."""
    return C.shadow_rescue(*shadowed(spark, sf_dir), ["b", "d"]).select("case_id", F.array_join("rescued_by", ",").alias("rescued_by"), F.array_join("partial_support", ",").alias("partial"))


@bind(SHADOW + "SELECT mode, count(*) AS total_cases, count(*) FILTER (status = 'primary_hit') AS hit_count, count(*) FILTER (status = 'partial_support_only') AS partial_support_only_count, count(*) FILTER (status <> 'primary_hit') AS miss_count, round(count(*) FILTER (status = 'primary_hit') / count(*), 6) AS hit_rate FROM h GROUP BY mode")
def shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17: a row a mode."""
    return C.shadow_summary(shadowed(spark, sf_dir)[0]).withColumn("hit_rate", F.round("hit_rate", 6))


@bind(
    CASES + """SELECT case_id, CASE WHEN live <> want AND resc THEN 'page_rescued_but_live_intent_mismatch' WHEN live <> want THEN 'router_intent_mismatch' WHEN NOT parsed THEN 'page_number_mapping_suspect' WHEN NOT unit THEN 'gold_page_evidence_missing'
  WHEN want = 'metric_value' AND NOT rw THEN 'table_extraction_gap' WHEN want = 'business_narrative' AND NOT (sec OR rw) THEN 'chunking_or_page_anchor_gap' WHEN resc THEN 'gold_page_low_rank' WHEN gen THEN 'generic_metric_row_dominance' ELSE 'gold_page_low_rank' END AS category
FROM (SELECT case_id, CASE WHEN quality = 1 THEN 'metric_value' ELSE 'business_narrative' END AS want, CASE WHEN case_id % 3 = 0 THEN NULL WHEN case_id % 4 = 0 THEN 'business_narrative' ELSE CASE WHEN quality = 1 THEN 'metric_value' ELSE 'business_narrative' END END AS live,
  case_id % 5 > 0 AS parsed, case_id % 7 > 0 AS unit, case_id % 2 = 0 AS rw, n_chars % 2 = 0 AS sec, n_chars % 3 = 0 AS resc, n_chars % 5 = 0 AS gen FROM c)"""
)
def failure_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-20."""
    k, n = F.col("case_id"), F.col("n_chars")
    want = F.when(F.col("quality") == 1, "metric_value").otherwise("business_narrative")
    live = F.when(k % 3 == 0, F.lit(None)).when(k % 4 == 0, "business_narrative").otherwise(want)
    return cases(spark, sf_dir).select("case_id", ops.failure_category(want, live, k % 5 > 0, k % 7 > 0, k % 2 == 0, n % 2 == 0, n % 3 == 0, n % 5 == 0).alias("category"))


@bind(CASES + "SELECT case_id, CASE WHEN answer IS NULL THEN NULL ELSE NOT regexp_matches(answer, '(?i)chunk_id|source_path|document_id') END AS clean, CASE WHEN answer IS NULL THEN NULL ELSE NOT regexp_matches(answer, '\\(\\s*\\)|\\[\\s*\\]') END AS filled, CASE WHEN answer IS NULL THEN NULL ELSE regexp_matches(answer, '%|million|RMB|CNY|HKD|USD') AND regexp_matches(answer, '20[0-9]{2}') END AS unit_period FROM c")
def answer_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-22."""
    h = lambda name: ops.hygiene(F.col("answer"), F.lit(name))
    return cases(spark, sf_dir).select("case_id", h("no_raw_metadata").alias("clean"), h("no_empty_parentheses").alias("filled"), h("unit_period_present").alias("unit_period"))


EVENTS = "SELECT event_type, event_id % 9 > 0 AS ok, event_id % 2 = 0 AS hit, event_id % 3 = 0 AS fully, CASE WHEN event_id % 4 > 0 THEN value END AS ms FROM events"


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.expr("event_id % 9 > 0").alias("ok"), F.expr("event_id % 2 = 0").alias("hit"), F.expr("event_id % 3 = 0").alias("fully"), F.expr("case when event_id % 4 > 0 then value end").alias("ms"))


@bind(f"SELECT event_type, count(*) AS cases, round(count(*) FILTER (ok AND hit) / count(*), 4) AS route_accuracy, round(count(*) FILTER (ok AND fully) / count(*), 4) AS full_accuracy, round(round(avg(ms), 4), 3) AS avg_ms FROM ({EVENTS}) GROUP BY ALL")
def router_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-10."""
    out = ops.router_accuracy(event_results(spark, sf_dir), "event_type", "ok", "hit", "fully", "ms")
    return out.withColumn("avg_ms", F.round("avg_ms", 3))


@bind(f"SELECT count(*) AS cases, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(sum(coalesce(ms, 0)), 1) AS total_ms, round(avg(coalesce(ms, 0)), 2) AS avg_ms FROM ({EVENTS})")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11: a missing time counts as zero."""
    return C.quality_summary(event_results(spark, sf_dir), "ok", "ms")


@bind(f"SELECT event_type AS route, count(*) AS n, count(*) FILTER (NOT hit) AS mismatches, round(avg(ms), 3) AS avg_ms FROM ({EVENTS}) GROUP BY ALL")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-12."""
    return C.latency_summary(event_results(spark, sf_dir), "event_type", "hit", "ms")


COVERED = """WITH j AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)), d AS (SELECT DISTINCT source FROM documents),
p AS (SELECT d.source, length(d.source) = 4 AS broken, count(*) FILTER (quality = 1) AS populated, count(*) FILTER (quality = 1 AND toxic = 0) AS cited FROM d LEFT JOIN j USING (source) GROUP BY ALL),
c AS (SELECT *, CASE WHEN broken THEN NULL WHEN populated = 0 THEN 0.0 ELSE round(cited / populated, 4) END AS coverage FROM p) """


def benchmark_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources as documents, some of which failed; labelled texts as their fields."""
    d = table(spark, sf_dir, "documents")
    f = table(spark, sf_dir, "labels").join(d, "doc_id")
    facts = f.select(F.col("source").alias("document_id"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("value"), F.when(F.col("toxic") == 0, 1).otherwise(0).alias("n_citations"))
    run = d.select(F.col("source").alias("document_id")).distinct().withColumn("error", F.when(F.length("document_id") == 4, "ValueError"))
    return C.citation_coverage(facts, run)


@bind(COVERED + "SELECT count(*) AS documents, count(*) FILTER (NOT broken) AS succeeded, coalesce(round(avg(coverage), 4), 0) AS macro FROM c")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-13: the mean of the coverages of documents that did not fail, not the coverage of all fields."""
    return benchmark_run(spark, sf_dir)[1]


@bind(COVERED + "SELECT source AS document_id, CASE WHEN broken THEN 'ValueError' END AS error, populated, cited, coverage FROM c")
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-25: a row for every document of a run; failures are rows."""
    return benchmark_run(spark, sf_dir)[0]


REVIEWED = """WITH i AS (SELECT source AS document_id, lang AS section, toxic = 1 AS needs_review, quality, l.doc_id, CASE l.doc_id % 3 WHEN 0 THEN 'overview' WHEN 1 THEN 'point' ELSE 'field' END AS kind FROM labels l JOIN documents USING (doc_id)) """


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as overviews, points and fields of their source."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "overview").when(F.col("doc_id") % 3 == 1, "point").otherwise("field")
    return j.select(F.col("source").alias("document_id"), F.col("lang").alias("section"), (F.col("toxic") == 1).alias("needs_review"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("value"), F.when(F.col("toxic") == 1, 0).otherwise(2).alias("n_citations"), kind.alias("kind"), "doc_id")


@bind(REVIEWED + "SELECT document_id, count(*) FILTER (NOT needs_review) AS verified, count(*) FILTER (needs_review) AS pending, CASE WHEN bool_or(needs_review) THEN 'needs_confirmation' ELSE 'passed' END AS status FROM i WHERE kind <> 'field' OR quality = 1 GROUP BY document_id")
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14: verified and pending items of each document; fields without a value count for nothing."""
    return review.review_state(reviewed(spark, sf_dir))[0]


@bind(REVIEWED + "SELECT document_id, section, bool_or(needs_review) AS needs_review FROM i WHERE kind = 'point' GROUP BY ALL")
def review_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14: sections of which a point needs review."""
    return review.review_state(reviewed(spark, sf_dir))[1]


@bind("SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent, count(*) FILTER (o_totalprice > 300000 AND o_orderstatus = 'O') AS open_large FROM orders")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-18: several counters in one pass."""
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"), F.count_if((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "O")).alias("open_large"))


@bind("SELECT l.doc_id, coalesce(b.lang, 'unknown') AS baseline FROM labels l LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'en') b USING (doc_id)")
def baseline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08."""
    b = table(spark, sf_dir, "documents").where("lang != 'en'").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(b, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("baseline"))


@bind("SELECT l.doc_id, d.doc_id IS NOT NULL AS parsed, coalesce(d.n, 0) AS n_units, coalesce(d.rows, 0) AS n_rows FROM labels l LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (lang = 'en') AS rows FROM documents GROUP BY doc_id) d USING (doc_id)")
def gold_page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10: expected pages with counts of what was parsed of them."""
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("rows"))
    return table(spark, sf_dir, "labels").join(d, "doc_id", "left").select("doc_id", F.col("n").isNotNull().alias("parsed"), F.coalesce("n", F.lit(0)).alias("n_units"), F.coalesce("rows", F.lit(0)).alias("n_rows"))


PICKED = """WITH p AS (SELECT lang || '::q' || l.doc_id AS case_id, CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 'mixed' ELSE 'concept_only' END WHEN l.doc_id % 9 > 0 THEN 'document_only' END AS expected_route, 'tier' || toxic AS tier, source AS company, lang AS industry, CASE WHEN quality = 1 THEN 'metric_value' END AS intent FROM labels l JOIN documents USING (doc_id)) """


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases of a manifest."""
    k = F.col("doc_id")
    route = F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "mixed").otherwise("concept_only")).when(k % 9 > 0, "document_only")
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return j.select(F.concat("lang", F.lit("::q"), k.cast("string")).alias("case_id"), route.alias("expected_route"), F.concat(F.lit("tier"), F.col("toxic").cast("string")).alias("tier"), F.col("source").alias("company"), F.col("lang").alias("industry"), F.when(F.col("quality") == 1, "metric_value").alias("expected_document_evidence_intent"))


@bind(PICKED + "SELECT case_id, split_part(case_id, '::', 2) AS query_id, CASE WHEN expected_route IS DISTINCT FROM 'document_only' THEN 'manifest expected_route is not document_only' END AS skip_reason FROM p")
def case_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-11: evaluated and skipped cases, none lost."""
    return C.split_document_only(picked(spark, sf_dir)).select("case_id", "query_id", "skip_reason")


@bind(PICKED + "SELECT case_id FROM p WHERE tier = 'tier0' AND industry IN ('fr', 'de') AND intent = 'metric_value' AND company <> 'src1'")
def case_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-09: chained selections; an unknown id raises."""
    p = picked(spark, sf_dir)
    others = [r[0] for r in p.select("company").distinct().collect() if r[0] != "src1"]  # a list of sources, as a caller gives it
    return C.select_cases(p, tiers=["tier0"], industries=["fr", "de"], intents=["metric_value"], companies=others).select("case_id")


@bind(
    """WITH r AS (SELECT d.doc_id AS query_id, n_chars % 2 = 0 AS s, n_chars % 3 = 0 AS b, n_chars % 5 = 0 AS h, lang AS want, CASE WHEN d.doc_id % 4 > 0 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'en' ELSE lang END END AS live FROM documents d),
j AS (SELECT l.doc_id AS query_id, r.query_id AS found, coalesce(s, false) AS s, coalesce(b, false) AS b, coalesce(h, false) AS h, want <> live AS mismatch FROM (SELECT doc_id FROM labels UNION SELECT -1) l LEFT JOIN r ON r.query_id = l.doc_id)
SELECT query_id, found AS case_id, s AS semantic_hit, b AS bm25_hit, h AS hybrid_hit, mismatch AS live_intent_mismatch, CASE WHEN found IS NULL THEN 'not_in_selected_cases' WHEN NOT s AND (b OR h) AND mismatch THEN 'page_rescued_but_live_intent_mismatch'
  WHEN NOT s AND (b OR h) THEN 'expected_intent_page_rescued_by_' || concat_ws('+', CASE WHEN b THEN 'bm25_only' END, CASE WHEN h THEN 'hybrid_rrf' END) WHEN s THEN 'semantic_only_page_hit_in_rerun' ELSE 'not_page_rescued' END AS rescue_status FROM j"""
)
def rescue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-21: formerly failing questions (one of them in no case), by the modes that find their page now."""
    d, n, k = table(spark, sf_dir, "documents"), F.col("n_chars"), F.col("doc_id")
    live = F.when(k % 4 > 0, F.when(k % 3 == 0, "en").otherwise(F.col("lang")))
    results = d.select(k.alias("query_id"), k.alias("case_id"), (n % 2 == 0).alias("semantic"), (n % 3 == 0).alias("bm25"), (n % 5 == 0).alias("hybrid"), F.col("lang").alias("expected_intent"), live.alias("observed_intent"), F.lit("failed").alias("pilot_status"))
    targets = table(spark, sf_dir, "labels").select(k.alias("query_id")).union(spark.createDataFrame([(-1,)], "query_id long"))
    return C.rescue_report(targets, results).drop("pilot_status")


@bind(
    """WITH c AS (SELECT doc_id, quality, source || '/' || lang AS key, lang FROM labels JOIN documents USING (doc_id)), d AS (SELECT key, length(key) = 7 AS broken FROM c GROUP BY key HAVING max(quality) = 1 AND min(quality) = 0)
SELECT c.doc_id AS case_id, d.key IS NOT NULL AND NOT broken AS executed, CASE WHEN d.key IS NULL THEN 'document missing' WHEN broken THEN 'ParserError' END AS error, CASE WHEN NOT broken THEN lang END AS route FROM c LEFT JOIN d USING (key)"""
)
def live_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-26: an observation for every case; a missing or broken document is an error row. Documents are there whose labels tell good pages and bad ones."""
    d = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("case_id"), F.concat_ws("/", "source", "lang").alias("document_key"), "lang", "quality")
    told = labelled.groupBy("document_key").agg(F.max("quality").alias("hi"), F.min("quality").alias("lo")).where("hi = 1 and lo = 0")
    documents = told.select("document_key", F.when(F.length("document_key") == 7, "ParserError").alias("error"))
    retrieved = labelled.select("case_id", F.col("lang").alias("route"), F.array(F.lit(1)).alias("pages"), F.lit(5).alias("latency_ms"))
    return C.live_observations(labelled.select("case_id", "document_key", "lang"), documents, retrieved).select("case_id", "executed", "error", "route")


_Q = """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 5 THEN NULL ELSE text END AS answer, text || ' (end)' AS item, length(text) AS n FROM conversations WHERE role = 'assistant'),
t AS (SELECT *, answer || chr(10) || item AS t, conv_id % 3 = 0 AS miss FROM a) SELECT conv_id, turn, CASE WHEN answer IS NOT NULL THEN concat_ws(',', CASE WHEN miss THEN 'route' END, CASE WHEN NOT contains(t, 'the') THEN 'required_answer_terms' END, CASE WHEN NOT (contains(t, 'ing') OR contains(t, 'est')) THEN 'required_answer_term_groups' END,
  CASE WHEN contains(t, 'sh') THEN 'forbidden_answer_terms' END, CASE WHEN n % 4 < 2 THEN 'document_citation_count' END, CASE WHEN n % 4 = 0 THEN 'external_citation_count' END, CASE WHEN n % 4 = 3 AND n % 5 = n % 3 THEN 'duplicate_document_pages' END, CASE WHEN n % 4 >= 2 THEN 'duplicate_external_urls' END,
  CASE WHEN NOT (n % 5 IN (1, 2) OR (n % 4 = 3 AND n % 3 IN (1, 2))) THEN 'expected_document_pages_any' END) END AS failed FROM t"""


@bind(_Q.replace(") END AS failed FROM t", ") END AS failed, answer FROM t").replace("SELECT conv_id, turn, CASE WHEN answer IS NOT NULL", "SELECT conv_id, turn, failed, answer IS NOT NULL AND failed = '' AS passed FROM (SELECT conv_id, turn, CASE WHEN answer IS NOT NULL") + ")")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-25: answers against what their case asks for."""
    a, n = table(spark, sf_dir, "conversations").where("role = 'assistant'"), F.length("text")
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    one = F.lit("u")
    df = a.select(
        "conv_id", "turn", F.when(F.col("turn") % 7 != 5, F.col("text")).alias("answer"), F.array(F.concat("text", F.lit(" (end)"))).alias("items"), F.when(F.col("conv_id") % 3 == 0, "mixed").otherwise("document_only").alias("route"), F.lit("document_only").alias("expected_route"),
        F.when(n % 4 == 3, F.array(n % 5, n % 3)).otherwise(F.array(n % 5, F.lit(None))).alias("document_pages"), F.when(n % 4 >= 2, F.array(one, one)).otherwise(F.array(one)).alias("external_urls"), F.when(n % 4 < 2, 1).otherwise(2).alias("n_document"), (n % 4).alias("n_external"),
        words("the").alias("required_terms"), F.array(words("ing", "est")).alias("required_groups"), words("sh").alias("forbidden_terms"), F.lit(2).alias("min_document"), F.lit(1).alias("min_external"), F.array(F.lit(1), F.lit(2)).alias("expected_pages"),
    )
    return C.quality_checks(df).select("conv_id", "turn", F.array_join("failed_checks", ",").alias("failed"), "passed")
