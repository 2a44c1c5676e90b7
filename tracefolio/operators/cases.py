"""Evaluation cases: selection, manifests from reviewed matrices, page matches, rescue and shadow reports, checks of answers. Native functions only."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefolio.functions.text import strip
from tracefolio.sources.registry import require_none

# --- selection -------------------------------------------------------------------------------------------------------


def select_cases(cases: DataFrame, *, case_ids: list | None = None, tiers: list | None = None, companies: list | None = None, industries: list | None = None, intents: list | None = None) -> DataFrame:
    """Cases that pass all selections; an empty one selects all. A case_id that no case has raises."""
    if case_ids:
        asked = cases.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(case_ids)], cases.select("case_id").schema)
        require_none(asked.join(cases, "case_id", "left_anti").select("case_id", F.lit("unknown case id").alias("rule")), "case_id")
    for column, chosen in (("case_id", case_ids), ("tier", tiers), ("company", companies), ("industry", industries), ("expected_document_evidence_intent", intents)):
        if chosen:
            cases = cases.where(F.col(column).isin(*chosen))
    return cases


SKIPPED = "manifest expected_route is not document_only"


def split_document_only(cases: DataFrame) -> DataFrame:
    """``cases`` with query_id (what stands behind the last ``::`` of the id) and skip_reason, null for those that are evaluated. None is lost."""
    document = F.coalesce(F.col("expected_route") == "document_only", F.lit(False))
    return cases.withColumn("query_id", F.element_at(F.split(F.col("case_id").cast("string"), "::"), -1)).withColumn("skip_reason", F.when(~document, F.lit(SKIPPED)))


# --- manifests -------------------------------------------------------------------------------------------------------


def ordered_pages(*lists: Column) -> Column:
    """The lists' pages one after the other, each once; nulls fall out."""
    empty = F.array().cast("array<bigint>")
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(x.cast("array<bigint>"), empty) for x in lists))))


def human_pages() -> Column:
    """Expected pages are those that people confirmed, then those that they put right; no others."""
    return ordered_pages(F.col("human_confirmed_pages"), F.col("human_corrected_pages"))


def exclude_reason() -> Column:
    """Why a matrix row is no case of the manifest: the first reason that holds; null if it is one."""
    ladder = [
        (F.col("manifest_readiness") == "blocked_missing_raw", "blocked_missing_raw"),
        (F.col("auto_anchor_status") == "needs_manual_probe", "no_hit_or_deferred"),
        (F.coalesce(F.size("human_missing_fields"), F.lit(0)) > 0, "human_missing_fields"),
        (F.size(human_pages()) == 0, "missing_human_confirmed_or_corrected_pages"),
    ]
    return reduce(lambda out, rule: out.when(rule[0], F.lit(rule[1])), ladder[1:], F.when(ladder[0][0], F.lit(ladder[0][1])))


def readiness() -> Column:
    """What a row of an anchor matrix needs yet."""
    missing = F.coalesce(F.size("human_missing_fields"), F.lit(0)) > 0
    return (
        F.when(missing, F.lit("needs_anchor_confirmation"))
        .when(F.size(human_pages()) > 0, F.lit("ready_for_manifest"))
        .when(F.coalesce(F.size("candidate_pages"), F.lit(0)) > 0, F.lit("needs_anchor_confirmation"))
        .otherwise(F.lit("needs_manual_probe"))
    )


def manifest_cases(rows: DataFrame) -> DataFrame:
    """The cases of a manifest: case_id, document_key, expected_pages, supporting_pages. A case_id that comes twice raises."""
    require_none(rows.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate case id").alias("rule")), "case_id")
    kept = rows.where(exclude_reason().isNull())
    return kept.select("case_id", "document_key", human_pages().alias("expected_pages"), ordered_pages(F.col("human_supporting_pages")).alias("supporting_pages"))


def manifest_documents(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The documents of a manifest: of each key the ``columns`` of its first row that is a case."""
    first = F.min_by(F.struct(*columns), order).alias("d")
    return rows.where(exclude_reason().isNull()).groupBy("document_key").agg(first).select("document_key", "d.*")


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row: rows, cases, documents, and the excluded ones by reason."""
    marked = rows.select("document_key", exclude_reason().alias("why"))
    n = lambda name: F.count_if(F.col("why") == name)
    return marked.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("why").isNull()).alias("included_cases"), F.count("why").alias("excluded_cases"), F.countDistinct(F.when(F.col("why").isNull(), F.col("document_key"))).alias("documents"),
        n("missing_human_confirmed_or_corrected_pages").alias("excluded_missing_human_pages"), n("human_missing_fields").alias("excluded_partial_field_gap"), n("no_hit_or_deferred").alias("excluded_no_hit_or_deferred"),
    )


def universal_matrix(definitions: DataFrame, filings: DataFrame, hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Each definition (query_id, company) on its company's filing, with the pages found, what people noted, and what it needs yet.

    ``filings``: company, document_key, universal_candidates, pos (the last one of a company holds); ``hits``: query_id, document_key, candidate_pages, score; ``notes``: company, query_id and the human_* columns. A
    definition without a filing that offers its query raises.
    """
    last = filings.groupBy("company").agg(F.max_by(F.struct("document_key", "universal_candidates"), "pos").alias("f")).select("company", "f.*")
    placed = definitions.join(last, "company", "left")
    offered = F.coalesce(F.array_contains("universal_candidates", F.col("query_id")), F.lit(False))
    require_none(placed.where(~offered).select("query_id", F.lit("no filing of its company offers it").alias("rule")), "query_id")
    j = placed.join(hits, ["query_id", "document_key"], "left").join(notes, ["company", "query_id"], "left")
    status = F.when(F.coalesce(F.size("candidate_pages"), F.lit(0)) > 0, F.lit("candidate")).otherwise(F.lit("needs_manual_probe"))
    case = F.concat_ws("::", "document_key", "query_id")
    return j.select(case.alias("case_id"), "company", "query_id", "document_key", status.alias("search_status"), F.coalesce("score", F.lit(0)).alias("score"), human_pages().alias("expected_pages"), readiness().alias("readiness"))


# Classes of filings, their names' marks, and the year that is current.
CURRENT_YEAR = 2025
SUMMARY_MARKS, QUARTER_MARKS = ("摘要",), ("季度", "一季", "三季")


def filing_class(doc_type: Column, name: Column, year: Column, current: int = CURRENT_YEAR) -> Column:
    """20f, earnings_release, annual_report (of the current year), annual_report_historical, annual_summary, quarterly_report or interim_report; null for other kinds."""
    low, file = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(name, F.lit(""))
    marked = lambda marks, latin: reduce(lambda a, m: a | F.contains(file, F.lit(m)), marks, F.contains(low, F.lit(latin)))
    annual = F.when(marked(SUMMARY_MARKS, "summary"), "annual_summary").when(F.coalesce(year == current, F.lit(False)), "annual_report").otherwise("annual_report_historical")
    interim = F.when(marked(QUARTER_MARKS, "q"), "quarterly_report").otherwise("interim_report")
    return F.when(doc_type.isin("20f", "form_20f"), F.lit("20f")).when(doc_type == "earnings_release", F.lit("earnings_release")).when(doc_type == "annual_report", annual).when(doc_type == "interim_report", interim)


# --- page matches and rescue -----------------------------------------------------------------------------------------


def page_match(pages: Column, expected: Column, supporting: Column, top_k: int) -> Column:
    """struct<hit_pages, supporting_hit_pages, status> of the first ``top_k`` pages: a primary hit, support only, or a miss."""
    head = F.array_compact(F.slice(pages, 1, top_k))
    met = lambda c: F.array_sort(F.array_intersect(head, c))
    status = F.when(F.size(met(expected)) > 0, "primary_hit").when(F.size(met(supporting)) > 0, "partial_support_only").otherwise("miss")
    return F.struct(met(expected).alias("hit_pages"), met(supporting).alias("supporting_hit_pages"), status.alias("status"))


def intent_mismatch(expected: Column, observed: Column) -> Column:
    """Did the live run take the question for something else? Null where either is unknown."""
    known = (F.coalesce(expected, F.lit("")) != "") & (F.coalesce(observed, F.lit("")) != "")
    return F.when(known, expected != observed)


def rescue_status(semantic: Column, bm25: Column, hybrid: Column, mismatch: Column) -> Column:
    """Which modes find the page that the semantic one misses."""
    modes = F.array_compact(F.array(F.when(bm25 & ~semantic, "bm25_only"), F.when(hybrid & ~semantic, "hybrid_rrf")))
    found = F.size(modes) > 0
    return (
        F.when(found & F.coalesce(mismatch, F.lit(False)), F.lit("page_rescued_but_live_intent_mismatch"))
        .when(found, F.concat(F.lit("expected_intent_page_rescued_by_"), F.array_join(modes, "+")))
        .when(semantic, F.lit("semantic_only_page_hit_in_rerun"))
        .otherwise(F.lit("not_page_rescued"))
    )


def rescue_report(targets: DataFrame, results: DataFrame) -> DataFrame:
    """A row for every formerly failing query_id, selected or not. ``results``: query_id, case_id, semantic, bm25, hybrid, expected_intent, observed_intent, pilot_status."""
    j = targets.select("query_id").distinct().join(results.withColumn("__in", F.lit(True)), "query_id", "left")
    hit = lambda c: F.coalesce(F.col(c), F.lit(False))
    mismatch = intent_mismatch(F.col("expected_intent"), F.col("observed_intent"))
    status = F.when(F.col("__in").isNull(), F.lit("not_in_selected_cases")).otherwise(rescue_status(hit("semantic"), hit("bm25"), hit("hybrid"), mismatch))
    return j.select("query_id", "case_id", *(hit(c).alias(f"{c}_hit") for c in ("semantic", "bm25", "hybrid")), F.coalesce("pilot_status", F.lit("unknown")).alias("pilot_status"), mismatch.alias("live_intent_mismatch"), status.alias("rescue_status"))


def shadow_summary(results: DataFrame) -> DataFrame:
    """(case_id, mode, status) to a row a mode: cases, hits, supported only, misses and rate."""
    n, hit = F.count(F.lit(1)), F.count_if(F.col("status") == "primary_hit")
    return results.groupBy("mode").agg(n.alias("total_cases"), hit.alias("hit_count"), F.count_if(F.col("status") == "partial_support_only").alias("partial_support_only_count"), (n - hit).alias("miss_count"), (hit / n).alias("hit_rate"))


def shadow_regressions(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """(mode, case_id, status) of cases that the baseline (case_id, passed, page_hit) passed and a mode misses."""
    return results.where("status != 'primary_hit'").join(baseline.where("passed").select("case_id"), "case_id", "left_semi").select("mode", "case_id", "status")


def shadow_rescue(results: DataFrame, baseline: DataFrame, rescuers: list[str]) -> DataFrame:
    """A row for each case whose page the baseline missed: the modes that find it, and those that find support only."""
    missed = baseline.where("page_hit = false").select("case_id")
    # the modes are few: a case's rows are a short list
    per = results.groupBy("case_id").agg(F.collect_set(F.when(F.col("status") == "primary_hit", F.col("mode"))).alias("h"), F.collect_set(F.when(F.col("status") == "partial_support_only", F.col("mode"))).alias("p"))
    known = F.array(*(F.lit(m) for m in rescuers))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return missed.join(per, "case_id", "left").select("case_id", F.filter(known, lambda m: F.array_contains(listed(F.col("h")), m)).alias("rescued_by"), F.array_sort(listed(F.col("p"))).alias("partial_support"))


def live_observations(cases: DataFrame, documents: DataFrame, retrieved: DataFrame) -> DataFrame:
    """An observation for every case (case_id, document_key): its document's retrieval, or why there is none.

    ``documents``: document_key, error (null: parsed and indexed, once for all of its cases); ``retrieved``: case_id, route, pages, latency_ms.
    """
    d = documents.select("document_key", F.lit(True).alias("there"), F.col("error").alias("broken"))
    j = cases.select("case_id", "document_key").join(d, "document_key", "left").join(retrieved, "case_id", "left")
    error = F.when(F.col("there").isNull(), F.lit("document missing")).otherwise(F.col("broken"))
    ok = error.isNull()
    return j.select("case_id", ok.alias("executed"), error.alias("error"), F.when(ok, F.col("route")).alias("route"), F.when(ok, F.col("pages")).alias("pages"), F.when(ok, F.col("latency_ms")).alias("latency_ms"))


# --- answers ---------------------------------------------------------------------------------------------------------

# Names that an engine gives to its passages, names it gives values to, and its word for a piece; what does not count when terms with digits are looked for.
PASSAGES, ASSIGNED, PIECE = ("doc", "web"), ("source", "score"), "chunk"
BLANKS = " \t\n\x0b\f\r"
LOOSE = r"(?U)[\s,，亿元百万元人民币%％]"
CHECKS = (
    "route", "required_answer_terms", "required_answer_term_groups", "forbidden_answer_terms", "empty_citation_markers", "internal_markers", "document_citation_count", "external_citation_count", "duplicate_document_pages",
    "duplicate_external_urls", "expected_document_pages_any",
)


def empty_citation(text: Column) -> Column:
    """Has the text brackets with nothing but separators in them? Without separators the brackets stand side by side."""
    between = (("（）", "、,，;；"), ("()", ",;"))
    return reduce(or_, (F.contains(F.translate(text, BLANKS + marks, ""), F.lit(pair)) for pair, marks in between))


def internal(text: Column) -> Column:
    """Does the text show what is the engine's own: a passage's number, a piece with its number, a name with a value?"""
    low = F.lower(text)
    numbered = lambda w: F.substring(w, 1, 4).isin(*(f"{p}_" for p in PASSAGES)) & w.substr(F.lit(5), F.length(w)).rlike("^[0-9]+$")
    words = F.split(low, f"[{BLANKS}]+")
    piece = F.exists(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b")), lambda x: F.endswith(x["a"], F.lit(PIECE)) & F.coalesce(x["b"].substr(1, 1).between("0", "9"), F.lit(False)))
    given = F.regexp_replace(low, f"[{BLANKS}]+=", "=")
    return F.exists(F.split(low, "[^\\p{L}\\p{N}_]+"), numbered) | piece | reduce(or_, (F.contains(given, F.lit(f"{name}=")) for name in ASSIGNED))



def term_present(text: Column, term: Column) -> Column:
    """The text has the term as it is, or, if it has digits, without white space, separators and units."""
    loose = lambda c: F.regexp_replace(c, LOOSE, "")
    return F.contains(text, term) | (term.rlike("[0-9]") & (loose(term) != "") & F.contains(loose(text), loose(term)))


def quality_checks(df: DataFrame) -> DataFrame:
    """``df`` with failed_checks, in the order of CHECKS, and passed.

    Columns: answer, items (of its sections), route; document_pages, external_urls (one a citation, null where it has none), n_document, n_external; and of the case: expected_route, required_terms,
    required_groups (arrays of arrays), forbidden_terms, min_document, min_external, expected_pages. A null answer fails without checks.
    """
    text = F.concat_ws("\n", "answer", "items")
    given = lambda c: F.filter(F.col(c), lambda t: t != "")
    pages, urls = F.array_compact("document_pages"), F.filter(F.array_compact("external_urls"), lambda u: u != "")
    unique = lambda c: F.size(c) == F.size(F.array_distinct(c))
    ok = [
        F.coalesce(F.col("route") == F.col("expected_route"), F.lit(False)),
        F.forall(given("required_terms"), lambda t: term_present(F.col("__text"), t)),
        F.forall(F.filter("required_groups", lambda g: F.size(g) > 0), lambda g: F.exists(g, lambda t: term_present(F.col("__text"), t))),
        ~F.exists(given("forbidden_terms"), lambda t: F.contains(F.col("__text"), t)),
        ~empty_citation(F.col("__text")),
        ~internal(F.col("__text")),
        F.col("n_document") >= F.col("min_document"),
        F.col("n_external") >= F.col("min_external"),
        unique(pages),
        unique(urls),
        (F.size("expected_pages") == 0) | F.arrays_overlap(pages, F.col("expected_pages")),
    ]
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in zip(ok, CHECKS))))
    out = df.withColumn("__text", text).withColumn("failed_checks", F.when(F.col("answer").isNotNull(), failed)).drop("__text")
    return out.withColumn("passed", F.coalesce(F.size("failed_checks") == 0, F.lit(False)) & F.col("answer").isNotNull())


def quality_summary(results: DataFrame, passed: str = "passed", ms: str = "wall_ms") -> DataFrame:
    """One row: cases, passed, failed, total and mean milliseconds; a missing time counts as zero, no case gives zeros."""
    t, n = F.coalesce(F.col(ms), F.lit(0.0)), F.count(F.lit(1))
    return results.agg(n.alias("cases"), F.count_if(passed).alias("passed"), F.count_if(~F.col(passed)).alias("failed"), F.coalesce(F.round(F.sum(t), 1), F.lit(0.0)).alias("total_ms"), F.coalesce(F.round(F.avg(t), 2), F.lit(0.0)).alias("avg_ms"))


def latency_summary(results: DataFrame, route: str, hit: str, ms: str) -> DataFrame:
    """Per expected route: cases, how many were routed otherwise, mean milliseconds of those that have them."""
    return results.groupBy(F.col(route).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(hit)).alias("mismatches"), F.round(F.avg(ms), 3).alias("avg_ms"))


def citation_coverage(facts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A benchmark run over documents (document_id, error): each one's coverage, and the run's.

    ``facts``: document_id, value, n_citations. Coverage is the share of filled fields that are cited, 0 without filled ones; that of the run is the mean over documents that did not fail, and these
    are rows, too.
    """
    filled = F.col("value").isNotNull()
    per = facts.groupBy("document_id").agg(F.count_if(filled).alias("populated"), F.count_if(filled & (F.col("n_citations") > 0)).alias("cited"))
    j = documents.join(per, "document_id", "left").na.fill(0, ["populated", "cited"])
    ok = F.col("error").isNull()
    rows = j.select("document_id", "error", "populated", "cited", F.when(ok, F.when(F.col("populated") == 0, 0.0).otherwise(F.round(F.col("cited") / F.col("populated"), 4))).alias("coverage"))
    return rows, rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if(ok).alias("succeeded"), F.coalesce(F.round(F.avg("coverage"), 4), F.lit(0.0)).alias("macro"))


# --- terms of questions ----------------------------------------------------------------------------------------------

# What stands for a blank in a question, words that ask for nothing by themselves, and characters that mark such words.
PUNCTUATION = "，。！？、；：:,.?;()[]（）/"
STOP_WORDS = ("分别", "是多少", "如何", "哪些", "为什么", "什么", "是否", "公司", "本期", "年报", "披露", "主要", "以及", "和", "与", "及")
STOP_CHARS = "的是多少如何哪些什么以及分别公司本期年报"
#: Pieces that a run of more than LONG_RUN ideographs is cut to.
PIECES, LONG_RUN = (4, 5, 6), 8


def query_terms(question: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """The terms of a question, each once: runs of letters, and of ideographs; of long runs their pieces of four, five and six that are not all stop characters.

    Stop words become blanks one after the other (a word stands before those that it holds). Then ideographs are set apart on lines of their own, and a line without its first digits and signs is a term.
    """
    plain = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), stop, F.regexp_replace(F.coalesce(question, F.lit("")), f"[{re.escape(PUNCTUATION)}]+", " "))
    apart = F.split(F.regexp_replace(plain, "([一-鿿]+)", "\n$1\n"), "[^一-鿿A-Za-z0-9& -]+")
    runs = F.filter(F.transform(apart, lambda t: strip(F.regexp_replace(t, "^[0-9& -]+", ""))), lambda t: F.length(t) >= 2)
    telling = lambda p: F.length(F.translate(p, STOP_CHARS, "")) > F.least(F.length(p) - 2, F.lit(1))

    def pieces(t: Column) -> Column:
        starts = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.struct(i.alias("i"), F.lit(n).alias("n")))
        places = F.flatten(F.array(*map(starts, PIECES)))
        return F.filter(F.transform(places, lambda x: t.substr(x["i"], x["n"])), telling)

    cut = F.flatten(F.transform(runs, lambda t: F.when(t.rlike("^[一-鿿]") & (F.length(t) > LONG_RUN), pieces(t)).otherwise(F.array(t))))
    keyed = F.transform(cut, lambda t: F.struct(t.alias("term"), F.regexp_replace(F.lower(t), r"(?U)\s+", "").alias("key")))
    seen = F.aggregate(keyed, F.array().cast("array<struct<term:string,key:string>>"), lambda out, x: F.when(F.exists(out, lambda o: o["key"] == x["key"]), out).otherwise(F.array_append(out, x)))
    return F.transform(seen, lambda x: x["term"])
