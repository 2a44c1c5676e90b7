"""Evaluation: three-valued scores of cases, summaries, hit ranks, rescue and failure reports.

A score is true, false or null. Null (not required, or not executed) beats everything; what was executed and gave nothing is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_score(observed: Column, expected: Column, executed: Column) -> Column:
    return F.when(observed.isNull(), F.when(executed, F.lit(False))).otherwise(observed.eqNullSafe(expected))


def overlap_score(observed: Column, expected: Column, executed: Column) -> Column:
    """Do the arrays share a value? Null where nothing is expected."""
    nothing = F.coalesce(F.size(observed), F.lit(0)) <= 0
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, F.lit(None).cast("boolean")).when(nothing, F.when(executed, F.lit(False))).otherwise(F.coalesce(F.arrays_overlap(observed, expected), F.lit(False)))


def subset_score(observed: Column, expected: Column, executed: Column) -> Column:
    nothing = F.coalesce(F.size(observed), F.lit(0)) <= 0
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, F.lit(None).cast("boolean")).when(nothing, F.when(executed, F.lit(False))).otherwise(F.size(F.array_except(expected, observed)) == 0)


def anchors_valid(pages: Column, executed: Column) -> Column:
    return F.when(F.coalesce(F.size(pages), F.lit(0)) <= 0, F.when(executed, F.lit(False))).otherwise(F.forall(pages, lambda p: p > 0))


def absent_score(text: Column, forbidden: Column, executed: Column) -> Column:
    """None of the strings is in the answer."""
    return F.when(F.coalesce(F.size(forbidden), F.lit(0)) <= 0, F.lit(None).cast("boolean")).when(text.isNull(), F.when(executed, F.lit(False))).otherwise(~F.exists(forbidden, lambda f: F.contains(text, f)))


# What the hygiene checks of an answer look for.
RAW_METADATA = r"(?i)chunk_id|source_path|document_id|\bDOC_[0-9]+|\bWEB_[0-9]+"
EMPTY_PARENTHESES = r"\(\s*\)|（\s*）|\[\s*\]"
UNIT = r"元|%|％|亿|億|万|萬|百万|million|RMB|CNY|HKD|USD"
PERIOD = r"20[0-9]{2}|年度|季度|半年|全年"


def hygiene(text: Column, check: Column) -> Column:
    """Does the answer pass the check? Null for an unknown check or without an answer."""
    passed = F.when(check == "no_raw_metadata", ~text.rlike(RAW_METADATA)).when(check == "no_empty_parentheses", ~text.rlike(EMPTY_PARENTHESES)).when(check == "unit_period_present", text.rlike(UNIT) & text.rlike(PERIOD))
    return F.when(text.isNotNull(), passed)


def case_scores(cases: DataFrame, top_k: int, answers: bool = True) -> DataFrame:
    """Cases joined with observations (columns of both schemas) with the eleven scores."""
    executed = F.coalesce(F.col("executed"), F.lit(False))
    quality = executed & F.lit(answers)
    head = lambda c: F.slice(c, 1, top_k)
    return cases.withColumns(
        {
            "route_hit": equal_score(F.col("route"), F.col("expected_route"), executed),
            "intent_hit": equal_score(F.col("document_evidence_intent"), F.col("expected_document_evidence_intent"), executed),
            f"evidence_kind_hit@{top_k}": overlap_score(head("retrieved_evidence_kinds"), F.when(F.col("primary_evidence_kind") != "", F.array("primary_evidence_kind")), executed),
            f"page_hit@{top_k}": overlap_score(head("citation_pages"), F.col("expected_pages"), executed),
            f"table_row_label_hit@{top_k}": overlap_score(head("retrieved_row_labels"), F.col("expected_row_labels"), executed),
            f"metric_tag_hit@{top_k}": overlap_score(head("retrieved_metric_tags"), F.col("expected_metric_tags"), executed),
            f"section_type_hit@{top_k}": overlap_score(head("retrieved_section_types"), F.col("expected_section_types"), executed),
            "required_fields_present": subset_score(F.col("answer_field_ids"), F.col("expected_answer_field_ids"), quality),
            "citation_anchor_valid": anchors_valid(F.col("citation_pages"), executed),
            "forbidden_failure_absent": absent_score(F.col("answer_text"), F.col("forbidden_failure_modes"), quality),
            "output_hygiene_passed": hygiene_score(F.col("answer_text"), F.col("answer_hygiene_checks"), quality),
        }
    )


def hygiene_score(text: Column, checks: Column, executed: Column) -> Column:
    results = F.transform(checks, lambda c: hygiene(text, c))
    return F.when(F.coalesce(F.size(checks), F.lit(0)) <= 0, F.lit(None).cast("boolean")).when(F.exists(results, lambda r: r.isNull()), F.when(executed, F.lit(False))).otherwise(F.forall(results, lambda r: r))


def score_summary(df: DataFrame, scores: list[str], by: list[str] | None = None) -> DataFrame:
    """For each score how many cases it was given, passed, and their rate (null where none was given): one row a score, one aggregate for all."""
    by = by or []
    wide = df.groupBy(*by).agg(*(a for s in scores for a in (F.count(s).alias(f"{s}__n"), F.count_if(s).alias(f"{s}__p"))))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(f"{s}__n").alias("scored"), F.col(f"{s}__p").alias("passed")) for s in scores)))
    return wide.select(*by, rows.alias("r")).select(*by, "r.*", (F.col("r.passed") / F.nullif(F.col("r.scored"), F.lit(0))).alias("rate"))


def hit_rates(df: DataFrame, by: list[str], hit: str) -> DataFrame:
    """Cases, hits and rate of each group; a missing hit counts as none."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.coalesce(F.col(hit), F.lit(False))).alias("hits")).withColumn("rate", F.col("hits") / F.col("cases"))


def expected_ranks(expected: DataFrame, candidates: DataFrame, final_k: int) -> DataFrame:
    """(case_id, page) of expected pages with the best rank among (case_id, page, rank); the sentinel where there is none."""
    best = candidates.groupBy("case_id", "page").agg(F.min("rank").alias("rank"))
    out = expected.join(best, ["case_id", "page"], "left")
    return out.select("case_id", "page", F.coalesce(F.col("rank").cast("string"), F.lit("not_in_top_candidates")).alias("best_rank"), F.coalesce(F.col("rank") <= final_k, F.lit(False)).alias("final_hit"))


def rescue(df: DataFrame, baseline: str, variants: list[str]) -> DataFrame:
    """For each variant: hits, and the cases that it rescues or loses against the baseline."""
    base = F.coalesce(F.col(baseline), F.lit(False))
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.coalesce(F.col(v), F.lit(False)).alias("hit")) for v in variants)))
    return df.select(base.alias("base"), rows.alias("r")).groupBy(F.col("r.variant").alias("variant")).agg(
        F.count_if("r.hit").alias("hits"), F.count_if(F.col("r.hit") & ~F.col("base")).alias("rescued"), F.count_if(~F.col("r.hit") & F.col("base")).alias("regressed")
    )


def failure_category(expected_intent: Column, live_intent: Column, parsed: Column, any_unit: Column, any_row: Column, any_section: Column, rescued: Column, generic_rows: Column) -> Column:
    """The first rule that holds."""
    mismatch = live_intent.isNotNull() & (live_intent != expected_intent)
    return (
        F.when(mismatch & rescued, F.lit("page_rescued_but_live_intent_mismatch"))
        .when(mismatch, F.lit("router_intent_mismatch"))
        .when(~parsed, F.lit("page_number_mapping_suspect"))
        .when(~any_unit, F.lit("gold_page_evidence_missing"))
        .when((expected_intent == "metric_value") & ~any_row, F.lit("table_extraction_gap"))
        .when(expected_intent.isin("metric_attribution", "business_narrative") & ~(any_section | any_row), F.lit("chunking_or_page_anchor_gap"))
        .when(rescued, F.lit("gold_page_low_rank"))
        .when(generic_rows, F.lit("generic_metric_row_dominance"))
        .otherwise(F.lit("gold_page_low_rank"))
    )


def false_positives(candidates: DataFrame, expected: DataFrame, *, final_k: int, most: int = 4) -> DataFrame:
    """Ranked rows (case_id, page, rank, ...) among the first that hit no expected page, each page once, ``most`` a case."""
    wrong = candidates.where(F.col("rank") <= final_k).join(expected.select("case_id", "page"), ["case_id", "page"], "left_anti")
    first = wrong.groupBy("case_id", "page").agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "page"))
    return first.withColumn("n", n.cast("long")).where(F.col("n") <= most)


def failure_reasons(rules: list[tuple[Column, str]]) -> Column:
    """The names of the scores that are false, in the rules' order."""
    return F.array_compact(F.array(*(F.when(test.eqNullSafe(F.lit(False)), F.lit(name)) for test, name in rules)))


def router_accuracy(df: DataFrame, router: str, ok: str, route_hit: str, full_hit: str, ms: str) -> DataFrame:
    """Per router: hits count succeeded results only, the denominator all results; mean latency of those that have one."""
    hit = lambda c: F.count_if(F.col(ok) & F.col(c))
    n = F.count(F.lit(1))
    return df.groupBy(router).agg(n.alias("cases"), F.round(hit(route_hit) / n, 4).alias("route_accuracy"), F.round(hit(full_hit) / n, 4).alias("full_accuracy"), F.round(F.avg(F.when(F.col(ms).isNotNull(), F.col(ms))), 4).alias("avg_ms"))
