"""Chat over documents: what a question asks for, which citations an answer gets, and how its parts are laid out. Native functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.functions.periods import has_any
from tracefolio.functions.text import collapse, compact, rstrip

# What marks a question for the causes of a metric's change.
TOPIC = ("经营指标", "运营指标", "财务指标", "存货", "库存", "渠道库存")
EFFICIENCY = ("渠道效率", "周转", "周转率", "存货周转")
ABNORMAL = ("异常", "是否异常", "偏高", "偏低")
CAUSE = ("原因", "驱动", "为什么", "为何")
CHANGE = ("变化", "变动", "提升", "下降", "改善", "恶化")
DISCUSSION = ("解释", "描述")
# Retrieval modes, titles and sentences of answers.
HYBRID, LEGACY = "page_text_hybrid_no_table_primary", "legacy_typed_table_row_primary"
TITLES = {"mixed": ("概念与外部背景", "文档事实", "综合分析与边界"), "": ("外部解释", "文档证据", "分析与边界")}
EXTERNAL_PARTLY = "外部检索未完全可用，因此这次回答的外部背景信息可能不完整。"
UNSUPPORTED = ("这个问题超出了当前演示系统的文档问答与概念解释范围。", "当前只支持基于公开信披材料的问答，以及与这份文档相关的外部概念解释。")
EXTERNAL_DOWN = "这个问题需要外部概念解释，但当前外部检索暂时不可用。"
QUOTE = 260


def intent_hint(question: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """``metric_attribution`` if the question names a topic or an efficiency and asks for an abnormal value, a cause, or a discussion of a change or of an efficiency; else null.

    ``words`` may name other words of the six kinds.
    """
    w = {"topic": TOPIC, "efficiency": EFFICIENCY, "abnormal": ABNORMAL, "cause": CAUSE, "change": CHANGE, "discussion": DISCUSSION} | (words or {})
    q = compact(F.coalesce(question, F.lit("")))
    has = {k: has_any(q, v) for k, v in w.items()}
    asked = has["abnormal"] | has["cause"] | (has["discussion"] & (has["change"] | has["efficiency"]))
    return F.when((has["topic"] | has["efficiency"]) & asked, F.lit("metric_attribution"))


def effective_question(original: Column, standalone: Column) -> Column:
    """The question made to stand alone, unless that is blank."""
    s = F.trim(F.regexp_replace(F.coalesce(standalone, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(s == "", original).otherwise(s)


def has_context(recent: Column, summary: Column, *lists: Column) -> Column:
    """Has the session messages, a summary, or anything in the summary's lists?"""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return reduce(lambda a, b: a | b, map(some, lists), some(recent) | (F.coalesce(F.regexp_replace(summary, r"(?U)\s+", ""), F.lit("")) != ""))


def plan_defaults(df: DataFrame, question: str = "question") -> DataFrame:
    """A plan (document_query, external_query, subquestions, external_search_kind, needs_external_background, needs_risk_reasoning) with what is missing filled in from the question."""
    q = lambda c: F.trim(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col(question)).otherwise(F.col(c)))
    wide = F.col("needs_external_background") | F.col("needs_risk_reasoning")
    kind = F.when(F.col("external_search_kind") == "none", F.when(wide, F.lit("concept_and_background")).otherwise(F.lit("concept"))).otherwise(F.col("external_search_kind"))
    asked = F.when(F.coalesce(F.size("subquestions"), F.lit(0)) <= 0, F.array(F.col(question))).otherwise(F.col("subquestions"))
    return df.withColumns({"document_query": q("document_query"), "external_query": q("external_query"), "subquestions": asked, "external_search_kind": kind, "analysis_mode": F.lit("mixed")})


def retrieval_mode(route: Column, document_mode: Column, external: Column) -> Column:
    """The name of how an answer's evidence was found. ``external``: did the external search give a result?"""
    mode = F.coalesce(document_mode, F.lit(""))
    mixed = F.when(mode == HYBRID, f"mixed_{HYBRID}_external").when(mode == LEGACY, f"mixed_{LEGACY}_external").otherwise("mixed_document_external")
    return (
        F.when(route == "unsupported", F.lit("unsupported"))
        .when(external & (route == "mixed") & (mode != ""), mixed)
        .when(external & route.isin("concept_only", "mixed"), F.lit("external_web_search"))
        .when(mode != "", mode)
        .otherwise(F.lit("semantic_with_filters"))
    )


def answer_sections(route: Column, document: Column, external: Column, analysis: Column, external_failed: Column) -> Column:
    """array<struct<section_type, title, items>>: the parts that have items. External evidence stands before the document's, but behind it where the route is document_only; other routes show none."""
    items = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    title = lambda k: F.when(route == "mixed", TITLES["mixed"][k]).otherwise(TITLES[""][k])
    limits = F.when(external_failed, F.array_append(items(analysis), F.lit(EXTERNAL_PARTLY))).otherwise(items(analysis))
    part = lambda kind, k, c, test: F.when(test & (F.size(c) > 0), F.struct(F.lit(kind).alias("section_type"), title(k).alias("title"), c.alias("items")))
    always = F.lit(True)
    return F.array_compact(
        F.array(
            part("external_evidence", 0, items(external), route.isin("concept_only", "mixed")),
            part("document_evidence", 1, items(document), always),
            part("external_evidence", 0, items(external), route == "document_only"),
            part("analysis_and_limits", 2, limits, always),
        )
    )


def resolve_citations(used: DataFrame, chunks: DataFrame, external: DataFrame, by: list[str]) -> DataFrame:
    """Citations of answers, before repeats are dropped: ``by``, pos, citation_id, source_type, page_number, quote, url, title.

    ``used``: by, pos, kind (document or external) and ref, in the answer's order; ``chunks``: ref, page_number, text; ``external``: ref, url, title, quote. Unknown references fall out.
    Documents come first and are numbered over those that are known; external ones keep their own ids.
    """
    refs = used.select(*by, "pos", "kind", "ref")
    d = refs.where("kind = 'document'").join(chunks.select("ref", "page_number", F.col("text").alias("quote")), "ref")
    n = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    doc = d.withColumn("n", n).select(*by, F.lit(0).alias("part"), "pos", F.concat(F.lit("chat-citation-"), F.col("n").cast("string")).alias("citation_id"), F.lit("document").alias("source_type"), F.col("page_number").cast("long").alias("page_number"), short_quote(F.col("quote")).alias("quote"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"))
    e = refs.where("kind = 'external'").join(external.select("ref", "url", "title", "quote"), "ref")
    ext = e.select(*by, F.lit(1).alias("part"), "pos", F.col("ref").cast("string").alias("citation_id"), F.lit("external").alias("source_type"), F.lit(None).cast("long").alias("page_number"), "quote", "url", "title")
    return doc.unionByName(ext)


def short_quote(text: Column, most: int = QUOTE) -> Column:
    """White space collapsed, at most ``most`` characters."""
    t = collapse(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(rstrip(F.substring(t, 1, most - 3)), F.lit("...")))


def dedupe_citations(citations: DataFrame, by: list[str]) -> DataFrame:
    """The first citation of each page (without a page: of each quote) and of each external source (its URL, else its title, else its id). Numbers given before keep their gaps. An aggregate: rows combine before the shuffle."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    page = F.concat(F.lit("page:"), F.col("page_number").cast("string"))
    document = F.coalesce(page, F.concat(F.lit("quote:"), F.trim(F.coalesce("quote", F.lit("")))))
    source = F.concat(F.lit("source:"), F.trim(F.coalesce(given("url"), given("title"), F.col("citation_id"))))
    keyed = citations.withColumn("key", F.when(F.col("source_type") == "document", document).otherwise(source))
    return keyed.groupBy(*by, "key").agg(F.min_by(F.struct(*citations.columns), F.struct("part", "pos")).alias("r")).select("r.*")


def event_rows(answers: DataFrame, by: list[str]) -> DataFrame:
    """The events of each answer's stream in order (by, seq, kind, body): the stages while it ran, its text in parts, its citations, then ``done``, or ``error`` alone where it failed.

    ``answers``: by, stages array<string>, parts array<string>, citations array<string>, error (null: none).
    """
    row = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.cast("string").alias("body"))
    each = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: row(kind, x))
    ended = F.concat(each("delta", "parts"), each("citation", "citations"), F.array(row("done", F.lit(None))))
    events = F.concat(each("status", "stages"), F.when(F.col("error").isNotNull(), F.array(row("error", F.col("error")))).otherwise(ended))
    return answers.select(*by, F.posexplode(events).alias("seq", "e")).select(*by, F.col("seq").cast("long").alias("seq"), "e.kind", "e.body")


def reader_drafts(points: DataFrame, issues: DataFrame) -> DataFrame:
    """Points as a reader would draft them again, before they are verified anew: (document_id, item_key, text, evidence_page, evidence_quote, confidence).

    ``points``: document_id, item_key, text, cited, citation_page, citation_quote (of the first citation); ``issues``: document_id, scope, severity, item_key, page, quote, at. A citation's place
    holds, and makes the draft certain; else that of the last issue of a summary's point that asks for review.
    """
    own = issues.where("scope = 'summary' and severity = 'review'").groupBy("document_id", "item_key").agg(F.max_by(F.struct("page", "quote"), "at").alias("i"))
    j = points.join(own, ["document_id", "item_key"], "left")
    place = lambda a, b: F.when(F.col("cited"), F.col(a)).otherwise(F.col(b))
    return j.select("document_id", "item_key", "text", place("citation_page", "i.page").alias("evidence_page"), place("citation_quote", "i.quote").alias("evidence_quote"), F.when(F.col("cited"), F.lit(1.0)).alias("confidence"))


# How a chunk's metadata are named in a prompt, in order.
CONTEXT_LINES = (("Evidence kind", "chunk_kind"), ("Section", "section_title"), ("Section type", "section_type"), ("Table row", "row_label"), ("Metric tags", "metric_tags"), ("Period hint", "period_hint"))
EXCERPT, SNIPPET, MOST_REFS = 700, 320, 4


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def excerpt(text: Column, most: int) -> Column:
    t = stripped(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(rstrip(F.substring(t, 1, most - 3)), F.lit("...")))


def prompt_context(chunks: DataFrame, by: list[str]) -> DataFrame:
    """The context of a prompt, a row for each of ``by``, and what its references stand for: context, refs map<string, string>.

    ``chunks``: by, pos, chunk_id, page_number, text, and any of the metadata columns of CONTEXT_LINES (metric_tags joined): the few that a search has retrieved for one question.
    """
    n = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    given = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    lines = [F.concat(F.lit(f"{name}: "), given(c)) for name, c in CONTEXT_LINES if c in chunks.columns]
    page = F.concat(F.lit("Page: "), F.coalesce(F.col("page_number").cast("string"), F.lit("unknown")))
    ref = F.concat(F.lit("DOC_"), F.col("n").cast("string"))
    block = F.concat_ws("\n", F.concat(F.lit("[Document evidence "), ref, F.lit("]")), page, *lines, F.concat(F.lit("Excerpt: "), excerpt(F.col("text"), EXCERPT)))
    rows = chunks.withColumn("n", n).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b"), ref.alias("ref"), F.col("chunk_id").cast("string").alias("id")))).alias("r"))
    return rows.select(*by, F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("context"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["ref"], x["id"]))).alias("refs"))


def resolved_refs(refs: Column, known: Column) -> Column:
    """What an answer's references stand for, in its order, each once, four at most; unknown ones fall out."""
    return F.slice(F.array_distinct(F.array_compact(F.transform(refs, lambda r: F.nullif(F.try_element_at(known, r), F.lit(""))))), 1, MOST_REFS)
