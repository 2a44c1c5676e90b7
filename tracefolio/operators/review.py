"""Review of drafted summaries and facts: citations found on their pages, issues, states, and what people decided about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefolio.operators.documents import each, find_quote

#: A document with fewer points gets a warning.
FULL_SUMMARY = 6


def cite_points(points: DataFrame, pages: DataFrame) -> DataFrame:
    """Points (document_id, item_key, text, evidence_page, evidence_quote) with ``found``: the quote as its page has it, else null. Points meet their page by an equi-join."""
    p = pages.select("document_id", F.col("page_number").alias("evidence_page"), F.col("text").alias("page_text"))
    joined = points.join(p, ["document_id", "evidence_page"], "left")
    schema = "document_id string, item_key string, text string, evidence_page int, evidence_quote string, found string"
    return each(joined, ["document_id", "item_key", "text", "evidence_page", "evidence_quote", "page_text"], lambda r: [(*r[:5], find_quote(r[5], r[4]))], schema)


def issues(cited: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, scope, item_key, severity, reason: points whose quote isn't found, facts (document_id, field, value, n_citations) without a citation, and short summaries."""
    points = cited.where("found is null").select("document_id", F.lit("summary").alias("scope"), "item_key", F.lit("review").alias("severity"), F.lit("citation_missing").alias("reason"))
    numbers = facts.where("value is not null and n_citations = 0").select("document_id", F.lit("fact").alias("scope"), F.col("field").alias("item_key"), F.lit("review").alias("severity"), F.lit("citation_missing").alias("reason"))
    n = documents.select("document_id").join(cited.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = n.where(F.col("n") < FULL_SUMMARY).select("document_id", F.lit("summary").alias("scope"), F.lit("summary_output").alias("item_key"), F.when(F.col("n") == 0, "review").otherwise("warning").alias("severity"), F.lit("summary_incomplete").alias("reason"))
    return points.unionByName(numbers).unionByName(short)


def states(cited: DataFrame, facts: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a document: verified and pending items, and needs_confirmation if any issue asks for review, else passed."""
    ok = cited.select("document_id", F.col("found").isNotNull().alias("ok")).unionByName(facts.where("value is not null").select("document_id", (F.col("n_citations") > 0).alias("ok")))
    counts = ok.groupBy("document_id").agg(F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("pending"))
    asked = found.where("severity = 'review'").select("document_id").distinct().withColumn("asked", F.lit(True))
    j = documents.select("document_id").join(counts, "document_id", "left").join(asked, "document_id", "left")
    return j.select("document_id", F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("pending", F.lit(0)).alias("pending"), F.when(F.col("asked"), "needs_confirmation").otherwise("passed").alias("status"))


def decide(found: DataFrame, actions: DataFrame) -> DataFrame:
    """Issues that are open after all actions (document_id, item_key, action, at): of each item the last action counts; an approved item has no issue, a rerun one keeps its own."""
    last = actions.groupBy("document_id", "item_key").agg(F.max_by("action", "at").alias("action"))
    return found.join(last.where("action = 'approve'"), ["document_id", "item_key"], "left_anti")


#: Which issues a rerun of a category does again.
CATEGORIES = {"summary": ("summary",), "numeric": ("fact",), "citation": ("summary", "fact")}


def rerun(found: DataFrame, fresh: DataFrame, category: str) -> DataFrame:
    """Issues after a category was done again: its old ones go, the new ones of its scopes come."""
    mine = F.col("scope").isin(*CATEGORIES[category])
    if category == "citation":
        mine = mine & (F.col("reason") == "citation_missing")
    return found.where(~mine).unionByName(fresh.where(mine))


def changed_fields(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """document_id and the fields whose struct differs between two runs; documents of one run only count with all their fields."""
    a = before.select("document_id", F.struct(*fields).alias("a"))
    b = after.select("document_id", F.struct(*fields).alias("b"))
    differ: list[Column] = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]
    return a.join(b, "document_id", "full").select("document_id", F.array_compact(F.array(*differ)).alias("changed")).where("size(changed) > 0")


def review_state(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state of reviewed results, worked out anew: a row a document, and a row a section.

    ``items``: document_id, kind (overview, point or field), section, needs_review, value, n_citations. Overviews and points are verified unless they need review, filled fields if they are cited; empty
    fields count for nothing. A section needs review if one of its points does; a document if anything is pending.
    """
    field = F.col("kind") == "field"
    pending = F.when(field, F.when(F.col("value").isNotNull(), F.col("n_citations") == 0)).otherwise(F.col("needs_review"))
    marked = items.withColumn("pending", pending).where("pending is not null")
    n = F.count_if("pending")
    documents = marked.groupBy("document_id").agg(F.count_if(~F.col("pending")).alias("verified"), n.alias("pending"), F.when(n > 0, "needs_confirmation").otherwise("passed").alias("status"))
    sections = items.where("kind = 'point'").groupBy("document_id", "section").agg(F.bool_or("needs_review").alias("needs_review"))
    return documents, sections


def verified_view(points: DataFrame) -> DataFrame:
    """What is shown when only verified points are asked for: points that need no review; a section without any goes with them."""
    return points.where(~F.coalesce(F.col("needs_review"), F.lit(False)))


# The figures that a table's reading may replace.
FIGURES = ("revenue", "net_profit", "total_assets", "total_liabilities", "roe")


def merge_figures(model: DataFrame, tables: DataFrame, key: str = "document_id") -> DataFrame:
    """Figures that a model has read, with those that tables give in their place; a unit likewise, unless it is blank. Where there is a table (has_table_signal) that gives no return on equity, the model's goes.

    ``model``: key, unit, FIGURES; ``tables``: the same and has_table_signal.
    """
    t = tables.select(key, *(F.col(c).alias(f"t_{c}") for c in ("unit", *FIGURES)), "has_table_signal")
    j = model.join(t, key, "left")
    signal = F.coalesce(F.col("has_table_signal"), F.lit(False))
    new = {c: F.coalesce(f"t_{c}", c) for c in FIGURES}
    new["roe"] = F.when(signal & F.col("t_roe").isNull(), F.lit(None)).otherwise(new["roe"])
    return j.select(key, F.coalesce(F.nullif("t_unit", F.lit("")), "unit").alias("unit"), *(new[c].alias(c) for c in FIGURES))


def pages_for(shared: Column, own: Column) -> Column:
    """The pages that a field is looked for on: the shared ones, then its own, each once."""
    listed = lambda c: F.coalesce(c, F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(listed(shared), listed(own)))


def all_pages(shared: Column, fields: Column) -> Column:
    """All pages of a selection (shared pages, and a map or list of fields' pages in order), each once; the shared ones where there is no field."""
    return pages_for(shared, F.flatten(fields))
