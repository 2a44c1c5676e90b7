"""Evidence: page texts to chunks, sections, table rows, scored and selected pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.functions.text import collapse, compact, context, lines, truncate
from tracefolio.operators import gram_index

#: Per page: a term counts 5 up to 40, two numbers 1 up to a cap, a line like a table's 2 up to 16, a section word 4 up to 12, the whole query 10.
NUMBER = r"[0-9]+(?:[.,][0-9]+)?\s*(?:%|个百分点|百万元|亿元|元|TEU|吨|次)?"
PLAIN_NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
LETTER = r"[一-鿿A-Za-z]"


def page_text(markdown: Column, text: Column) -> Column:
    """Markdown where there is any, else the text."""
    return F.coalesce(F.nullif(markdown, F.lit("")), text)


def explode_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: line_no from 0, line. Blank lines are left out before numbering."""
    keep = [c for c in pages.columns if c != text]
    return pages.select(*keep, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "line"))


def clean_lines(pages: DataFrame, key: str, drop: Column) -> DataFrame:
    """Lines without those that ``drop`` names (over line, line_no, n_lines), and without repeats of the line before."""
    counted = pages.select(key, lines(F.coalesce("text", F.lit(""))).alias("ls")).select(key, F.size("ls").alias("n_lines"), F.posexplode("ls").alias("line_no", "line"))
    kept = counted.where(~drop)
    before = F.lag("line").over(Window.partitionBy(key).orderBy("line_no"))
    return kept.withColumn("before", before).where(~F.col("line").eqNullSafe(F.col("before"))).select(key, "line_no", "line")


def term_score(text: Column, terms: list[str]) -> Column:
    t = compact(text)
    return F.least(F.lit(40), 5 * sum((F.contains(t, compact(F.lit(x))).cast("int") for x in terms), F.lit(0)))


def numeric_score(text: Column, cap: int = 12) -> Column:
    return F.least(F.lit(cap), F.floor(F.regexp_count(text, F.lit(NUMBER)) / 2).cast("int"))


def table_score(text: Column) -> Column:
    like = F.filter(lines(text), lambda l: (F.regexp_count(l, F.lit(PLAIN_NUMBER)) >= 2) & l.rlike(LETTER))
    return F.least(F.lit(16), F.size(like) * 2)


def section_score(text: Column, words: list[str]) -> Column:
    t = compact(text)
    return F.least(F.lit(12), 4 * sum((F.contains(t, compact(F.lit(w))).cast("int") for w in words), F.lit(0)))


def search_pages(pages: DataFrame, terms: list[str], *, query: str, table: bool, section_words: list[str] | None, narrative: bool, top_pages: int, by: str) -> DataFrame:
    """Pages with a term by their score: by, doc_id, the part scores, score, rank."""
    text = F.coalesce("text", F.lit(""))
    scored = pages.withColumn("term_score", term_score(text, terms)).where("term_score > 0").withColumns(
        {
            "numeric_score": numeric_score(text, 4 if narrative else 12),
            "table_score": table_score(text) if table else F.lit(0),
            "section_score": section_score(text, section_words) if section_words else F.lit(0),
            "exact_score": F.when(F.contains(compact(text), compact(F.lit(query))), 10).otherwise(0),
        }
    )
    total = F.col("term_score") + F.col("numeric_score") + F.col("table_score") + F.col("section_score") + F.col("exact_score")
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc("term_score"), "doc_id"))
    return scored.withColumn("score", total).withColumn("rank", n).where(F.col("rank") <= top_pages)


def confidence(score: Column) -> Column:
    return F.when(score >= 32, "high").when(score >= 14, "medium").otherwise("low")


def anchor_status(score: Column, n_terms: Column, shaped: Column) -> Column:
    return F.when((score >= 32) & (n_terms >= 2) & shaped, "auto_anchor_high_confidence").when(score > 0, "auto_anchor_low_confidence").otherwise("needs_manual_probe")


def section_type(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The rule with most keywords in the text; of equal ones the first; ``other`` without any."""
    t = compact(text)
    scored = F.array(*(F.struct(sum((F.contains(t, compact(F.lit(w))).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules)))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit("other"))


def table_rows(pages: DataFrame, definitions: list[tuple[str, list[str]]], *, per_label: int = 24, per_document: int = 120, key: str = "doc_id") -> DataFrame:
    """Lines that name a metric and have numbers nearby: key, line_no, row_label, context.

    A line of at most 90 characters (45 with punctuation) that has an alias; of several metrics the one with the longest alias. The context is three
    lines before and five after. Caps in the order of lines: ``per_label`` rows a label, ``per_document`` a document.
    """
    ls = pages.select(key, lines(F.coalesce("text", F.lit(""))).alias("ls"))
    rows = ls.select(key, "ls", F.posexplode("ls").alias("line_no", "line"))
    short = F.length(compact(F.col("line")))
    rows = rows.where((short > 0) & (short <= 90) & ~((short > 45) & F.col("line").rlike("[，。；:：]")))
    name = None
    for label, aliases in sorted(definitions, key=lambda d: -max(len(a) for a in d[1])):
        test = F.array_max(F.array(*(F.contains(compact(F.col("line")), compact(F.lit(a))) for a in aliases)))
        name = F.when(test, F.lit(label)) if name is None else name.when(test, F.lit(label))
    named = rows.withColumn("row_label", name).where("row_label is not null").withColumn("context", F.array_join(context(F.col("ls"), F.col("line_no"), 3, 5), "\n")).where(F.col("context").rlike("[0-9]"))
    first = named.groupBy(key, "row_label", compact(F.col("context")).alias("ck")).agg(F.min(F.struct("line_no", "context")).alias("r")).select(key, "row_label", "r.*")
    capped = first.withColumn("n", F.row_number().over(Window.partitionBy(key, "row_label").orderBy("line_no"))).where(F.col("n") <= per_label)
    return capped.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("line_no", "row_label"))).where(F.col("n") <= per_document).drop("n")


def compose_row(label: Column, tags: Column, page: Column, period: Column, context_: Column) -> Column:
    """The text of a table row's evidence; no period line without a period."""
    return F.concat_ws("\n", F.concat(F.lit("Table row: "), label), F.concat(F.lit("Metric tags: "), F.array_join(tags, ", ")), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Period: "), period), F.lit("Context:"), context_)


def suspicious(title: Column, section: Column) -> Column:
    """Why a title looks like no title."""
    t = collapse(F.coalesce(title, F.lit("")))
    reasons = F.array_compact(
        F.array(
            F.when(t.rlike(r"^[0-9]+(?:\.[0-9]+)?\s*[%％]$"), F.lit("naked_percent")),
            F.when(t.rlike(r"^(?:19|20)[0-9]{2}(?:年|[-/.年][0-9]{1,2}(?:月|[-/.月][0-9]{1,2}日?)?)?$"), F.lit("date_like")),
            F.when(t.rlike("[樓楼室街路號号]|大厦|大廈"), F.lit("address_like")),
            F.when(F.contains(t, F.lit("...")) | t.endswith("…"), F.lit("truncated")),
            F.when((F.length(t) > 1) & (F.length(t) <= 4) & (section == "other"), F.lit("short_other")),
            F.when(t.rlike(r"^[0-9][0-9.,]*\s*(?:$|[月日%％點点倍次戶户])"), F.lit("numeric_fragment")),
        )
    )
    return F.when(t == "", F.array(F.lit("empty_title"))).otherwise(reasons)


def page_budget(pages: DataFrame, score: Column, *, front: int, top: int, by: str, order: str) -> DataFrame:
    """The first ``front`` pages of each group and its ``top`` best ones, each page once, front pages first."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    m = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("s"), order))
    ranked = pages.withColumn("s", score).withColumn("n", n).withColumn("m", m)
    return ranked.where((F.col("n") <= front) | ((F.col("m") <= top) & (F.col("s") > 0))).withColumn("pos", F.when(F.col("n") <= front, F.col("n")).otherwise(front + F.col("m")))


#: Readings of a page, in the order in which they count; and the characters by which two are told apart.
MODES, TOLD_APART = ("text", "blocks", "words"), 500


def deep_pages(readings: DataFrame, key: list[str], modes: tuple[str, ...] = MODES) -> DataFrame:
    """(key, mode, text) to key and text: a page's readings one below the other, without those that begin like an earlier one (500 characters, white space collapsed). Pages without text fall out."""
    per = readings.groupBy(*key).agg(F.array(*(F.max(F.when(F.col("mode") == m, F.col("text"))) for m in modes)).alias("parts"))
    given = per.withColumn("parts", F.filter("parts", lambda p: p.isNotNull() & (collapse(p) != "")))
    keyed = given.withColumn("keys", F.transform("parts", lambda p: F.substring(collapse(p), 1, TOLD_APART)))
    first = F.filter(F.arrays_zip("parts", "keys", F.transform("keys", lambda k, i: i).alias("i")), lambda x: F.array_position(F.col("keys"), x["keys"]) == x["i"] + 1)
    return keyed.where(F.size("parts") > 0).select(*key, F.array_join(F.transform(first, lambda x: x["parts"]), "\n").alias("text"))


def quote_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quote_id, doc_id of the pages (doc_id, text) that contain a quote, both compacted; quotes under six characters match nothing.

    Pages are found by the quotes' grams (``gram_index``); no page is compared with a quote that it shares no gram with.
    """
    texts = pages.select("doc_id", compact(F.coalesce("text", F.lit(""))).alias("text"))
    asked = quotes.select("quote_id", compact(F.col("quote")).alias("quote")).where("length(quote) >= 6")
    found = gram_index.candidates(asked, texts, lambda q: [q], lambda t: (t, []), "compact")
    return gram_index.meet(found, asked, texts).where(F.contains("text", F.col("quote"))).select("quote_id", "doc_id")
