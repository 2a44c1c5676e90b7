"""Whole-document transforms over documents. They are Python state machines, so no SQL stands beside them; tests/test_documents.py holds them to cases by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.functions import answers, numbers, phrases, quote_units
from tracefolio.functions import text as T
from tracefolio.operators import documents as ops
from tracefolio.operators import line_tables as lt
from tracefolio.operators import sections
from tracefolio.session import table
from tracefolio.sources import artifacts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def bind(f):
    QUERIES[f.__name__] = f
    return f


@bind
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-01."""
    return ops.chunks(table(spark, sf_dir, "documents"))


@bind
def section_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-02, DX-03: each document as one page of its source; sections of no type stay, for the fixture's prose has few words of one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("page_number"), "text")).alias("pages"), "source")
    return sections.section_evidence(d, words=("the", "license"), company="source", keep_other=True)


@bind
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-16, SF-17: numbers and years of lines that have digits."""
    ls = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line")).where(F.col("line").rlike("[0-9]"))
    return ls.select("doc_id", F.col("line_no").cast("long").alias("line_no"), numbers.line_values("line").alias("values"), numbers.line_years("line").alias("years"))


@bind
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-21."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.sanitized("text").alias("text"))


@bind
def citation_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-11: every quote on every page that has it, matched in all tiers."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return ops.cite(b.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), d.select("doc_id", "text"))


@bind
def resolve_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-08: units of order values by quotes beside them."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = F.round("o_totalprice", 2)
    unit = F.element_at(F.array(*(F.lit(u) for u in ("RMB million", "亿元", "HKD million", "", "万元 or 亿元"))), (k % 5 + 1).cast("int"))
    quote = F.concat(F.lit("total of "), F.format_number(value, 2), F.lit(" "), unit)
    return o.select("o_orderkey", quote_units.resolve_column(value, F.lit("CNY"), F.lit(1e6), F.lit("RMB million"), quote).alias("u")).select("o_orderkey", "u.*")


@bind
def line_table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-08: figures of orders, laid out as a report's lines."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    text = F.concat_ws("\n", F.lit("Financial highlights"), F.lit("RMB million"), F.concat(year.cast("string"), F.lit("年")), F.concat((year - 1).cast("string"), F.lit("年")), F.lit("Revenue"), F.format_number("o_totalprice", 2), F.format_number(F.col("o_totalprice") / 2, 2), F.lit("Total assets"), F.format_number(F.col("o_totalprice") * 3, 0), F.lit("1"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("annual_report").alias("doc_type"), F.concat(F.lit("20"), F.substring(year.cast("string"), 3, 2)).alias("fiscal_period"), F.array(F.struct(F.lit(1).alias("page_number"), text.alias("text"))).alias("pages"))
    return lt.line_table_metrics(docs)


@bind
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-06: pages by the parser of each suffix; files without one are rows with an error."""
    p = table(spark, sf_dir, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, F.lit(".pdf")).otherwise(F.lit(".html")))
    return artifacts.page_sources(p.select(name.alias("path"), F.col("html").cast("binary").alias("content")))


@bind
def stated_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-30, SF-36 over sentences made from orders."""
    o = table(spark, sf_dir, "orders")
    sentence = F.concat(F.lit("The return on equity was "), F.format_number(F.col("o_totalprice") % 30, 2), F.lit("% and the profit attributable to shareholders "), F.format_number("o_totalprice", 2), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" excluding non-recurring items")).otherwise(F.lit("")))
    return o.select("o_orderkey", phrases.roe_column(sentence).alias("r"), phrases.profit_column(sentence).alias("p")).select("o_orderkey", F.col("r.value").alias("roe"), F.col("p.value").alias("profit"))
