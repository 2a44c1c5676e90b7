"""From headline records to facts: one fact for each metric that has a value, in the unit its quote tells, with a status and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefolio.functions import periods, quote_units, units
from tracefolio.functions.text import strip
from tracefolio.operators.facts import HEADLINE_METRICS, METRICS, fact_id
from tracefolio.sources.artifacts import FactTable


def text_of(name: str) -> Column:
    """A field's value as stripped text; empty without one."""
    return strip(F.coalesce(F.col(f"{name}.value").cast("string"), F.lit("")))


def complete(citations: Column) -> Column:
    """The first citation with a page and a quote."""
    return F.try_element_at(F.filter(citations, lambda c: c["page_number"].isNotNull() & (strip(F.coalesce(c["quote"], F.lit(""))) != "")), F.lit(1))


def convert(headlines: DataFrame) -> DataFrame:
    """Facts of records of schemas.HEADLINE. Return on equity is no fact; a metric whose value is no number gives no row."""
    period, unit = text_of("fiscal_period"), text_of("unit")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.lit(m).alias("metric_id"), F.lit(METRICS[m][0]).alias("label"), F.lit(METRICS[m][1]).alias("period_type"), F.col(f).alias("x")) for f, m in HEADLINE_METRICS.items())))
    rows = headlines.select("document_id", "source_path", F.nullif(text_of("company_name"), F.lit("")).alias("company_name"), period.alias("fiscal_period"), unit.alias("global_unit"), fields.alias("m"))
    rows = rows.select("*", "m.name", "m.metric_id", "m.label", "m.period_type", units.parse_number(F.col("m.x.value").cast("string")).alias("value"), F.col("m.x").alias("x")).where("value is not null")
    quote = strip(F.coalesce("x.evidence_quote", F.lit("")))
    own = F.col("x.evidence_page").isNotNull() & (quote != "")
    cited = complete(F.col("x.citations"))
    rows = rows.withColumns(
        {
            "evidence_page": F.when(own, F.col("x.evidence_page")).when(cited.isNotNull(), cited["page_number"]).otherwise(F.col("x.evidence_page")).cast("int"),
            "evidence_quote": F.when(own, quote).when(cited.isNotNull(), strip(cited["quote"])).otherwise(quote),
            "fiscal_year": periods.fiscal_year(F.col("fiscal_period")),
        }
    )
    g = F.col("global_unit")
    rows = rows.withColumn("u", quote_units.resolve_column(F.col("value"), units.currency(g), units.scale(g), g, F.col("evidence_quote")))
    clear = F.coalesce(F.col("u.currency"), F.lit("")) != ""
    clear = clear & F.col("u.scale").isNotNull()
    lacks = [("unit_currency_or_scale", ~clear), ("fiscal_period", F.col("fiscal_period") == ""), ("fiscal_year", F.col("fiscal_year").isNull()), ("evidence_page", F.col("evidence_page").isNull()), ("evidence_quote", F.col("evidence_quote") == "")]
    missing = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in lacks), F.when(F.col("u.status") == "needs_review", F.col("u.reason"))))
    rows = rows.withColumn("missing", missing)
    note = F.nullif(F.concat_ws("; ", F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", "))), F.col("u.note")), F.lit(""))
    null = F.lit(None).cast("string")
    return rows.select(
        fact_id(F.col("document_id"), F.col("metric_id"), F.col("fiscal_period"), F.col("period_type")).alias("fact_id"), "document_id", "company_name", null.alias("ticker"), "source_path", "metric_id", F.col("label").alias("metric_label"),
        F.col("name").alias("source_metric_name"), "period_type", "fiscal_period", "fiscal_year", "value", F.coalesce("u.unit_raw", F.lit("")).alias("unit_raw"), F.col("u.currency").alias("currency"), F.col("u.scale").alias("scale"),
        F.when(F.col("u.allowed"), F.col("value") * F.col("u.scale")).alias("normalized_value"), F.when(clear, F.col("u.currency")).alias("normalized_unit"), "evidence_page", "evidence_quote",
        F.when(F.size("missing") > 0, "needs_review").otherwise("verified").alias("review_status"), F.lit("headline_metrics").alias("source"), note.alias("notes"),
    )


def backfill(headlines: DataFrame, store: FactTable) -> None:
    """Convert and merge into the store, whose other buckets stay as they are; running it again changes nothing."""
    store.upsert(convert(headlines).withColumn("pos", F.lit(0)))
