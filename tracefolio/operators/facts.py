"""The fact table: candidates, dedupe, comparability, top-k, upserts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.functions.periods import is_annual
from tracefolio.functions.text import strip

# The metrics of the fact store, their kind of period, and the names they go by.
METRICS = {
    "revenue": ("营业收入", "period", ("revenue", "revenues", "total revenue", "total revenues", "operating revenue", "营业收入", "營業收入", "收入")),
    "net_profit_attributable": (
        "归母净利润", "period",
        ("net profit", "net profit attributable", "profit attributable", "profit attributable to shareholders", "profit attributable to owners", "net profit attributable to parent",
         "归母净利润", "归属于母公司股东的净利润", "归属于上市公司股东的净利润", "归属于本行股东的净利润", "歸母淨利潤", "歸屬於母公司股東的淨利潤", "歸屬於上市公司股東的淨利潤", "歸屬於本行股東的淨利潤"),
    ),
    "total_assets": ("总资产", "end_of_period", ("total assets", "assets total", "总资产", "資產總額", "总资产额", "總資產")),
    "total_liabilities": ("总负债", "end_of_period", ("total liabilities", "liabilities total", "总负债", "負債總額", "总负债额", "總負債")),
}
HEADLINE_METRICS = {"revenue": "revenue", "net_profit": "net_profit_attributable", "total_assets": "total_assets", "total_liabilities": "total_liabilities"}


def alias_key(c: Column) -> Column:
    return F.regexp_replace(strip(F.replace(F.lower(c), F.lit("_"), F.lit(" "))), "(?U)\\s+", " ")


def canonical_metric(df: DataFrame, name: Column, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with metric_id: the metric that goes by ``name``, or null. The alias list is a constant and is broadcast."""
    known = aliases or {m: [m, *v[2]] for m, v in METRICS.items()}
    rows = sorted({(" ".join(a.strip().lower().replace("_", " ").split()), m) for m, names in known.items() for a in names})
    listed = df.sparkSession.createDataFrame(rows, "alias string, metric_id string")
    return df.withColumn("__key", alias_key(name)).join(F.broadcast(listed), F.col("__key") == F.col("alias"), "left").drop("__key", "alias")


def cited(page: str = "evidence_page", quote: str = "evidence_quote") -> Column:
    """Page and quote are there."""
    return F.col(page).isNotNull() & (F.length(strip(F.coalesce(F.col(quote), F.lit("")))) > 0)


def list_facts(facts: DataFrame, *, metric_id: str | None = None, fiscal_year: int | None = None, review_status: str | None = None) -> DataFrame:
    for name, value in (("metric_id", metric_id), ("fiscal_year", fiscal_year), ("review_status", review_status)):
        if value is not None:
            facts = facts.where(F.col(name) == value)
    return facts


def candidates(facts: DataFrame, *, metric_id: str, fiscal_year: int, documents: list[str] | DataFrame | None = None) -> DataFrame:
    """Verified facts with a value; of the documents only. None: all; an empty list: none."""
    out = list_facts(facts, metric_id=metric_id, fiscal_year=fiscal_year, review_status="verified").where("normalized_value is not null")
    return of_documents(out, documents)


def of_documents(facts: DataFrame, documents: list[str] | DataFrame | None) -> DataFrame:
    if documents is None:
        return facts
    if isinstance(documents, DataFrame):
        return facts.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return facts.where(F.col("document_id").isin(documents)) if documents else facts.limit(0)


def company_key(name: str = "company_name", document: str = "document_id") -> Column:
    """The company's name in lower case, or the document where it has none."""
    trimmed = F.lower(strip(F.coalesce(F.col(name), F.lit(""))))
    return F.when(trimmed != "", F.concat(F.lit("company:"), trimmed)).otherwise(F.concat(F.lit("document:"), F.col(document)))


#: Among equal values the first in the store's order.
STORE_ORDER = ("document_id", "metric_id", "fiscal_period")


def best_of_company(facts: DataFrame, *by: str) -> DataFrame:
    """One fact for each company (and each group of ``by``): the highest value. An aggregate, so it combines before the shuffle."""
    value = F.coalesce(F.col("normalized_value"), F.lit(0.0))
    order = F.struct((-value).alias("v"), *STORE_ORDER)
    keyed = facts.withColumn("__company", company_key())
    return keyed.groupBy(*by, "__company").agg(F.min_by(F.struct(*facts.columns), order).alias("f")).select("f.*")


def stages(facts: DataFrame) -> DataFrame:
    """Facts with the flags of the funnel: annual, cited."""
    return facts.withColumn("is_annual", is_annual(F.col("fiscal_period"))).withColumn("is_cited", F.col("is_annual") & cited() & F.col("normalized_value").isNotNull())


def unit_of(unit: str = "normalized_unit", currency: str = "currency") -> Column:
    first = F.when(F.coalesce(F.col(unit), F.lit("")) != "", F.col(unit)).otherwise(F.coalesce(F.col(currency), F.lit("")))
    return strip(first)


def comparability(deduped: DataFrame, *by: str) -> DataFrame:
    """One row (a group): unit if all facts share one, else the note why not."""
    u = unit_of()
    found = deduped.groupBy(*by).agg(F.count_if(u == "").alias("blank"), F.array_sort(F.collect_set(u)).alias("units"), F.count(F.lit(1)).alias("n"))
    clear = (F.col("blank") == 0) & (F.size("units") == 1)
    note = F.when(F.col("blank") > 0, F.lit("missing_normalized_unit_or_currency")).when(F.size("units") > 1, F.concat(F.lit("incomparable_normalized_units="), F.array_join("units", ",")))
    return found.select(*by, F.when(clear, F.element_at("units", 1)).alias("unit"), note.alias("note"), F.col("n").alias("companies"))


def funnel(facts: DataFrame, *, metric_id: str, fiscal_year: int, limit: int, documents: list[str] | None = None) -> DataFrame:
    """One row: the counters of a top-k question, its status and note."""
    base = stages(of_documents(list_facts(facts, metric_id=metric_id, fiscal_year=fiscal_year, review_status="verified"), documents))
    counts = base.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if("is_annual").alias("verified_annual_candidates"), F.count_if("is_cited").alias("after_citation_filter"))
    unit = comparability(best_of_company(base.where("is_cited")))
    one = counts.crossJoin(F.broadcast(unit))  # both are one row
    n = F.col("companies")
    ok = F.col("unit").isNotNull()
    returned = F.when(ok, F.least(n, F.lit(limit))).otherwise(F.lit(0))
    return one.select(
        F.lit(len(dict.fromkeys(documents)) if documents is not None else 0).cast("long").alias("selected_docs"),
        "candidate_count", "verified_annual_candidates", "after_citation_filter", n.alias("after_company_dedupe"),
        (F.col("candidate_count") - F.col("verified_annual_candidates")).alias("excluded_non_annual_count"),
        (F.col("after_citation_filter") - n).alias("excluded_duplicate_company_count"),
        returned.cast("long").alias("returned_rows"),
        F.when(n == 0, F.lit("partial")).when(~ok, F.lit("unsupported")).when(returned == limit, F.lit("success")).otherwise(F.lit("partial")).alias("status"),
        F.when(n == 0, F.lit("no_verified_annual_cited_facts")).when(~ok, F.col("note")).when(returned < limit, F.lit("coverage_below_requested_limit")).otherwise(F.lit("")).alias("note"),
    )


def top_facts(facts: DataFrame, *, metric_id: str, fiscal_year: int, limit: int = 3, documents: list[str] | None = None, check_units: bool = True) -> DataFrame:
    """The question's rows: highest first, none if units can't be compared."""
    base = stages(of_documents(list_facts(facts, metric_id=metric_id, fiscal_year=fiscal_year, review_status="verified"), documents))
    best = best_of_company(base.where("is_cited"))
    top = best.orderBy(F.desc("normalized_value"), *STORE_ORDER).limit(max(limit, 0))
    if check_units:
        clear = comparability(best).where("unit is not null").select("unit")
        top = top.crossJoin(F.broadcast(clear)).drop("unit")
    return top.drop("is_annual", "is_cited")


def top_per_metric(facts: DataFrame, *, fiscal_year: int, limit: int = 3) -> DataFrame:
    """The top rows of every metric, in one pass: rank within the metric, nothing for metrics whose units differ."""
    best = best_of_company(stages(list_facts(facts, fiscal_year=fiscal_year, review_status="verified")).where("is_cited"), "metric_id")
    clear = comparability(best, "metric_id").where("unit is not null").select("metric_id")
    rank = F.row_number().over(Window.partitionBy("metric_id").orderBy(F.desc("normalized_value"), *STORE_ORDER))
    return best.join(F.broadcast(clear), "metric_id").withColumn("rank", rank).where(F.col("rank") <= limit).drop("is_annual", "is_cited")


def upsert(old: DataFrame, new: DataFrame, key: str = "fact_id", order: str = "pos") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; of equal keys in ``new`` the last holds."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*(c for c in new.columns if c != key)), order).alias("f")).select(key, "f.*").drop(order)
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def replace_document(old: DataFrame, document_id: str, new: DataFrame, order: str = "pos") -> DataFrame:
    """``old`` with all rows of the document replaced. Rows of other documents in ``new`` are an error that names them."""
    alien = [r[0] for r in new.where(F.col("document_id") != document_id).select("document_id").distinct().orderBy("document_id").limit(20).collect()]
    if alien:
        raise ValueError(f"facts of other documents: {', '.join(alien)}")
    return upsert(old.where(F.col("document_id") != document_id), new, order=order)


def fact_id(document: Column, metric: Column, period: Column, period_type: Column) -> Column:
    digest = F.substring(F.sha1(F.concat_ws("|", document, metric, period, period_type)), 1, 16)
    return F.concat_ws(":", document, metric, digest)


def counts_by(df: DataFrame, column: str, none: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(none)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def ordered_counts(df: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Counts in a fixed order of values; others after them, by name."""
    place = F.array_position(F.array(*(F.lit(v) for v in order)), F.col(column))
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.when(place == 0, F.lit(len(order) + 1)).otherwise(place).cast("long"))


def status_grid(df: DataFrame, group: str, status: str, statuses: tuple[str, ...], groups: tuple[str, ...] | None = None) -> DataFrame:
    """Counts of each status as columns, zero where there are none."""
    base = df.where(F.col(group).isin(*groups)) if groups else df
    counted = base.groupBy(group).agg(*(F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses))
    if not groups:
        return counted
    every = df.sparkSession.createDataFrame([(g,) for g in groups], f"{group} string")
    return every.join(counted, group, "left").na.fill(0)
