"""Facts, from orders: a document for each order, a company for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefolio.functions import periods, units
from tracefolio.operators import cases, review
from tracefolio.operators import facts as ops
from tracefolio.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def bind(sql: str):
    """Register a query under its name, with the SQL it is held against."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


LABELS = {"1-URGENT": " annual report", "2-HIGH": " annual report", "3-MEDIUM": " q3 report", "5-LOW": ""}


def facts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("int")
    suffix = F.lit(" interim")
    for k, v in LABELS.items():
        suffix = F.when(F.col("o_orderpriority") == k, F.lit(v)).otherwise(suffix)
    period = F.concat(year.cast("string"), suffix)
    doc = key.cast("string")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(
        ops.fact_id(doc, F.lit("revenue"), period, F.lit("period")).alias("fact_id"), doc.alias("document_id"), F.col("c_name").alias("company_name"), F.lit("revenue").alias("metric_id"),
        F.lit("period").alias("period_type"), period.alias("fiscal_period"), year.alias("fiscal_year"),
        F.when(~((F.col("o_orderstatus") == "P") & (key % 7 == 0)), F.col("o_totalprice")).alias("normalized_value"), F.lit("CNY").alias("normalized_unit"), F.lit("CNY").alias("currency"),
        F.nullif(key % 50, F.lit(0)).cast("int").alias("evidence_page"), F.when(key % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("total "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("evidence_quote"),
        F.when(F.col("o_orderstatus").isin("F", "P"), F.lit("verified")).otherwise(F.lit("needs_review")).alias("review_status"), F.col("c_nationkey").alias("nation"),
    )


FACTS = """WITH facts AS (
  SELECT CAST(o_orderkey AS VARCHAR) || ':revenue:' || substr(sha1(CAST(o_orderkey AS VARCHAR) || '|revenue|' || p || '|period'), 1, 16) AS fact_id, CAST(o_orderkey AS VARCHAR) AS document_id, c_name AS company_name,
    'revenue' AS metric_id, p AS fiscal_period, y AS fiscal_year, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS normalized_value, 'CNY' AS normalized_unit,
    CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS INTEGER) END AS evidence_page, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'total ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS evidence_quote,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN 'verified' ELSE 'needs_review' END AS review_status, c_nationkey AS nation
  FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(year(o_orderdate) AS VARCHAR) || CASE o_orderpriority WHEN '1-URGENT' THEN ' annual report' WHEN '2-HIGH' THEN ' annual report' WHEN '3-MEDIUM' THEN ' q3 report' WHEN '5-LOW' THEN '' ELSE ' interim' END AS p FROM orders) o
  JOIN customer ON o_custkey = c_custkey),
staged AS (SELECT *, annual AND evidence_page IS NOT NULL AND trim(evidence_quote) <> '' AND normalized_value IS NOT NULL AS is_cited FROM (
  SELECT *, NOT regexp_matches(k, 'q1|q2|q3|quarter|interim|half-?year|(six|nine|three)months|1-3|1-6|1-9') AND (regexp_matches(k, 'annualreport|full-?year|yearended|fortheyear') OR regexp_full_match(k, '(19|20)[0-9]{2}')) AS annual
  FROM (SELECT *, replace(regexp_replace(lower(fiscal_period), '\\s+', '', 'g'), '_', '-') AS k FROM facts))),
best AS (SELECT * FROM staged WHERE review_status = 'verified' AND is_cited QUALIFY row_number() OVER (PARTITION BY metric_id, fiscal_year, lower(trim(company_name)) ORDER BY normalized_value DESC, document_id, metric_id, fiscal_period) = 1)
"""
TOP = "document_id, company_name, fiscal_period, normalized_value"
YEAR = 1997


@bind(FACTS + f"SELECT {TOP} FROM best WHERE fiscal_year = {YEAR} ORDER BY normalized_value DESC, document_id LIMIT 10")
def facts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-01: companies by revenue of the year."""
    return ops.top_facts(facts_view(spark, sf_dir), metric_id="revenue", fiscal_year=YEAR, limit=10).select(*TOP.split(", "))


@bind(
    FACTS
    + f"""SELECT CAST(0 AS BIGINT) AS selected_docs, a.*, d.n AS after_company_dedupe, a.candidate_count - a.verified_annual_candidates AS excluded_non_annual_count, a.after_citation_filter - d.n AS excluded_duplicate_company_count,
  least(d.n, 10) AS returned_rows, CASE WHEN d.n >= 10 THEN 'success' ELSE 'partial' END AS status, '' AS note
FROM (SELECT count(*) AS candidate_count, count(*) FILTER (annual) AS verified_annual_candidates, count(*) FILTER (is_cited) AS after_citation_filter FROM staged WHERE fiscal_year = {YEAR} AND review_status = 'verified') a,
  (SELECT count(*) AS n FROM best WHERE fiscal_year = {YEAR}) d"""
)
def facts_topk_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-06: how many facts each stage keeps."""
    return ops.funnel(facts_view(spark, sf_dir), metric_id="revenue", fiscal_year=YEAR, limit=10)


@bind(FACTS + f"SELECT {TOP} FROM facts WHERE false")
def facts_topk_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-01 over facts in several currencies: no rows come back."""
    mixed = facts_view(spark, sf_dir).withColumn("normalized_unit", F.when(F.col("nation") % 2 == 0, F.lit("CNY")).otherwise(F.lit("HKD")))
    return ops.top_facts(mixed, metric_id="revenue", fiscal_year=YEAR, limit=10).select(*TOP.split(", "))


@bind(FACTS + f"SELECT {TOP} FROM best WHERE fiscal_year = {YEAR} AND normalized_value IS NOT NULL ORDER BY normalized_value DESC, document_id LIMIT 25")
def store_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-02: the store's own top-k; units are not looked at."""
    return ops.top_facts(facts_view(spark, sf_dir), metric_id="revenue", fiscal_year=YEAR, limit=25, check_units=False).select(*TOP.split(", "))


@bind(FACTS + "SELECT fact_id, document_id, metric_id, fiscal_period, review_status FROM facts WHERE metric_id = 'revenue' AND fiscal_year = 1996 AND review_status = 'needs_review'")
def facts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-01, SF-10: a filtered list, with ids."""
    found = ops.list_facts(facts_view(spark, sf_dir), metric_id="revenue", fiscal_year=1996, review_status="needs_review")
    return found.select("fact_id", "document_id", "metric_id", "fiscal_period", "review_status")


@bind(FACTS + f"SELECT document_id, normalized_value FROM facts WHERE fiscal_year = {YEAR} AND review_status = 'verified' AND normalized_value IS NOT NULL AND document_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))")
def facts_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-02: candidates of some documents; a selection that is a table is a semi join, a list of ids an IN."""
    chosen = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select(F.col("o_orderkey").cast("string").alias("document_id"))
    return ops.candidates(facts_view(spark, sf_dir), metric_id="revenue", fiscal_year=YEAR, documents=chosen).select("document_id", "normalized_value")


@bind(FACTS + f"SELECT document_id, review_status FROM facts WHERE fiscal_year = {YEAR} AND nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def facts_selected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05: facts of a selection that is a table."""
    view = facts_view(spark, sf_dir)
    chosen = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"))
    picked = view.join(chosen, "nation", "left_semi").select("document_id")
    return ops.of_documents(view.where(F.col("fiscal_year") == YEAR), picked).select("document_id", "review_status")


@bind(FACTS + "SELECT document_id, fiscal_period, annual AS is_annual FROM staged")
def is_annual_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-03."""
    return facts_view(spark, sf_dir).select("document_id", "fiscal_period", periods.is_annual(F.col("fiscal_period")).alias("is_annual"))


@bind(FACTS + "SELECT fiscal_year, document_id, company_name, normalized_value FROM best")
def facts_company_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-02: each company's best fact of every year."""
    base = ops.stages(ops.list_facts(facts_view(spark, sf_dir), review_status="verified")).where("is_cited")
    return ops.best_of_company(base, "fiscal_year").select("fiscal_year", "document_id", "company_name", "normalized_value")


@bind(
    FACTS
    + "SELECT nation, CASE WHEN count(DISTINCT u) = 1 THEN min(u) END AS unit, CASE WHEN count(DISTINCT u) > 1 THEN 'incomparable_normalized_units=' || string_agg(DISTINCT u, ',' ORDER BY u) END AS note, count(*) AS companies FROM (SELECT nation, CASE WHEN nation % 3 = 0 AND fiscal_year % 2 = 0 THEN 'HKD' ELSE 'CNY' END AS u FROM best) GROUP BY nation"
)
def unit_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-03, by nation."""
    base = ops.best_of_company(ops.stages(ops.list_facts(facts_view(spark, sf_dir), review_status="verified")).where("is_cited"), "fiscal_year")
    mixed = base.withColumn("normalized_unit", F.when((F.col("nation") % 3 == 0) & (F.col("fiscal_year") % 2 == 0), F.lit("HKD")).otherwise(F.lit("CNY")))
    return ops.comparability(mixed, "nation").withColumn("companies", F.col("companies").cast("long"))


MEASURES = {"revenue": "l_extendedprice", "net_profit_attributable": "l_extendedprice * (1 - l_discount)", "total_assets": "l_quantity * 1000", "total_liabilities": "l_extendedprice * l_tax"}
MEASURE = "cast(sum(cast(floor(({}) * 100 + 0.000001) as bigint)) as double) / 100 AS {}"  # in cents: exact in any order of summing


def measures_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-09: four metrics of each order, one row each."""
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.expr(MEASURE.format(e, m)) for m, e in MEASURES.items()))
    return wide.unpivot(["l_orderkey"], list(MEASURES), "metric_id", "value").where("value is not null")


MEASURES_SQL = "SELECT l_orderkey, " + ", ".join(MEASURE.format(e, m) for m, e in MEASURES.items()) + " FROM lineitem GROUP BY l_orderkey"


@bind(f"SELECT l_orderkey, metric_id, value FROM ({MEASURES_SQL}) UNPIVOT (value FOR metric_id IN ({', '.join(MEASURES)}))")
def facts_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-09."""
    return measures_view(spark, sf_dir)


@bind(
    f"WITH m AS (SELECT * FROM ({MEASURES_SQL}) UNPIVOT (value FOR metric_id IN ({', '.join(MEASURES)}))), j AS (SELECT m.*, c_name, CAST(l_orderkey AS VARCHAR) AS d FROM m JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1996), "
    "b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY metric_id, c_name ORDER BY value DESC, d) = 1) SELECT metric_id, d AS document_id, c_name AS company_name, value AS normalized_value, row_number() OVER (PARTITION BY metric_id ORDER BY value DESC, d) AS rank FROM b QUALIFY rank <= 3"
)
def facts_top3_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-04: the three largest companies of every metric, one window for all."""
    o, c = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1996), table(spark, sf_dir, "customer")
    j = measures_view(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    facts = j.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.col("c_name").alias("company_name"), "metric_id", F.lit("1996 annual report").alias("fiscal_period"), F.lit(1996).alias("fiscal_year"),
        F.col("value").alias("normalized_value"), F.lit("CNY").alias("normalized_unit"), F.lit("CNY").alias("currency"), F.lit(1).alias("evidence_page"), F.lit("q").alias("evidence_quote"), F.lit("verified").alias("review_status"),
    )
    return ops.top_per_metric(facts, fiscal_year=1996).select("metric_id", "document_id", "company_name", "normalized_value", F.col("rank").cast("long").alias("rank"))


HALVES = "WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 < 6), b AS (SELECT o_orderkey, o_orderpriority AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 10 > 3) "


@bind(HALVES + "SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b")
def facts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-02: two overlapping halves of orders; the second wins."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 10 < 6").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 10 > 3").select("o_orderkey", F.col("o_orderpriority").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("pos"))
    stale = new.select("o_orderkey", F.lit("stale").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"), F.lit(0).alias("pos"))
    return ops.upsert(old, stale.unionByName(new), key="o_orderkey")


@bind("SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, CAST(o_custkey AS VARCHAR) AS document_id, CASE WHEN o_custkey = 7 THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders WHERE NOT (o_custkey = 7 AND o_orderkey % 2 = 0)")
def facts_replace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-03: one document's facts are replaced as a whole."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("fact_id"), F.col("o_custkey").cast("string").alias("document_id"), F.col("o_totalprice").alias("value"))
    new = old.where("document_id = '7' and cast(fact_id as long) % 2 = 1").withColumn("value", F.col("value") * 2).withColumn("pos", F.lit(0))
    return ops.replace_document(old, "7", new)


@bind("SELECT coalesce(o_orderstatus, 'unknown') AS o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-01."""
    return ops.counts_by(table(spark, sf_dir, "orders"), "o_orderstatus")


@bind("SELECT o_orderpriority, count(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS BIGINT) AS place FROM orders GROUP BY ALL")
def ordered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-02."""
    return ops.ordered_counts(table(spark, sf_dir, "orders"), "o_orderpriority", ("5-LOW", "3-MEDIUM"))


@bind("SELECT g AS l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'O') AS n_o FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(g) LEFT JOIN lineitem ON l_returnflag = g GROUP BY g")
def metric_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-04: a dense grid with zeros."""
    return ops.status_grid(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ("F", "O"), ("A", "N", "R", "X"))


@bind("SELECT l_returnflag, CAST(sum(f) AS BIGINT) AS n_f, CAST(sum(o) AS BIGINT) AS n_o FROM (SELECT l_orderkey, l_returnflag, count_if(l_linestatus = 'F') AS f, count_if(l_linestatus = 'O') AS o FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL) GROUP BY ALL")
def metric_status_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-05: sums of the documents' grids over the metrics allowed. Sums of sums are one aggregate here."""
    return ops.status_grid(table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")), "l_returnflag", "l_linestatus", ("F", "O"))


@bind("SELECT CAST(o_orderkey AS VARCHAR) AS document_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def db_scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-04: documents outside the selection."""
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(chosen, "o_custkey", "left_anti").select(F.col("o_orderkey").cast("string").alias("document_id"))


UNIT = "CASE n_nationkey % 8 WHEN 0 THEN 'RMB million' WHEN 1 THEN 'HK$ thousand' WHEN 2 THEN 'US$' WHEN 3 THEN '人民币百万元' WHEN 4 THEN '百万' WHEN 5 THEN '欧元' WHEN 6 THEN '  ' ELSE 'USD  Million' END"


@bind(
    f"""SELECT n_nationkey, u AS unit, CASE WHEN regexp_matches(k, 'hkd|hk\\$|港元') THEN 'HKD' WHEN regexp_matches(k, 'usd|us\\$|美元') THEN 'USD' WHEN regexp_matches(k, 'rmb|cny|人民币|元') THEN 'CNY' END AS currency,
  CASE WHEN regexp_matches(k, '百万元|million') THEN 1e6 WHEN k LIKE '%thousand%' THEN 1e3 WHEN regexp_matches(k, '亿') THEN 1e8 WHEN regexp_matches(k, '万') THEN 1e4 WHEN regexp_matches(k, '元|rmb|cny|hkd|usd') THEN 1.0 END::DOUBLE AS scale
FROM (SELECT n_nationkey, u, replace(lower(trim(u)), ' ', '') AS k FROM (SELECT n_nationkey, {UNIT} AS u FROM nation))"""
)
def normalize_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-06."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(UNIT).alias("unit"))
    return n.select("n_nationkey", "unit", units.currency(F.col("unit")).alias("currency"), units.scale(F.col("unit")).alias("scale"))


@bind("SELECT o_orderkey, CAST(replace(t, ',', '') AS DOUBLE) AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) END AS t FROM orders)")
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-05: grouped digits, and text that is no number."""
    grouped = F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("  "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", units.parse_number(grouped).alias("value"))


@bind(FACTS + "SELECT document_id, CAST(nullif(regexp_extract(fiscal_period || ' / 2001', '(20[0-9]{2}|19[0-9]{2})', 1), '') AS INTEGER) AS year FROM facts")
def fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-07: the leftmost year."""
    return facts_view(spark, sf_dir).select("document_id", periods.fiscal_year(F.concat("fiscal_period", F.lit(" / 2001"))).alias("year"))


@bind("SELECT p_partkey, CASE lower(trim(replace(p_type, '_', ' '))) WHEN 'standard' THEN 'revenue' WHEN 'promo' THEN 'total_assets' WHEN 'economy' THEN 'revenue' END AS metric_id FROM part")
def canonical_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-04: aliases to metrics."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return ops.canonical_metric(parts, F.col("p_type"), {"revenue": ["Standard", " economy"], "total_assets": ["PROMO"]}).select("p_partkey", "metric_id")


@bind("SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'q3_' || y || '_ytd' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'h1_' || y ELSE 'fy' || y END AS hint FROM (SELECT *, '20' || substr(CAST(year(o_orderdate) AS VARCHAR), 3) AS y FROM orders)")
def period_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-15."""
    o = table(spark, sf_dir, "orders")
    label = F.concat(F.lit("20"), F.substring(F.year("o_orderdate").cast("string"), 3, 2), F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("年三季度")).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("年半年度")).otherwise(F.lit("年")))
    return o.select("o_orderkey", periods.period_hint(label).alias("hint"))


@bind(
    """SELECT o_orderkey, CASE WHEN d = 'annual_report' THEN y || '年度报告' || s WHEN d = 'interim_report' THEN CASE o_orderkey % 3 WHEN 0 THEN y || '年第二季度报告' WHEN 1 THEN y || '年半年度报告' ELSE y || '年中期报告' END || s ELSE y || '业绩公告' END AS label
FROM (SELECT *, '20' || substr(CAST(year(o_orderdate) AS VARCHAR), 3) AS y, CASE WHEN o_orderkey % 2 = 0 THEN '（A股）' ELSE '（H股）' END AS s, CASE o_orderstatus WHEN 'F' THEN 'annual_report' WHEN 'O' THEN 'interim_report' ELSE 'earnings_release' END AS d FROM orders)"""
)
def period_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-29, SF-34. (Earnings releases take no market suffix here: the fixture leaves it out.)"""
    o = table(spark, sf_dir, "orders")
    period = F.concat(F.lit("20"), F.substring(F.year("o_orderdate").cast("string"), 3, 2), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" q2")).when(F.col("o_orderkey") % 3 == 1, F.lit(" h1")).otherwise(F.lit(" 中期")))
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("annual_report")).when(F.col("o_orderstatus") == "O", F.lit("interim_report")).otherwise(F.lit("earnings_release"))
    market = F.when(kind == "earnings_release", F.lit("us")).when(F.col("o_orderkey") % 2 == 0, F.lit("a_share")).otherwise(F.lit("h_share"))
    return o.select("o_orderkey", periods.period_label(period, kind, market).alias("label"))


@bind("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' WHEN o_orderkey % 2 = 0 THEN format('{:.2f}', round(o_totalprice * 1e4 / 1e8, 2)) || ' 亿元' ELSE format('{:,}', CAST(round(o_totalprice) AS BIGINT)) || ' HKD' END AS shown FROM orders")
def format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-20, SF-33: display of amounts."""
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 13 != 0, F.when(F.col("o_orderkey") % 2 == 0, units.rounded(F.col("o_totalprice") * 1e4 / 1e8, 2) * 1e8).otherwise(F.round("o_totalprice")))
    return o.select("o_orderkey", units.display_amount(value, F.when(F.col("o_orderkey") % 2 == 0, F.lit("CNY")).otherwise(F.lit("HKD"))).alias("shown"))


MERGED = """WITH j AS (SELECT o_orderkey AS document_id, o_orderstatus = 'F' AS f, o_orderkey % 5 AS k, round(o_totalprice, 2) AS t, round(o_totalprice * 2, 2) AS m FROM orders) """


@bind(MERGED + "SELECT document_id, CASE WHEN k < 4 AND k % 2 = 0 THEN '元' ELSE '万元' END AS unit, CASE WHEN k < 4 AND f THEN t ELSE m END AS revenue, CASE WHEN k < 4 AND k <> 1 THEN t ELSE m END AS total_assets, CASE WHEN k < 4 AND k = 2 THEN 12.5 WHEN k < 4 AND f THEN NULL ELSE 9.5 END::DOUBLE AS roe FROM j")
def coalesce_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-10: a table's figures before a model's; a table without a return on equity takes the model's away."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    t, m, f = units.rounded(F.col("o_totalprice"), 2), units.rounded(F.col("o_totalprice") * 2, 2), F.col("o_orderstatus") == "F"
    rest = lambda v: [v.alias("net_profit"), v.alias("total_liabilities")]
    model = o.select(k.alias("document_id"), F.lit("万元").alias("unit"), m.alias("revenue"), m.alias("total_assets"), *rest(m), F.lit(9.5).alias("roe"))
    tables = o.where(k % 5 < 4).select(k.alias("document_id"), F.when(k % 5 % 2 == 0, "元").otherwise("").alias("unit"), F.when(f, t).alias("revenue"), F.when(k % 5 != 1, t).alias("total_assets"), *rest(t), F.when(k % 5 == 2, 12.5).alias("roe"), f.alias("has_table_signal"))
    return review.merge_figures(model, tables).select("document_id", "unit", "revenue", "total_assets", "roe")


@bind("SELECT a.o_orderkey, a.o_orderstatus IS DISTINCT FROM b.s AS status_changed, a.o_totalprice IS DISTINCT FROM b.p AS price_changed, b.o_orderkey IS NULL AS gone FROM orders a LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 11 > 0) b USING (o_orderkey) WHERE b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.s OR a.o_totalprice IS DISTINCT FROM b.p")
def fact_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-15: what changed between two runs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 11 > 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("s"), (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("p"))
    j = o.join(new, F.col("o_orderkey") == F.col("k"), "full")
    out = j.select("o_orderkey", (~F.col("o_orderstatus").eqNullSafe(F.col("s"))).alias("status_changed"), (~F.col("o_totalprice").eqNullSafe(F.col("p"))).alias("price_changed"), F.col("k").isNull().alias("gone"))
    return out.where("status_changed or price_changed or gone")


@bind("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS two FROM orders")
def numeric_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-31: a spelling of each value that a quote may hold."""
    listed = units.spellings(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.filter(listed, lambda s: s.rlike(r"^-?[0-9]+\.[0-9]{2}$")), 1).alias("two"))


@bind(
    """SELECT o_orderkey, CASE kind WHEN 0 THEN '20f' WHEN 1 THEN 'earnings_release' WHEN 2 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'annual_summary' WHEN o_orderkey % 7 = 1 THEN 'annual_summary' WHEN year(o_orderdate) = 1998 THEN 'annual_report' ELSE 'annual_report_historical' END
  WHEN 3 THEN CASE WHEN o_orderkey % 7 IN (2, 3) THEN 'quarterly_report' ELSE 'interim_report' END END AS class FROM (SELECT *, o_orderkey % 5 AS kind FROM orders)"""
)
def filing_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-13: the class of a filing by its kind, its file's name and its year."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("form_20f", "earnings_release", "annual_report", "interim_report", "form_6k"))), (k % 5 + 1).cast("int"))
    name = F.element_at(F.array(*(F.lit(x) for x in ("report 摘要", "A Summary", "三季报告", "Q2 note", "a file", "other", "the report"))), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cases.filing_class(kind, name, F.year("o_orderdate"), 1998).alias("class"))


@bind(FACTS + f"""SELECT CAST(to_json({{'company': company_name, 'document': document_id, 'value': CAST(normalized_value AS DECIMAL(18,2))::VARCHAR}}) AS VARCHAR) AS line FROM best WHERE fiscal_year = {YEAR} ORDER BY normalized_value DESC, document_id LIMIT 10""")
def topk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-08: the question's rows as JSON lines."""
    top = ops.top_facts(facts_view(spark, sf_dir), metric_id="revenue", fiscal_year=YEAR, limit=10)
    return top.select(F.to_json(F.struct(F.col("company_name").alias("company"), F.col("document_id").alias("document"), F.col("normalized_value").cast("decimal(18,2)").cast("string").alias("value"))).alias("line"))


@bind(FACTS + f"SELECT string_agg('| ' || r || ' | ' || company_name || ' | ' || CAST(normalized_value AS DECIMAL(18,2))::VARCHAR || ' |', chr(10) ORDER BY r) AS md FROM (SELECT *, row_number() OVER (ORDER BY normalized_value DESC, document_id) AS r FROM best WHERE fiscal_year = {YEAR} QUALIFY r <= 5)")
def topk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-16: the answer's table; five rows, so one task may write it."""
    top = ops.top_facts(facts_view(spark, sf_dir), metric_id="revenue", fiscal_year=YEAR, limit=5)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("normalized_value"), "document_id")))
    line = F.concat(F.lit("| "), F.col("r").cast("string"), F.lit(" | "), "company_name", F.lit(" | "), F.col("normalized_value").cast("decimal(18,2)").cast("string"), F.lit(" |"))
    return ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x["t"]), "\n").alias("md"))


@bind(FACTS + "SELECT document_id, fact_id FROM facts")
def fact_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-10."""
    return facts_view(spark, sf_dir).select("document_id", "fact_id")


@bind("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN NULL WHEN o_totalprice >= 100000 THEN CAST(round(o_totalprice / 10000, 2) AS DECIMAL(18,2))::VARCHAR || ' 万元' ELSE CAST(round(o_totalprice, 2) AS DECIMAL(18,2))::VARCHAR || ' 元' END AS shown FROM orders")
def display_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-33: an amount in the unit that suits its size."""
    v = F.col("o_totalprice")
    two = lambda c: units.rounded(c, 2).cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(v < 1000, F.lit(None)).when(v >= 100000, F.concat(two(v / 10000), F.lit(" 万元"))).otherwise(F.concat(two(v), F.lit(" 元"))).alias("shown"))


@bind("SELECT o_orderkey, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 3000 ELSE year(o_orderdate) END AS INTEGER) AS y FROM orders)")
def chinese_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-17: years written in Chinese digits and read back."""
    y = F.when(F.col("o_orderkey") % 13 == 0, F.lit("3000")).otherwise(F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", units.chinese_year(F.translate(y, "0123456789", "〇一二三四五六七八九")).alias("year"))
