"""Conversations and events: session memory, run stages, answers, and the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefolio.functions import questions
from tracefolio.functions import text as T
from tracefolio.operators import chat, retrieval
from tracefolio.session import table
from tracefolio.streaming import memory, runs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def bind(sql: str):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@bind("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 4")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-09, ST-02: the last messages of each session."""
    return memory.recent(messages(spark, sf_dir), ["conv_id"], ["turn"], 4, tie=["role", "text"])


@bind("SELECT role, text, min(conv_id) AS conv_id FROM conversations GROUP BY role, text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-01: equal items once, the first stays."""
    return retrieval.dedupe_first(messages(spark, sf_dir), ["role", "text"], ["conv_id", "turn"]).select("role", "text", "conv_id")


@bind("SELECT conv_id, turn, CAST(k AS BIGINT) AS k, substr(t, CAST(k * 36 + 1 AS INTEGER), 36) AS delta FROM (SELECT conv_id, turn, t, unnest(range(0, (length(t) + 35) // 36)) AS k FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role = 'assistant'))")
def text_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-07, ST-01: answers in parts of 36 characters."""
    out = messages(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.deltas(F.col("text"))).alias("k", "delta"))
    return out.withColumn("k", F.col("k").cast("long"))


EVENTS = """WITH a AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, CASE WHEN length(t) < 40 THEN ['status', 'status', 'error'] ELSE list_concat(list_concat(['status', 'status'], list_transform(range(0, (length(t) + 35) // 36), lambda k: 'delta')), ['citation', 'done']) END AS kinds,
  CASE WHEN length(t) < 40 THEN ['routing', 'answering', 'answer too short'] ELSE list_concat(list_concat(['routing', 'answering'], list_transform(range(0, (length(t) + 35) // 36), lambda k: substr(t, CAST(k * 36 + 1 AS INTEGER), 36))), ['turn ' || (turn - 1), NULL]) END AS bodies FROM a)
SELECT conv_id, turn, CAST(unnest(range(0, len(kinds))) AS BIGINT) AS seq, unnest(kinds) AS kind, unnest(bodies) AS body FROM e"""


@bind(EVENTS)
def chat_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-01: the events of each answer's stream in order; an answer that is too short has failed."""
    a = messages(spark, sf_dir).where("role = 'assistant'")
    short = F.when(F.length(chat.stripped(F.col("text"))) < 40, "answer too short")
    cited = F.array(F.concat(F.lit("turn "), (F.col("turn") - 1).cast("string")))
    answers = a.select("conv_id", "turn", F.array(F.lit("routing"), F.lit("answering")).alias("stages"), T.deltas(F.col("text")).alias("parts"), cited.alias("citations"), short.alias("error"))
    return chat.event_rows(answers, ["conv_id", "turn"])


@bind("SELECT user_id, event_type AS stage, round(sum(s), 3) AS seconds FROM (SELECT user_id, event_type, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) AS s FROM events) WHERE s IS NOT NULL GROUP BY ALL")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-20, ST-03: time in each stage until the next one opens."""
    out = runs.stage_durations(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")
    return out.withColumn("seconds", F.round("seconds", 3))


@bind("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-04: of each key the value with the highest version."""
    return memory.latest(table(spark, sf_dir, "events"), "user_id", "event_id", ["value"]).withColumnRenamed("event_id", "version")


@bind("SELECT user_id, event_type, event_id FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def issue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-14: the last action on each item."""
    return memory.latest(table(spark, sf_dir, "events").where("event_type != 'view'"), "user_id", "event_id", ["event_type"])


@bind("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY user_id")
def telemetry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-19: what is no number counts as zero."""
    raw = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.floor("value").cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.coalesce(raw.try_cast("long"), F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("calls"))


HINTS = {"topic": ("stock", "thing"), "efficiency": ("turn", "ing"), "abnormal": ("odd", "high"), "cause": ("why", "because"), "change": ("rise", "tion"), "discussion": ("explain", "ther")}
_ANY = lambda kind: "(" + " OR ".join(f"contains(q, '{w}')" for w in HINTS[kind]) + ")"


@bind(
    f"SELECT conv_id, turn, CASE WHEN ({_ANY('topic')} OR {_ANY('efficiency')}) AND ({_ANY('abnormal')} OR {_ANY('cause')} OR ({_ANY('discussion')} AND ({_ANY('change')} OR {_ANY('efficiency')}))) THEN 'metric_attribution' END AS intent "
    "FROM (SELECT *, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') AS q FROM conversations WHERE role = 'user')"
)
def intent_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-19: with words of the fixture's language; the operator's own are Chinese."""
    return messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", chat.intent_hint(F.col("text"), HINTS).alias("intent"))


ROUTED = """WITH r AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'document_only' WHEN 1 THEN 'mixed' WHEN 2 THEN 'concept_only' ELSE 'unsupported' END AS route,
  CASE conv_id % 4 WHEN 0 THEN 'page_text_hybrid_no_table_primary' WHEN 1 THEN 'legacy_typed_table_row_primary' WHEN 2 THEN 'semantic' END AS found, length(text) % 2 = 0 AS ext FROM conversations) """


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as answers of a route, with the way their evidence was found and whether the external search gave a result."""
    pick = lambda c, n, *names: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col(c) % n + 1).cast("int"))
    return messages(spark, sf_dir).select(
        "conv_id", "turn", "text", pick("turn", 4, "document_only", "mixed", "concept_only", "unsupported").alias("route"), pick("conv_id", 4, chat.HYBRID, chat.LEGACY, "semantic", None).alias("found"), (F.length("text") % 2 == 0).alias("ext")
    )


@bind(
    ROUTED + """SELECT conv_id, turn, CASE WHEN route = 'unsupported' THEN 'unsupported' WHEN ext AND route = 'mixed' AND found LIKE 'page%' THEN 'mixed_page_text_hybrid_no_table_primary_external' WHEN ext AND route = 'mixed' AND found LIKE 'leg%' THEN 'mixed_legacy_typed_table_row_primary_external'
  WHEN ext AND route = 'mixed' AND found IS NOT NULL THEN 'mixed_document_external' WHEN ext AND route IN ('mixed', 'concept_only') THEN 'external_web_search' ELSE coalesce(found, 'semantic_with_filters') END AS mode FROM r"""
)
def retrieval_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-19: the name of how the evidence was found."""
    return routed(spark, sf_dir).select("conv_id", "turn", chat.retrieval_mode(F.col("route"), F.col("found"), F.col("ext")).alias("mode"))


@bind(
    ROUTED + """, s AS (SELECT *, contains(text, 'e') AS d, ext AS e, conv_id % 3 = 0 AS failed, contains(text, '?') AS a FROM r)
SELECT conv_id, turn, concat_ws('|', CASE WHEN e AND route IN ('mixed', 'concept_only') THEN 'external_evidence:' || CASE route WHEN 'mixed' THEN '概念与外部背景' ELSE '外部解释' END || ':1' END, CASE WHEN d THEN 'document_evidence:' || CASE route WHEN 'mixed' THEN '文档事实' ELSE '文档证据' END || ':1' END,
  CASE WHEN e AND route = 'document_only' THEN 'external_evidence:外部解释:1' END, CASE WHEN a OR failed THEN 'analysis_and_limits:' || CASE route WHEN 'mixed' THEN '综合分析与边界' ELSE '分析与边界' END || ':' || (CAST(a AS INTEGER) + CAST(failed AS INTEGER)) END) AS parts FROM s"""
)
def answer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-19: the parts of answers in the order of their route, with their titles and how many items they have."""
    items = lambda test: F.when(test, F.array("text")).otherwise(F.array().cast("array<string>"))
    parts = chat.answer_sections(F.col("route"), items(F.contains("text", F.lit("e"))), items(F.col("ext")), items(F.contains("text", F.lit("?"))), F.col("conv_id") % 3 == 0)
    shown = F.transform(parts, lambda p: F.concat_ws(":", p["section_type"], p["title"], F.size(p["items"]).cast("string")))
    return routed(spark, sf_dir).select("conv_id", "turn", F.array_join(shown, "|").alias("parts"))


@bind("SELECT conv_id, turn, CASE WHEN trim(alone) = '' THEN 'asked: ' || text ELSE regexp_replace(alone, '^\\s+|\\s+$', '', 'g') END AS question FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN '  ' ELSE ' ' || text || ' ' END AS alone FROM conversations WHERE role = 'user')")
def effective_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-38: the question made to stand alone, unless it is blank."""
    alone = F.when(F.col("turn") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
    return messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", chat.effective_question(F.concat(F.lit("asked: "), "text"), alone).alias("question"))


@bind(
    """SELECT conv_id, turn, CASE WHEN dq = '' THEN trim(text) ELSE trim(dq) END AS document_query, CASE WHEN k <> 'none' THEN k WHEN wide THEN 'concept_and_background' ELSE 'concept' END AS kind, n > 0 OR turn % 2 = 1 AS context
FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN '' ELSE 'about ' || conv_id END AS dq, CASE WHEN conv_id % 3 = 0 THEN 'concept' ELSE 'none' END AS k, conv_id % 2 = 0 AS wide, turn AS n FROM conversations WHERE role = 'user')"""
)
def plan_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-38: what a plan lacks comes from the question; whether there is context to read it in."""
    m = messages(spark, sf_dir).where("role = 'user'")
    k = F.col("conv_id")
    plan = m.withColumns(
        {
            "question": F.col("text"), "document_query": F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("about "), k.cast("string"))), "external_query": F.lit(None).cast("string"), "subquestions": F.array().cast("array<string>"),
            "external_search_kind": F.when(k % 3 == 0, "concept").otherwise("none"), "needs_external_background": k % 2 == 0, "needs_risk_reasoning": F.lit(False),
        }
    )
    recent = F.when(F.col("turn") > 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    return chat.plan_defaults(plan).select("conv_id", "turn", "document_query", F.col("external_search_kind").alias("kind"), chat.has_context(recent, F.when(F.col("turn") % 2 == 1, "so far").otherwise(" ")).alias("context"))


USED = """WITH c AS (SELECT DISTINCT conv_id FROM conversations), u AS (SELECT conv_id, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS pos, unnest(['document', 'document', 'document', 'document', 'external', 'external']) AS kind, unnest([conv_id % 50, -1, conv_id % 7, conv_id % 10 + 10, conv_id % 5, conv_id % 3]) AS ref FROM c),
d AS (SELECT doc_id AS ref, CASE WHEN doc_id % 3 > 0 THEN doc_id % 4 END AS page, CASE WHEN length(t) <= 260 THEN t ELSE regexp_replace(t[1:257], '\\s+$', '') || '...' END AS quote FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)),
r AS (SELECT conv_id, 0 AS part, pos, 'chat-citation-' || row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS citation_id, 'document' AS source_type, page, quote, NULL AS url FROM u JOIN d USING (ref) WHERE kind = 'document'
  UNION ALL SELECT conv_id, 1, pos, CAST(ref AS VARCHAR), 'external', NULL, NULL, CASE WHEN ref % 2 = 0 THEN 'https://one.example/' END FROM u JOIN benchmark ON item_id = ref WHERE kind = 'external') """


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that cite documents (one unknown, some twice) and external items, some of one address."""
    k = F.col("conv_id")
    ids = [("document", k % 50), ("document", F.lit(-1).cast("long")), ("document", k % 7), ("document", k % 10 + 10), ("external", k % 5), ("external", k % 3)]
    used = messages(spark, sf_dir).select("conv_id").distinct().select("conv_id", F.posexplode(F.array(*(F.struct(F.lit(kind).alias("kind"), ref.alias("ref")) for kind, ref in ids))).alias("pos", "u")).select("conv_id", F.col("pos").cast("long").alias("pos"), "u.*")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 4).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    e = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), F.when(F.col("item_id") % 2 == 0, "https://one.example/").alias("url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("quote"))
    return chat.resolve_citations(used, d, e, ["conv_id"])


@bind(USED + "SELECT conv_id, part, pos, citation_id, source_type, page AS page_number, md5(quote) AS digest, url FROM r")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09: what answers cite, in order; unknown references fall out, documents are numbered."""
    return resolved(spark, sf_dir).select("conv_id", "part", "pos", "citation_id", "source_type", "page_number", F.md5(F.col("quote").cast("binary")).alias("digest"), "url")


@bind(USED + "SELECT conv_id, part, pos, citation_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, CASE WHEN part = 0 THEN coalesce('p' || page, 'q' || quote) ELSE coalesce(url, 'i' || citation_id) END ORDER BY part, pos) AS n FROM r) WHERE n = 1")
def citation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-22: by page, or by the whole quote without one; external ones by their address, title or id; numbers given before keep their gaps."""
    return chat.dedupe_citations(resolved(spark, sf_dir), ["conv_id"]).select("conv_id", "part", "pos", "citation_id")


@bind(
    """WITH i AS (SELECT source, doc_id, arg_max(page, k) AS page, arg_max(quote, k) AS quote FROM (SELECT source, d.doc_id, d.doc_id % 10 AS page, 'issue ' || k AS quote, k, CASE WHEN k = 1 THEN 'facts' ELSE 'summary' END AS scope, CASE WHEN toxic = 1 THEN 'review' ELSE 'warning' END AS severity
  FROM documents d JOIN labels USING (doc_id), (SELECT unnest([0, 1, 2]) AS k)) WHERE scope = 'summary' AND severity = 'review' GROUP BY ALL)
SELECT d.source AS document_id, d.doc_id AS item_key, CASE WHEN quality = 1 THEN n_chars % 10 ELSE page END AS evidence_page, CASE WHEN quality = 1 THEN 'cited' ELSE quote END AS evidence_quote, CASE WHEN quality = 1 THEN 1.0::DOUBLE END AS confidence FROM documents d JOIN labels USING (doc_id) LEFT JOIN i ON i.source = d.source AND i.doc_id = d.doc_id"""
)
def draft_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-24: a point's place from its citation, else from its last issue that asks for review."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    key = [F.col("source").alias("document_id"), F.col("doc_id").alias("item_key")]
    good = F.col("quality") == 1
    points = j.select(*key, "text", good.alias("cited"), F.when(good, F.col("n_chars") % 10).alias("citation_page"), F.when(good, "cited").alias("citation_quote"))
    issues = j.select(*key, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("at"), (F.col("doc_id") % 10).alias("page"), F.when(F.col("toxic") == 1, "review").otherwise("warning").alias("severity"))
    issues = issues.withColumns({"quote": F.concat(F.lit("issue "), F.col("at").cast("string")), "scope": F.when(F.col("at") == 1, "facts").otherwise("summary")})
    return chat.reader_drafts(points, issues).drop("text")


@bind("SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN conv_id % 2 = 0 THEN 'doc 2' END, 'doc 1', CASE WHEN turn % 3 = 0 THEN 'doc 4' END], lambda x: x IS NOT NULL), ',') AS ids FROM conversations")
def context_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-17: references of answers to what they stand for; unknown ones and repeats fall out."""
    known = F.create_map(*(F.lit(x) for n in (1, 2, 3, 4) for x in (f"DOC_{n}", f"doc {n}")))
    refs = F.array(F.when(F.col("conv_id") % 2 == 0, "DOC_2").otherwise("DOC_9"), F.lit("DOC_1"), F.lit("DOC_1"), F.when(F.col("turn") % 3 == 0, "DOC_4").otherwise("WEB_1"))
    return messages(spark, sf_dir).select("conv_id", "turn", F.array_join(chat.resolved_refs(refs, known), ",").alias("ids"))


@bind("")
def kb_question_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-18: every user turn by the parser of ranking questions. DuckDB has no NFKC: tests/test_whole_jobs.py holds it to plain Python."""
    return messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", questions.parse(F.col("text")).alias("p")).select("conv_id", "turn", "p.*")


@bind("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: tumbling day windows over events; streaming.runs.daily has the watermarked twin."""
    return runs.daily(table(spark, sf_dir, "events"), None).withColumn("total", F.round("total", 2))
