"""The thin queries of this subpackage's operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.llm import bag_minhash, bpe_prefix, line_dedup, mpeg_audio, packing, pii_tagger, quality_forest, secret_ledger, source_audit, token_align, token_planes, tool_calls, toxicity_grammar
from tracefolio.llm.common import table


def op1_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_planes(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_tagger.find_pii(docs, pii_tagger.train_tagger(docs))


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_grammar.score_documents(docs, toxicity_grammar.train(docs, table(spark, sf_dir, "labels")))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(secret_ledger.scan(table(spark, sf_dir, "documents")))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows", "class_texts", "n_shingles")


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tool_calls.messages_to_items(tool_calls.replies_as_calls(table(spark, sf_dir, "conversations")))
    linked = tool_calls.link(items, tool_calls.TOOLS)
    errors = F.array_join("errors", "; ").alias("errors")
    return linked.select("conv_id", "turn", "role", "kind", "call_id", "linked", "duplicate", errors, "anchor_turn", F.col("item").cast("long").alias("item"), F.col("step").cast("long").alias("step"), "json")


def op9_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.encode_decode(table(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_column(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_forest, op2_token_planes, op3_packing, op4_pii_tagger, op5_toxicity_grammar, op6_secret_ledger, op7_bag_minhash, op8_tool_calls, op9_bpe_prefix, op10_mpeg_audio, op11_source_audit, op12_line_dedup, op13_token_align, pipeline)
}

TOOL_CALLS_SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, coalesce(CAST(conv_id AS VARCHAR), 'null') AS c FROM conversations),
i AS (
  SELECT conv_id, turn, role, 'message' AS kind, NULL AS call_id, NULL AS name, -1 AS item, text, NULL AS args, '' AS errors FROM t WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, role, 'call', c || '-' || turn, 'reply', 0, NULL, '{"text":' || to_json(text) || ',"turn":' || turn || '}', '' FROM t WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, role, 'call', c || '-n-' || turn, 'note', 1, NULL,
    '{' || concat_ws(',', CASE WHEN n % 7 = 0 THEN '"other":1' END, CASE WHEN n % 5 <> 0 THEN '"size":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END END) || '}',
    concat_ws('; ', CASE WHEN n % 5 = 0 THEN 'missing size' WHEN n % 3 = 0 THEN 'size is not integer' END, CASE WHEN n % 7 = 0 THEN 'unknown argument' END) FROM t WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, role, 'call', c || '-s-' || (n % 4), 'note', 2, NULL, '{"size":' || n || '}', '' FROM t WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, role, 'result', CASE role WHEN 'assistant' THEN c || '-' || (turn - 1) ELSE c || '-n-' || turn END, NULL, NULL, text, NULL, '' FROM t WHERE role <> 'user'),
o AS (SELECT conv_id AS o_conv, call_id AS o_call, min(turn * 10 + item) AS owner FROM i WHERE kind = 'call' GROUP BY ALL),
r AS (SELECT conv_id AS r_conv, call_id AS r_call, count(*) AS answers FROM i WHERE kind = 'result' GROUP BY ALL)
SELECT conv_id, turn, role, kind, call_id,
  CASE kind WHEN 'call' THEN owner = turn * 10 + item AND answers IS NOT NULL WHEN 'result' THEN owner IS NOT NULL END AS linked,
  kind = 'call' AND owner <> turn * 10 + item AS duplicate, errors,
  CASE WHEN kind = 'result' AND owner IS NOT NULL THEN owner // 10 ELSE turn END AS anchor_turn,
  CAST(CASE WHEN kind <> 'result' THEN item WHEN owner IS NOT NULL THEN owner % 10 ELSE 2147483647 END AS BIGINT) AS item,
  CAST(CASE kind WHEN 'call' THEN 1 WHEN 'result' THEN CASE WHEN owner IS NOT NULL THEN 2 ELSE 3 END ELSE 0 END AS BIGINT) AS step,
  CASE kind
    WHEN 'call' THEN '{"arguments":' || args || ',"id":"' || call_id || '","name":"' || name || '","turn":' || turn || ',"type":"call"}'
    WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || call_id || '","turn":' || turn || ',"type":"result"}'
    ELSE '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || ',"type":"message"}' END AS json
FROM i LEFT JOIN o ON conv_id = o_conv AND call_id = o_call LEFT JOIN r ON conv_id = r_conv AND call_id = r_call
"""

ORACLES: dict[str, str] = {"op6_secret_ledger": secret_ledger.oracle(), "op8_tool_calls": TOOL_CALLS_SQL, "op11_source_audit": source_audit.ORACLE, "op12_line_dedup": line_dedup.ORACLE}
