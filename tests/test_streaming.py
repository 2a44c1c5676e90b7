"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tracefolio.streaming import memory, runs


def drain(spark, df, folder, mode="update", **sink):
    q = df.writeStream.outputMode(mode).format("memory").queryName(folder).option("checkpointLocation", sink["at"]).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(folder)


def test_session_memory(spark, tmp_path):
    rows = [(f"d{c % 2}", str(c), t, "user" if t % 2 == 0 else "assistant", f"text {t} of {c}") for c in range(3) for t in range(12 - c)]
    schema = "document_id string, session_id string, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = drain(spark, memory.remember(stream, 4), "memory_out", at=f"{tmp_path}/cp")
    last = {(r["document_id"], r["session_id"]): r for r in out.orderBy(F.size("messages"), F.expr("aggregate(messages, 0L, (a, m) -> a + m.turn)")).collect()}
    want = {}
    for r in memory.recent(df, ["document_id", "session_id"], ["turn"], 4).orderBy("turn").collect():
        want.setdefault((r["document_id"], r["session_id"]), []).append((r["turn"], r["role"], r["text"]))
    assert {k: [tuple(m) for m in r["messages"]] for k, r in last.items()} == want
    assert {k: r["version"] for k, r in last.items()} == {k: v[-1][0] for k, v in want.items()}


def test_stale_summaries_are_dropped(spark, tmp_path):
    schema = "document_id string, session_id string, turn long, role string, text string"
    batches = [[("d", "s", 0, "user", "a"), ("d", "s", 1, "assistant", "b")], [("d", "s", 1, "summary", "of two")], [("d", "s", 2, "user", "c")], [("d", "s", 1, "summary", "stale")], [("e", "s", 5, "user", "another document")]]
    seen = []
    for k, rows in enumerate([*batches, [("d", "s", 3, "assistant", "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sink = memory.remember(stream, 8).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(df.collect()))
        sink.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    rows = [r for batch in seen for r in batch]
    assert [r["summary"] for r in rows] == [None, "of two", "of two", "of two", None, "of two"]
    assert rows[-1]["version"] == 3 and [m["text"] for m in rows[-1]["messages"]] == ["a", "b", "c", "d"]


def test_versions_merge_once(spark, tmp_path):
    path = f"file://{tmp_path}/latest"
    merge = memory.keep_latest(path, "k", "v")
    schema = "k string, v int, x string"
    first, second = spark.createDataFrame([("a", 1, "old"), ("b", 5, "b5")], schema), spark.createDataFrame([("a", 2, "new"), ("b", 4, "stale")], schema)
    assert memory.read_latest(spark, path) is None
    for batch in (first, second, second, first):
        merge(batch, 0)
    now = lambda: sorted(tuple(r) for r in memory.read_latest(spark, path).select("k", "v", "x").collect())
    assert now() == [("a", 2, "new"), ("b", 5, "b5")]
    # a merge that is broken off before it ends leaves the table as it was
    broken = first.withColumn("x", F.when(F.col("k") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        merge(broken, 1)
    assert now() == [("a", 2, "new"), ("b", 5, "b5")]


def test_runs(spark, tmp_path):
    rows = [("r1", "queued", 0.0), ("r1", "read", 2.0), ("r1", "done", 5.0), ("r1", "read", 9.0), ("r2", "queued", 1.0), ("r2", "read", 4.0)]
    df = spark.createDataFrame(rows, "run string, stage string, at double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = drain(spark, runs.track(stream), "runs_out", at=f"{tmp_path}/cp")
    assert {(r["run"], r["stage"], r["total"], r["finished"]) for r in out.collect()} == {("r1", "done", 5.0, True), ("r2", "read", 3.0, False)}


def test_daily_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = drain(spark, runs.daily(stream, "1 day"), "daily_out", mode="complete", at=f"{tmp_path}/cp")
    key = lambda df: sorted((str(r["day"]), r["event_type"], r["n"], round(r["total"], 4)) for r in df.collect())
    assert key(out) == key(runs.daily(e, None))
