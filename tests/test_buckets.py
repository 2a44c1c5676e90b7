"""Tables in buckets: what a change rewrites, and that a change that is broken off, at any step, leaves the table."""

import pytest
from pyspark.sql import functions as F

from tracefolio.sources.artifacts import Buckets, FactTable
from tracefolio.streaming import memory


def fact(spark, *rows):
    """(fact_id, document_id, value) to facts."""
    made = [(i, d, "c", None, "p", "revenue", "m", "revenue", "period", "2025", 2025, float(v), "RMB", "CNY", 1.0, float(v), "CNY", 1, "q", "verified", "s", None) for i, d, v in rows]
    return spark.createDataFrame(made, FactTable(spark, "x").schema).withColumn("pos", F.lit(0))


def held(table):
    return sorted((r["fact_id"], r["document_id"], r["value"]) for r in table.read().collect())


@pytest.fixture()
def table(spark, tmp_path):
    t = FactTable(spark, f"file://{tmp_path}/facts", buckets=8)
    t.write(fact(spark, *((f"{d}-{k}", f"d{d}", d * 10 + k) for d in range(20) for k in range(3))))
    return t


def test_one_document_rewrites_one_bucket(spark, table):
    before = table.manifest()
    table.replace_document("d7", fact(spark, ("7-0", "d7", 1), ("7-9", "d7", 2)))
    after = table.manifest()
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1
    assert [x for x in held(table) if x[1] == "d7"] == [("7-0", "d7", 1.0), ("7-9", "d7", 2.0)] and len(held(table)) == 59
    moved = next(k for k in before if before[k] != after[k])
    written = spark.read.parquet(f"{table.path()}/data")
    assert written.select("bucket").distinct().collect() == [(moved,)]
    table.replace_document("d7", fact(spark).limit(0))
    assert "d7" not in {x[1] for x in held(table)} and len(held(table)) == 57
    with pytest.raises(ValueError, match="facts of other documents: d8"):
        table.replace_document("d7", fact(spark, ("8-0", "d8", 1)))
    assert len(held(table)) == 57


def test_upserts_touch_their_documents(spark, table):
    before = table.manifest()
    table.upsert(fact(spark, ("3-1", "d3", 5), ("new", "d99", 6)))
    after = table.manifest()
    assert 1 <= sum(before[k] != after[k] for k in before) <= 2
    assert ("3-1", "d3", 5.0) in held(table) and ("new", "d99", 6.0) in held(table) and len(held(table)) == 61
    table.upsert(fact(spark).limit(0))
    assert len(held(table)) == 61


def test_a_bucket_that_loses_all_rows(spark, tmp_path):
    t = FactTable(spark, f"file://{tmp_path}/one", buckets=1)
    t.write(fact(spark, ("a", "d", 1)))
    t.replace_document("d", fact(spark).limit(0))
    assert held(t) == [] and t.current()
    t.upsert(fact(spark, ("b", "d", 2)))
    assert held(t) == [("b", "d", 2.0)]


@pytest.mark.parametrize("step", ["data", "list", "manifest", "switch"])
def test_broken_off_at_any_step(spark, table, monkeypatch, step):
    before = held(table)
    with monkeypatch.context() as m:
        if step == "data":
            new = fact(spark, ("1-0", "d1", 1)).withColumn("notes", F.raise_error(F.lit("lost")))
        else:
            new = fact(spark, ("1-0", "d1", 1))
        if step == "list":
            from tracefolio.sources import artifacts

            real = artifacts.filesystem
            m.setattr(artifacts, "filesystem", lambda s, p: (_ for _ in ()).throw(OSError("lost")) if p.endswith("/data") else real(s, p))
        if step == "manifest":
            m.setattr(FactTable, "new", lambda self: "v-taken")
            spark.range(1).write.mode("overwrite").parquet(f"{table.folder}/v-taken/manifest")
        if step == "switch":
            m.setattr(FactTable, "switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost|already exists"):
            table.upsert(new)
    assert held(table) == before
    table.upsert(fact(spark, ("1-0", "d1", 1)))
    assert ("1-0", "d1", 1.0) in held(table)
    table.vacuum()
    assert len(held(table)) == 60


def test_an_overtaken_change_is_refused(spark, table):
    other = FactTable(spark, table.folder, buckets=8)

    def slow(old, new):
        other.upsert(fact(spark, ("x", "d1", 1)))
        return table._checked(old)

    with pytest.raises(RuntimeError, match="changed meanwhile"):
        table.merge(fact(spark, ("y", "d2", 1)), slow)
    assert ("x", "d1", 1.0) in held(table)


def test_batches_of_a_stream_touch_their_keys(spark, tmp_path):
    path = f"file://{tmp_path}/latest"
    merge = memory.keep_latest(path, "k", "v", buckets=32)
    rows = lambda *r: spark.createDataFrame(r, "k long, v int, x string")
    merge(rows(*((k, 1, "a") for k in range(200))), 0)
    before = Buckets(spark, path, "k").manifest()
    merge(rows((5, 2, "b"), (6, 0, "stale")), 1)
    merge(rows((5, 2, "b"), (6, 0, "stale")), 1)
    after = Buckets(spark, path, "k").manifest()
    assert len(before) == 32 and 1 <= sum(before[k] != after[k] for k in before) <= 2
    got = {r["k"]: (r["v"], r["x"]) for r in memory.read_latest(spark, path).collect()}
    assert got == {k: (2, "b") if k == 5 else (1, "a") for k in range(200)}
