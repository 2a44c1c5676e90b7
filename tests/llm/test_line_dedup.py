"""Line dedup: filters against sets, stores against counts from scratch after insertions and deletions, SQL, runs that are broken off."""

import glob
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracefolio.llm import line_dedup
from tracefolio.llm import queries as llm_queries
from tracefolio.llm.line_dedup import CuckooFilter, Full, LineStore, Probe

WHITE = " \t\n\v\f\r"


def lowered(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def expected(held: list, asked: list, least: int) -> list:
    n = Counter(k for _, text in held for k in {lowered(x) for x in (text or "").split("\n")} if k)
    out = []
    for doc_id, text in asked:
        lines = (text or "").split("\n")
        kept = [x for x in lines if n[lowered(x)] < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def some(seed: int, n: int) -> list:
    r = random.Random(seed)
    lines = ["", " ", "Ä ligne", "ä ligne", "COMMON", "\tcommon\r", "x\x0b", "\x00", "a" * 5000, "中文"] + [f"line {k}" for k in range(60)]
    return [(k, None if r.random() < 0.05 else "\n".join(r.choice(lines) for _ in range(r.randrange(9)))) for k in range(n)]


def test_filter_takes_and_gives_back():
    r = np.random.default_rng(0)
    keys = r.integers(-(1 << 63), 1 << 63, 20_000, np.int64)
    f = CuckooFilter.sized(len(keys))
    f.update(keys[:0], keys)
    both = np.stack([np.zeros(len(keys), np.int64), keys], 1)
    assert Probe(1, [(0, f.image(), b"")]).hits(both).all()
    f.update(keys[:15_000], keys[:0])
    left = Probe(1, [(0, f.image(), b"")]).hits(both)
    assert left[15_000:].all() and left[:15_000].mean() < 0.001
    other = np.stack([np.zeros(100_000, np.int64), r.integers(-(1 << 63), 1 << 63, 100_000, np.int64)], 1)
    assert Probe(1, [(0, f.image(), b"")]).hits(other).mean() < 0.001
    f.update(keys[:0], keys[:15_000])
    assert Probe(1, [(0, f.image(), b"")]).hits(both).all()
    with pytest.raises(Full):
        CuckooFilter.sized(4).update(keys[:0], keys[:50])


def test_insertions_and_deletions_leave_what_a_new_store_would_have(spark):
    first, second, third = some(1, 150), some(2, 90), some(3, 60)
    store = LineStore(spark, min_docs=12, shards=5)
    store.apply(inserted=made(spark, first))
    assert got(store.clean(made(spark, first))) == expected(first, first, 12)
    store.apply(inserted=made(spark, second))
    assert got(store.clean(made(spark, first + second))) == expected(first + second, first + second, 12)
    store.apply(inserted=made(spark, third), deleted=made(spark, first))
    want = expected(second + third, second + third, 12)
    assert got(store.clean(made(spark, second + third))) == want
    assert got(store.clean(made(spark, second + third), filter_bytes=-1)) == want
    store.compact(shards=3)
    assert store.runs() == [store.versions.current()] and store.shards() == 3
    assert got(store.clean(made(spark, second + third))) == want
    store.apply(deleted=made(spark, third))
    store.apply(inserted=made(spark, first))
    store.apply(deleted=made(spark, second))
    assert got(store.clean(made(spark, first))) == expected(first, first, 12)


def test_an_increment_touches_its_shards_only(spark):
    store = LineStore(spark, min_docs=2, shards=64)
    store.apply(inserted=made(spark, [(k, f"line {k}\nline {k + 1}") for k in range(500)]))
    store.apply(inserted=made(spark, [(0, "line 0\nline 7000")]))
    assert spark.read.parquet(f"{store.versions.path()}/counts").count() == 2
    assert spark.read.parquet(f"{store.versions.path()}/filters").count() <= 2
    assert got(store.clean(made(spark, [(0, "line 0\nline 7000"), (1, "line 500\nline 3")]))) == [(0, 2, 1, "line 7000"), (1, 2, 1, "line 500")]


def test_what_is_broken_off_or_refused_leaves_the_store(spark, monkeypatch):
    rows = [(k, "same\nline %d" % k) for k in range(20)]
    store = LineStore(spark, min_docs=10, shards=4)
    store.apply(inserted=made(spark, rows))
    with pytest.raises(Exception, match="does not have"):
        store.apply(deleted=made(spark, [(99, "never seen")]))
    with monkeypatch.context() as m:
        m.setattr(type(store.versions), "switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.apply(deleted=made(spark, rows[:15]))
    assert got(LineStore(spark, store.folder, min_docs=10).clean(made(spark, rows))) == expected(rows, rows, 10)


def test_keys_that_the_filter_takes_wrongly_stay(spark):
    # 60,000 keys of one document against filters of 3,000: some share a fingerprint
    often = [(k, "\n".join(f"often {j}" for j in range(3000))) for k in range(3)]
    rare = [(10 + k, "\n".join(f"rare {k} {j}" for j in range(3000))) for k in range(20)]
    store = LineStore(spark, min_docs=3, shards=1)
    store.apply(inserted=made(spark, often + rare))
    assert sum(len(r["wrong"]) for r in store.filters().collect()) > 0
    assert all(r["n_dropped"] == (3000 if r["doc_id"] < 10 else 0) for r in store.clean(made(spark, often + rare)).collect())


def test_edges(spark):
    rows = [(1, "a"), (1, "a"), (None, "A "), (None, None), (2, ""), (3, "\n\n"), (4, "x\n" * 100_000), (5, "\ta\nb\n a")]
    wide = made(spark, rows).selectExpr("doc_id", "text", "'q' as n_lines", "1 as shard", "2L as hi", "null as row")
    for size in (1 << 20, -1):
        assert got(line_dedup.dedup_lines(wide, min_docs=4, filter_bytes=size)) == expected(rows, rows, 4)
        assert got(line_dedup.dedup_lines(wide.where("false"), filter_bytes=size)) == []


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = llm_queries.QUERIES["op12_line_dedup"](spark, sf)
    cursor = con.execute(llm_queries.ORACLES["op12_line_dedup"])
    names = [d[0] for d in cursor.description]
    assert names == df.columns and got(df) == sorted(cursor.fetchall(), key=str)
