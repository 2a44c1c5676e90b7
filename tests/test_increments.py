"""Snapshots of files read the difference only; statistics by deltas are those of a count from scratch."""

import os
import random

import pytest

from tracefolio.operators import retrieval
from tracefolio.operators.corpus_deltas import CorpusStatistics
from tracefolio.sources.snapshots import Snapshots


def test_a_scan_reads_the_difference(spark, tmp_path, monkeypatch):
    files, store = tmp_path / "raw", Snapshots(spark, f"file://{tmp_path}/snapshots")
    read = []
    hashed = Snapshots.hashed
    monkeypatch.setattr(Snapshots, "hashed", lambda self, paths: read.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or hashed(self, paths))
    told = lambda: sorted((r["path"].rsplit("/", 1)[1], r["change"]) for r in store.scan(f"file://{files}").collect())
    assert told() == [] and read == [[]]
    (files / "sub").mkdir(parents=True)
    for name in ("a.txt", "b {1}[x].pdf", "sub/c.html"):
        (files / name).write_bytes(name.encode() * 9)
    assert told() == [("a.txt", "new"), ("b {1}[x].pdf", "new"), ("c.html", "new")] and len(read[-1]) == 3
    assert told() == [] and read[-1] == []
    (files / "a.txt").write_bytes(b"other")
    os.remove(files / "sub/c.html")
    (files / "d.txt").write_bytes(b"d")
    os.utime(files / "b {1}[x].pdf", (1, 1))
    assert told() == [("a.txt", "changed"), ("b {1}[x].pdf", "touched"), ("c.html", "gone"), ("d.txt", "new")]
    assert read[-1] == ["a.txt", "b {1}[x].pdf", "d.txt"]
    assert store.read().count() == 3
    before = store.versions.current()
    with monkeypatch.context() as m:
        m.setattr(type(store.versions), "switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        (files / "e.txt").write_bytes(b"e")
        with pytest.raises(OSError, match="lost"):
            store.scan(f"file://{files}")
    assert store.versions.current() == before and told() == [("e.txt", "new")]


def test_statistics_after_replacements(spark, tmp_path):
    r = random.Random(6)
    text = lambda: r.choice([None, "", " ".join(r.choices(["Apple", "pie", "tart", "营业收入", "12.5%", "apple"], k=r.randrange(9)))])
    held = {k: (r.choice("ab"), k, text()) for k in range(60)}
    df = lambda rows: spark.createDataFrame(list(rows), "corpus string, doc_id long, text string")
    store = CorpusStatistics(spark, f"file://{tmp_path}/stats")
    assert store.corpora().count() == 0
    store.apply(added=df(held.values()))

    def same():
        plain = df(held.values())
        want = sorted((x["corpus"], x["n_docs"], round(x["avg_len"], 9)) for x in retrieval.corpus_stats(plain).collect())
        assert sorted((x["corpus"], x["n_docs"], round(x["avg_len"], 9)) for x in store.corpora().collect()) == want
        n = retrieval.term_frequencies(plain).groupBy("corpus", "term").count().collect()
        assert sorted((x["corpus"], x["term"], x["df"]) for x in store.frequencies().collect()) == sorted((x["corpus"], x["term"], x["count"]) for x in n)

    same()
    for _ in range(2):
        gone = r.sample(sorted(held), 15)
        new = {k: (r.choice("ab"), k, text()) for k in gone[:10] + [1000 + r.randrange(1000)]}
        store.apply(added=df(new.values()), removed=df([held.pop(k) for k in gone]))
        held |= new
        same()
    store.compact()
    assert len(store.runs()) == 1
    same()
