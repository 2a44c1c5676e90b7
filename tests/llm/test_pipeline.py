"""The pipeline against a version without Spark's operators: each stage's decisions are made again, one text after the other."""

import os
import sys
import zlib

import numpy as np

import corpus_pipeline as C
from tracefolio.llm import bag_minhash, packing, pii_tagger, quality_forest, toxicity_grammar
from tracefolio.llm.common import fast_tokenizer, tokenizer_path

sys.path.insert(0, os.path.dirname(__file__))
from test_dedup import shared  # noqa: E402


def test_run(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = C.run(spark, sf).collect()

    verdict = quality_forest.fit(*quality_forest.labelled_stats(docs, labels))
    keep = quality_forest._keeper(verdict)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r, k in zip(rows, keep([t for _, t in rows])) if k]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    g = toxicity_grammar.train(left, labels).grammar()
    rows = [r for r in rows if g.score(r[1]) < toxicity_grammar.LIMIT]

    # all pairs of texts: which are equal in words, or similar
    bags = [bag_minhash.shingles(t) for _, t in rows]
    nodes = np.array([n for _, _, n in bags])
    near = (shared([b[:2] for b in bags]) >= bag_minhash.THRESHOLD - 1e-6) | (nodes[:, None] == nodes[None])
    ids = np.array([d for d, _ in rows])
    least = ids.copy()
    while ((new := np.array([least[n].min() for n in near])) != least).any():
        least = new
    rows = [r for r, d in zip(rows, least) if r[0] == d]

    left = spark.createDataFrame(rows, "doc_id long, text string")
    tagger = pii_tagger.train_tagger(left)
    texts = [pii_tagger.mask(t, s) for (_, t), (_, s) in zip(rows, pii_tagger.all_spans(tagger, [t for _, t in rows]))]
    tok = fast_tokenizer(tokenizer_path("word_bpe_49k.json"), True)
    want = {d: np.append(tok.ids(t), packing.END_ID).astype("<u4") for (d, _), t in zip(rows, texts)}
    # every id of every document lies in one piece, and the pieces' sums are those of the ids
    seen = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids, at = want[r["doc_id"]], seen.get(r["doc_id"], 0)
        assert r["start"] == at and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
        seen[r["doc_id"]] = at + r["length"]
    assert seen == {d: len(x) for d, x in want.items()}
    # windows are filled from 0 without gaps and hold documents in order
    windows = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        mine = windows.setdefault(r["sequence_id"], [])
        assert r["offset"] == sum(x["length"] for x in mine) and (not mine or mine[-1]["doc_id"] < r["doc_id"])
        mine.append(r)
    assert sorted(windows) == list(range(len(windows))) and max(sum(x["length"] for x in w) for w in windows.values()) <= packing.SIZE
    assert sum(seen.values()) / (len(windows) * packing.SIZE) > 0.98


def folder(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


NAMES = "doc_id long, text string, lang string, source string, n_chars long, node string, d string, k string, row string, root string, start long, part string"


def test_empty_table(spark, tmp_path):
    out = C.run(spark, folder(spark, tmp_path / "none", [], NAMES))
    assert out.count() == 0 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)


def test_nulls_ties_and_clashing_names(spark, tmp_path):
    words = " ".join(f"word{k} of{k}" for k in range(60))
    other = " ".join(f"else{k} that{k}" for k in range(60))
    rest = ("en", "s", 1, "n", "d", "k", "r", "x", 5, "p")
    rows = [(1, words, *rest), (1, words, *rest), (2, words + " more", *rest), (None, other, *rest), (3, None, *rest), (4, "", *rest), (None,) * 12, (5, "short", *rest), (6, " ".join(f"long{k}" for k in range(40_000)), *rest)]
    got = C.run(spark, folder(spark, tmp_path / "some", rows, NAMES)).collect()
    # copies, and the near copy, become one; null, empty and short texts go; the text without an id and the long one stay
    assert {r["doc_id"] for r in got} == {1, None, 6}
    assert len([r for r in got if r["doc_id"] == 1 and r["start"] == 0]) == 1
    total = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert all(sum(r["length"] for r in got if r["doc_id"] == d) == n for d, n in total.items()) and total[6] > 40_000


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        before, docs = docs.count(), spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() <= before
