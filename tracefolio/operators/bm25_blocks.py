"""BM25 of documents against a stated set of questions, block by block: no posting is moved.

``postings`` keeps of every document the asked terms and their counts, as two arrays; ``best`` weighs blocks of documents and multiplies them
with the questions, CHUNK of them at a time. A task holds its best documents of every corpus and question, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.functions.text import bm25_tokens
from tracefolio.session import small_batches

#: Documents of a block, questions that meet it at once, and candidates that a task holds before it keeps the best of them only.
BLOCK, CHUNK, HELD = 256, 256, 200_000
#: Sums of floating numbers may differ by their order.
SLACK = 1e-8
NO_ID = -(1 << 63)


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """corpus, doc_id, dl, ids (places in ``terms``), tfs of every (corpus, doc_id, text); NO_ID for a null doc_id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(terms, pa.string())
        for b in batches:
            tokens = b.column(2)
            n = np.asarray(tokens.value_lengths())
            at = pc.index_in(tokens.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)[at >= 0]
            pairs, tf = np.unique(row * len(terms) + at[at >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * len(terms)), pa.int32())
            ids, tfs = (pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (pairs % max(len(terms), 1), tf))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), ids, tfs], names=["corpus", "doc_id", "dl", "ids", "tfs"])

    cut = docs.where("corpus is not null").select("corpus", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return cut.mapInArrow(run, "corpus string, doc_id long, dl long, ids array<int>, tfs array<int>")


def stored(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The same of (corpus, doc_id, dl, terms), the terms counted: array<struct<term, tf>>."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(terms, pa.string())
        for b in batches:
            listed = b.column(3)
            n, (term, tf) = np.asarray(listed.value_lengths()), (listed.flatten().field(k) for k in (0, 1))
            at = pc.index_in(term, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)[at >= 0]
            ends = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            ids, tfs = (pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (at[at >= 0], tf.to_numpy()[at >= 0]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids, tfs], names=["corpus", "doc_id", "dl", "ids", "tfs"])

    kept = rows.select("corpus", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "dl", "terms")
    return small_batches(kept).mapInArrow(run, "corpus string, doc_id long, dl long, ids array<int>, tfs array<int>")


class Best:
    """The best ``top_k`` documents of each corpus and question among those that are added."""

    def __init__(self, groups: int, top_k: int):
        self.top_k, self.floor, self.n = top_k, np.zeros(groups), 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, group: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((group, doc, score))
        self.n += len(group)
        if self.n > HELD:
            self.keep()
            self.n = 0  # what is kept is bounded by the groups

    def keep(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        group, doc, score = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((doc, -np.floor(score * 1e9 + 0.5), group))
        group, doc, score = group[order], doc[order], score[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        full = place == self.top_k - 1
        self.floor[group[full]] = np.maximum(score[full] - SLACK, 0.0)
        kept = place < self.top_k
        self.parts = [(group[kept], doc[kept], score[kept])]
        return self.parts[0]


def best(rows: DataFrame, asked: list[tuple[int, int, int]], corpora: dict[str, float], idf: np.ndarray, *, top_k: int, k1: float, b: float) -> DataFrame:
    """corpus, query_id, doc_id, score: each task's best of ``postings``. ``asked``: (query_id, term's place, times); ``corpora``: average lengths; ``idf`` by corpus and term."""
    names = list(corpora)
    query_ids = sorted({a[0] for a in asked})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = {q: i for i, q in enumerate(query_ids)}
        chunks = []
        for first in range(0, len(query_ids), CHUNK):
            mine = [(t, number[q] - first, n) for q, t, n in asked if first <= number[q] < first + CHUNK]
            used = np.unique([t for t, _, _ in mine])
            place = np.full(idf.shape[1], -1)
            place[used] = np.arange(len(used))
            matrix = np.zeros((len(used), min(CHUNK, len(query_ids) - first)))
            for t, q, n in mine:
                matrix[place[t], q] = n
            chunks.append((first, place, matrix))
        lengths, found = np.array([corpora[c] for c in names]), Best(len(names) * len(query_ids), top_k)
        for batch in batches:
            codes = np.array(pa.compute.index_in(batch.column(0), value_set=pa.array(names, pa.string())))
            for at in range(0, batch.num_rows, BLOCK):
                part, corpus = batch.slice(at, BLOCK), codes[at : at + BLOCK]
                doc, dl = part.column(1).to_numpy(), part.column(2).to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.asarray(part.column(3).value_lengths()))
                term, tf = (part.column(k).flatten().to_numpy() for k in (3, 4))
                norm = k1 * (1.0 - b + b * dl / lengths[corpus])
                weight = idf[corpus[row], term] * tf * (k1 + 1.0) / (tf + norm[row])
                for first, place, matrix in chunks:
                    here = place[term] >= 0
                    seen, column = np.unique(place[term[here]], return_inverse=True)
                    dense = np.zeros((part.num_rows, len(seen)))
                    dense[row[here], column] = weight[here]
                    score = dense @ matrix[seen]
                    group = corpus[:, None] * len(query_ids) + np.arange(first, first + matrix.shape[1])
                    d, q = np.nonzero((score > 0) & (score >= found.floor[group]))
                    found.add(group[d, q], doc[d], score[d, q])
        group, doc, score = found.keep()
        out = [pa.array([names[g] for g in group // len(query_ids)], pa.string()), pa.array([query_ids[g] for g in group % len(query_ids)], pa.int64()), pa.array(doc, pa.int64()), pa.array(score)]
        yield pa.RecordBatch.from_arrays(out, names=["corpus", "query_id", "doc_id", "score"])

    found = rows.mapInArrow(run, "corpus string, query_id long, doc_id long, score double")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
