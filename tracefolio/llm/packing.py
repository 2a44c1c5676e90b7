"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents, in doc_id order, are one stream of ids. A window covers at most ``size`` consecutive ids; f(j) is the least
cost of closing a window at cut j::

    f(j) = penalty(j) + min over cuts i with j - i <= size of  f(i) + size - (j - i)

Penalties count in tokens of padding: none at a document's end, SENTENCE at a sentence's, INSIDE elsewhere (such cuts
are offered every GRID ids of a long sentence). The minimum of f(i) + i over the cuts that still fit is kept in a
monotone queue, so every cut enters and leaves it once.

Texts are moved once, by a range exchange on doc_id and the text's hash (one doc_id, or rows without one, may hold any share of the table);
each task works on blocks of BLOCK ids and carries the ids after its last window on, so memory is bounded. What is left at the end of a task is less
than a window, and ends with a document. The tails of JOINED tasks after each other, BLOCK ids at most, are laid end to end and go through the same programme,
and so do the tails that this leaves, until one is left: it is the only window of the corpus that the programme did not close, whatever the
number of tasks. Windows are numbered in the order of the stream; those of tails stand behind the windows of the tasks that they come from.

Defined results: a null text is empty and gives the end id alone; a null doc_id sorts first; equal doc_ids are ordered by the text's hash,
then by text; equal rows each get a place of their own; an empty table gives no rows; other columns are ignored, whatever their
names; a document longer than a window is cut into pieces, however long it is.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.llm.common import doc_texts, fast_tokenizer, in_order, settle, small, small_batches, to_batch, tokenizer_path

SIZE = 2048
END_ID = 1
SENTENCE, INSIDE, GRID = 2.0, 8.0, 32
BLOCK = 1 << 19
#: Tails that are laid end to end in one task.
JOINED = BLOCK // SIZE
PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, tail boolean, ids binary"


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, size: int) -> tuple[list[int], float]:
    """Cuts of the cheapest chain of windows from 0 to some cut less than ``size`` before the last one, and its cost.

    ``cuts`` ascend, without 0; gaps are at most ``size``. Where the whole stream fits one window nothing is closed.
    """
    last = int(cuts[-1]) if len(cuts) else 0
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # f(i) + i, i, index
    back: list[int] = []
    best, at = (0.0, -1) if last < size else (float("inf"), -1)
    for j, (c, p) in enumerate(zip(cuts.tolist(), penalty.tolist())):
        while c - queue[0][1] > size:
            queue.popleft()
        key, _, i = queue[0]
        f = p + size - c + key
        back.append(i)
        if last - c < size and f <= best:
            best, at = f, j
        g = f + c
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, c, j))
    chain = []
    while at >= 0:
        chain.append(int(cuts[at]))
        at = back[at]
    return chain[::-1], best


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, and their penalties."""
    ends = np.flatnonzero(sentence_end[ids]) + 1
    hard = np.union1d(ends, doc_ends)
    starts = np.concatenate([[0], hard[:-1]])
    steps = np.maximum((hard - starts - 1) // grid, 0)
    inner = np.repeat(starts, steps) + grid * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1)
    cuts = np.concatenate([hard, inner])
    cost = np.concatenate([np.where(np.isin(hard, doc_ends), 0.0, SENTENCE), np.full(len(inner), INSIDE)])
    order = np.argsort(cuts, kind="stable")
    return cuts[order], cost[order]


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id: does its token end a sentence?"""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
    return out


class Packer:
    """Windows over a stream of documents, or of parts of them. ``add`` and ``close`` give pieces: doc_id, start, length, crc, doc_tokens, window, offset, tail, ids of a tail."""

    def __init__(self, ends: np.ndarray, size: int = SIZE, block: int = BLOCK):
        self.ends, self.size, self.block = ends, size, block
        self.held: list[np.ndarray] = []
        self.docs: list[list[int]] = []  # doc_id, start of what is held of it, held ids, all its ids
        self.n = self.window = 0

    def add(self, doc_id, ids: np.ndarray, start: int = 0) -> list[tuple]:
        """A document's ids from ``start`` to its end."""
        self.held.append(ids)
        self.docs.append([doc_id, start, len(ids), start + len(ids)])
        self.n += len(ids)
        return self.pack(False) if self.n >= self.block else []

    def close(self) -> list[tuple]:
        return self.pack(True) if self.n else []

    def pack(self, final: bool) -> list[tuple]:
        ids = np.concatenate(self.held)
        stops = np.cumsum([d[2] for d in self.docs])
        chain, _ = best_cuts(*cut_points(ids, stops, self.ends), self.size)
        edges = [0, *chain] + ([len(ids)] if final and (chain or [0])[-1] < len(ids) else [])
        out, raw, k, at = [], ids.astype("<u4").tobytes(), 0, 0
        for w, (a, b) in enumerate(zip(edges, edges[1:])):
            tail = final and w == len(chain)
            while at < b:
                doc_id, start, n, total = self.docs[k]
                stop = int(stops[k])
                to, first = min(b, stop), stop - n
                out.append((doc_id, start + at - first, to - at, zlib.crc32(raw[4 * at : 4 * to]), total, self.window, at - a, tail, raw[4 * at : 4 * to] if tail else None))
                k, at = k + (to == stop), to
            self.window += not tail
        rest = self.docs[k:]
        if rest and at < len(ids):
            gone = rest[0][2] - (int(stops[k]) - at)
            rest[0] = [rest[0][0], rest[0][1] + gone, rest[0][2] - gone, rest[0][3]]
        self.held, self.docs, self.n = ([ids[at:].copy()], rest, len(ids) - at) if at < len(ids) else ([], [], 0)
        return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, *, end_id: int = END_ID, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    arrow = to_arrow_schema(StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part = fast_tokenizer(path, True), TaskContext.get().partitionId()
        packer, end = Packer(sentence_ends(tok.whole), size, block), np.array([end_id], "<u2")
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tok.all_ids(b.column(1))):
                if rows := packer.add(doc_id, np.concatenate([ids, end])):
                    yield to_batch([(part, *r) for r in rows], arrow)
        if rows := packer.close():
            yield to_batch([(part, *r) for r in rows], arrow)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_order(doc_texts(docs), parts)
    levels = [settle(small_batches(ordered).mapInArrow(run, PIECES), "pieces")]
    parts = (levels[0].agg(F.max("part")).collect()[0][0] or 0) + 1
    while parts > 1:
        levels.append(settle(join_tails(levels[-1].where("tail"), path, size, block), "tails"))
        parts = -(-parts // JOINED)

    every = levels[0].where(F.lit(False)).withColumn("level", F.lit(0))
    for k, pieces in enumerate(levels):
        last = k == len(levels) - 1
        every = every.unionByName(pieces.where(F.lit(last) | ~F.col("tail")).withColumn("level", F.lit(k)))
    # one row a level and task: its windows, and those before it in the stream; a task of tails stands behind the last task that they come from
    windows = every.groupBy("level", "part").agg(F.max(F.col("window") + 1).alias("windows"))
    behind = (F.col("part") + 1) * F.pow(F.lit(JOINED), F.col("level")).cast("long")
    before = Window.orderBy(behind, "level").rowsBetween(Window.unboundedPreceding, -1)
    first = windows.select("level", "part", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("first"))
    placed = every.join(small(first, windows.count()), ["level", "part"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("window")).cast("long").alias("sequence_id"), "offset")


def join_tails(tails: DataFrame, tokenizer: str, size: int, block: int) -> DataFrame:
    """Tails of JOINED tasks each, through the programme: pieces as before, whose part is the number of the joined ones."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, at, packer = sentence_ends(fast_tokenizer(tokenizer, True).whole), None, None
        for b in batches:
            for part, doc_id, start, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                if part != at:
                    if packer and (rows := packer.close()):
                        yield to_batch([(at, *r) for r in rows], arrow)
                    at, packer = part, Packer(ends, size, block)
                if rows := packer.add(doc_id, np.frombuffer(raw, "<u4"), start):
                    yield to_batch([(part, *r) for r in rows], arrow)
        if packer and (rows := packer.close()):
            yield to_batch([(at, *r) for r in rows], arrow)

    joined = tails.withColumn("of", F.col("part")).withColumn("part", F.expr(f"cast(part div {JOINED} as int)"))
    return small_batches(joined.repartition("part").sortWithinPartitions("part", "of", "offset").select("part", "doc_id", "start", "ids")).mapInArrow(run, PIECES)
