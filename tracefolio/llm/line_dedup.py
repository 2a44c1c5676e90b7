"""Line dedup that can be taken back: sharded cuckoo filters, backed by exact tables of reference counts.

A line's *key* is the line without white space at its ends, ASCII letters lowered. A ``LineStore`` keeps, in the shared folder,

* *reference counts*: (shard, key, n), n the number of documents that hold the key. Each ``apply`` adds a run of signed counts (documents
  inserted count up, documents deleted down) and leaves earlier runs as they are; the sum over the runs is exact;
* *filters*: of each shard a cuckoo filter (16-bit fingerprints, four to a bucket) of the keys that ``min_docs`` documents hold or more, and
  the few other keys of the shard that the filter takes for such (*wrong*). Keys whose count passes the limit upwards are inserted,
  those that pass it downwards deleted; a full filter is built again, twice as large, from the counts. Filter and wrong keys
  together are exact for every document of the store.

An ``apply`` reads and writes nothing but the shards in which its documents have keys, and holds from when the pointer is renamed: a
run that is broken off leaves the store as it was. Deleting documents gives earlier lines back; a count below zero (documents that the store never
had) fails the run. Keys stand by their 128-bit hash.

``clean`` drops the lines. Up to FILTER_BYTES, all filters go to every task and texts don't move; beyond that the lines' keys go to the counts,
and texts meet the keys that they lose. Lines count within a task before they move, so a line that every document has costs a row a task.

Defined results: null and empty texts are one empty line; keys without characters are neither counted nor dropped; rows are documents, be their
doc_id repeated or null, and equal rows count each; a very long text is split whole; a text that loses all lines is empty; empty tables give no
rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.llm.common import doc_texts, forget, settle, shared_dir, small_batches
from tracefolio.sources.artifacts import Versions

#: Keys found in so many documents lose their lines.
MIN_DOCS = 10
#: Lines a shard, as far as shards are chosen by the table's size, and the fewest shards.
SHARD_LINES, SHARDS = 1 << 20, 256
#: All filters up to so many bytes are sent to every task.
FILTER_BYTES = 64 << 20
#: Distinct keys that a task counts before it gives them out.
TASK_KEYS = 200_000
SLOTS, KICKS, MOST_LOAD = 4, 500, 0.9
WHITE = " \t\n\x0b\x0c\r"


class Full(Exception):
    """A key found no place."""


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each key has two buckets, either of which gives the other."""

    def __init__(self, image: bytes):
        self.table = np.frombuffer(image, "<u2").copy()
        self.mask = len(self.table) // SLOTS - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * MOST_LOAD < keys:
            buckets *= 2
        return cls(bytes(2 * SLOTS * buckets))

    def image(self) -> bytes:
        return self.table.tobytes()

    def update(self, gone: np.ndarray, come: np.ndarray) -> None:
        """Delete keys that are in the filter, then insert keys that are not (their low halves). Raises Full, after which the filter is of no use."""
        slots, mask = array("H", self.table.tobytes()), self.mask
        for f, at in zip(*(x.tolist() for x in places(gone)), strict=True):
            for b in (at & mask, (at ^ other(f)) & mask):
                if (k := next((k for k in range(b * SLOTS, b * SLOTS + SLOTS) if slots[k] == f), None)) is not None:
                    slots[k] = 0
                    break
        turn = 0
        for f, at in zip(*(x.tolist() for x in places(come)), strict=True):
            b = at & mask
            for kick in range(KICKS):
                free = next((k for c in (b, (b ^ other(f)) & mask) for k in range(c * SLOTS, c * SLOTS + SLOTS) if not slots[k]), None)
                if free is not None:
                    slots[free] = f
                    break
                # both are full: the fingerprint takes another's place, which goes on to its own other bucket
                turn += 1
                k = b * SLOTS + turn % SLOTS
                f, slots[k] = slots[k], f
                b = (b ^ other(f)) & mask
            else:
                raise Full
        self.table = np.frombuffer(slots.tobytes(), "<u2").copy()


def places(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (not zero) and first bucket, before the mask, of keys by their low halves."""
    low = low.view(np.uint64)
    return np.maximum(low & np.uint64(0xFFFF), np.uint64(1)).astype(np.int64), (low >> np.uint64(16)).astype(np.int64) & 0x7FFFFFFF


def other(fingerprint):
    """What the two buckets of a fingerprint differ by."""
    return (fingerprint * 0x5BD1E995) & 0x7FFFFFFF


class Probe:
    """The filters of all shards as one array."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes, bytes]]):
        self.shards, at = shards, 0
        self.first, self.mask, tables, self.wrong = np.zeros(shards, np.int64), np.zeros(shards, np.int64), [], set()
        for shard, image, wrong in [(-1, bytes(2 * SLOTS), b""), *rows]:  # shards without keys read the empty bucket at the front
            table = np.frombuffer(image, "<u2")
            if shard >= 0:
                self.first[shard], self.mask[shard] = at, len(table) // SLOTS - 1
            tables.append(table)
            at += len(table)
            self.wrong.update(wrong[k : k + 16] for k in range(0, len(wrong), 16))
        self.table = np.concatenate(tables)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (rows of high and low half) have a fingerprint in their shard's filter."""
        f, at = places(np.ascontiguousarray(keys[:, 1]))
        shard = np.mod(keys[:, 0], self.shards)
        first, mask = self.first[shard], self.mask[shard]
        found = np.zeros(len(keys), bool)
        for b in (at & mask, (at ^ other(f)) & mask):
            for k in range(SLOTS):
                found |= self.table[first + b * SLOTS + k] == f
        return found

    def dropped(self, keys: np.ndarray) -> np.ndarray:
        found = self.hits(keys)
        if self.wrong:
            at = np.flatnonzero(found)
            raw = keys[at].tobytes()
            found[at[[raw[k : k + 16] in self.wrong for k in range(0, len(raw), 16)]]] = False
        return found


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes], np.ndarray]:
    """The lines of texts, where each text's begin and end, the keys' hashes, and which keys have characters."""
    from xxhash import xxh3_128_digest

    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=WHITE))
    offsets = lists.offsets.to_numpy()
    return lines, offsets - offsets[0], list(map(xxh3_128_digest, keys.cast(pa.binary()).to_pylist())), pc.binary_length(keys).to_numpy() > 0


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def line_counts(docs: DataFrame, sign: int = 1) -> DataFrame:
    """(hi, lo, n): in how many of a task's documents each key is, times ``sign``."""
    empty = b""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = halves(list(held))
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.fromiter(held.values(), np.int64, len(held)) * sign)], names=["hi", "lo", "n"])

        for b in batches:
            _, offsets, digests, real = cut(b.column(0))
            digests = [d if r else empty for d, r in zip(digests, real.tolist())]
            for x, y in zip(offsets.tolist(), offsets[1:].tolist()):
                held.update(set(digests[x:y]))
            held.pop(empty, None)
            if len(held) >= TASK_KEYS:
                yield out()
                held = Counter()
        if held:
            yield out()

    return small_batches(doc_texts(docs).select("text")).mapInArrow(count, "hi long, lo long, n long")


def n_lines(docs: DataFrame) -> int:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.sum(F.length(text) - F.length(F.translate(text, "\n", "")) + 1), F.lit(0)).alias("n")).collect()[0]["n"]


def renewed(min_docs: int):
    """A shard's counts before and after a run, and its filter, to its new filter."""

    def renew(counts: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"shard": pd.Series(dtype="int32"), "n_keys": pd.Series(dtype="int64"), "image": pd.Series(dtype=object), "wrong": pd.Series(dtype=object)})
        if not len(counts):
            return none
        if (counts["after"] < 0).any():
            raise ValueError("lines of documents are deleted that the store does not have")
        hi, lo, before, after = (counts[c].to_numpy() for c in ("hi", "lo", "before", "after"))
        was, now = before >= min_docs, after >= min_docs
        n, size = int(now.sum()), int(now.sum())
        try:
            f = CuckooFilter(old["image"].iloc[0]) if len(old) else CuckooFilter.sized(n)
            if n > MOST_LOAD * len(f.table):
                raise Full
            f.update(lo[was & ~now], lo[now & ~was])
        except Full:
            while True:
                f, size = CuckooFilter.sized(max(size, n)), max(2 * size, 8)
                try:
                    f.update(lo[:0], lo[now])
                    break
                except Full:
                    continue
        rest = np.flatnonzero(~now & (after > 0))
        keys = np.stack([hi[rest], lo[rest]], axis=1)
        wrong = keys[Probe(1, [(0, f.image(), b"")]).hits(np.stack([np.zeros(len(rest), np.int64), lo[rest]], axis=1))] if len(rest) else keys
        return pd.DataFrame({"shard": [counts["shard"].iloc[0]], "n_keys": [n], "image": [f.image()], "wrong": [np.ascontiguousarray(wrong).tobytes()]})

    return renew


class LineStore:
    """Reference counts and filters of the lines of a set of documents (see the module's text)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, min_docs: int = MIN_DOCS, shards: int | None = None):
        self.spark, self.min_docs, self._shards = spark, min_docs, shards
        self.folder = folder or f"{shared_dir(spark)}/tracefolio/lines-{uuid.uuid4().hex}"
        self.versions = Versions(spark, self.folder)

    def runs(self) -> list[str]:
        """The versions whose counts add up to the store, oldest first."""
        path = self.versions.path()
        return [r["version"] for r in self.spark.read.parquet(f"{path}/runs").orderBy("seq").collect()] if path else []

    def shards(self) -> int | None:
        path = self.versions.path()
        return self.spark.read.parquet(f"{path}/runs").collect()[0]["shards"] if path else self._shards

    def _read(self, runs: list[str], what: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{v}/{what}").withColumn("seq", F.lit(k)) for k, v in enumerate(runs)]
        if not parts:
            return self.spark.createDataFrame([], schema + ", seq int")
        while len(parts) > 1:
            parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        return parts[0]

    def counts(self, runs: list[str] | None = None) -> DataFrame:
        """(hi, lo, n, shard, seq) of every run."""
        return self._read(self.runs() if runs is None else runs, "counts", "hi long, lo long, n long, shard int")

    def filters(self) -> DataFrame:
        """(shard, n_keys, image, wrong): the last filter of every shard."""
        rows = self._read(self.runs(), "filters", "shard int, n_keys long, image binary, wrong binary")
        newest = F.max_by(F.struct("n_keys", "image", "wrong"), "seq").alias("f")
        return rows.groupBy("shard").agg(newest).select("shard", "f.*")

    def apply(self, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Take documents in and out, in one step."""
        given = [(d, s) for d, s in ((inserted, 1), (deleted, -1)) if d is not None]
        shards = self.shards() or max(SHARDS, -(-sum(n_lines(d) for d, _ in given) // SHARD_LINES))
        delta = None
        for d, sign in given:
            part = line_counts(d, sign)
            delta = part if delta is None else delta.unionByName(part)
        shard = F.pmod("hi", F.lit(shards)).cast("int").alias("shard")
        # dealt by shard once: the sums, and the files, need no other exchange
        dealt = delta.select(shard, "hi", "lo", "n").repartition(F.col("shard"))
        summed = dealt.groupBy("shard", "hi", "lo").agg(F.sum("n").alias("n")).where("n <> 0")
        self._commit(summed, self.runs(), shards)

    def compact(self, shards: int | None = None) -> None:
        """All runs to one, in as many shards as its keys ask for; keys that no document has any more go."""
        total = settle(self.counts().groupBy("hi", "lo").agg(F.sum("n").alias("n")).where("n > 0"), "line-counts")
        shards = shards or max(SHARDS, -(-total.count() // SHARD_LINES))
        self._commit(total.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).repartition(F.col("shard")), [], shards)
        forget(total)

    def _commit(self, counts: DataFrame, runs: list[str], shards: int) -> None:
        version = self.versions.new()
        at = f"{self.folder}/{version}"
        counts.select("hi", "lo", "n", "shard").write.partitionBy("shard").parquet(f"{at}/counts")
        every = self.counts([*runs, version])
        old = self.filters() if runs else self.spark.createDataFrame([], "shard int, n_keys long, image binary, wrong binary")
        if runs:
            touched = [r["shard"] for r in every.where(F.col("seq") == len(runs)).select("shard").distinct().collect()]  # as many as there are shards, at most
            every, old = every.where(F.col("shard").isin(touched)), old.where(F.col("shard").isin(touched))
        sums = F.sum(F.when(F.col("seq") < len(runs), F.col("n")).otherwise(0)).alias("before"), F.sum("n").alias("after")
        both = every.repartition(F.col("shard")).groupBy("shard", "hi", "lo").agg(*sums)
        new = both.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(renewed(self.min_docs), "shard int, n_keys long, image binary, wrong binary")
        new.write.parquet(f"{at}/filters")
        self.spark.createDataFrame([(v, k, shards) for k, v in enumerate([*runs, version])], "version string, seq int, shards int").coalesce(1).write.parquet(f"{at}/runs")
        self.versions.switch(version)

    def clean(self, docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, n_lines, n_dropped, and the text that is left, of documents that the store holds."""
        filters = self.filters()
        size = filters.agg(F.coalesce(F.sum(F.length("image") + F.length("wrong")), F.lit(0)).alias("n")).collect()[0]["n"]
        if size > filter_bytes:
            return self._clean_by_counts(docs)
        rows = [(r["shard"], bytes(r["image"]), bytes(r["wrong"])) for r in filters.select("shard", "image", "wrong").collect()]
        sent = self.spark.sparkContext.broadcast((self.shards() or 1, rows))

        def start():
            probe = Probe(*sent.value)
            return lambda digests, _: probe.dropped(halves(digests)) if digests else np.zeros(0, bool)

        return dropping(doc_texts(docs), start)

    def _clean_by_counts(self, docs: DataFrame) -> DataFrame:
        """As ``clean``, by exchanges alone: keys of lines meet the keys to drop, and texts what they lose."""
        placed = settle(doc_texts(docs).withColumn("row", F.monotonically_increasing_id()), "line-texts")
        often = self.counts().groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select("hi", "lo")

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, offsets, digests, real = cut(b.column(1))
                row = np.repeat(b.column(0).to_numpy(), np.diff(offsets))
                hashes = halves(digests)
                yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (row, hashes[:, 0], hashes[:, 1])], names=["row", "hi", "lo"])

        lost = small_batches(placed.select("row", "text")).mapInArrow(keys, "row long, hi long, lo long").join(often, ["hi", "lo"], "left_semi")
        drops = lost.groupBy("row").agg(F.collect_set(F.struct("hi", "lo")).alias("drops")).select(F.col("row").alias("of"), "drops")
        met = placed.join(drops, placed["row"] == drops["of"], "left").select("doc_id", "text", "drops")

        def start():
            def dropped(digests: list[bytes], b: pa.RecordBatch) -> np.ndarray:
                out = []
                at = pc.list_value_length(pc.split_pattern(b.column(1), "\n")).to_pylist()
                k = 0
                for n, drops in zip(at, b.column(2).to_pylist()):
                    bad = {np.array([d["hi"], d["lo"]], "<i8").tobytes() for d in drops or []}
                    out += [x in bad for x in digests[k : k + n]]
                    k += n
                return np.array(out, bool)

            return dropped

        return dropping(met, start)


def dropping(docs: DataFrame, start) -> DataFrame:
    """(doc_id, text, ...) to doc_id, n_lines, n_dropped, text; ``start()`` gives a function from a batch's hashes to the lines that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = start()
        for b in batches:
            lines, offsets, digests, real = cut(b.column(1))
            gone = which(digests, b) & real
            before = np.concatenate([[0], np.cumsum(~gone)])
            kept = pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), lines.filter(pa.array(~gone)))
            n = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(n - np.diff(before[offsets])), pc.binary_join(kept, "\n")], names=["doc_id", "n_lines", "n_dropped", "text"])

    return small_batches(docs).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")


def dedup_lines(docs: DataFrame, *, folder: str | None = None, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """All documents into a store of their own, and what is left of each."""
    store = LineStore(docs.sparkSession, folder, min_docs=min_docs)
    store.apply(inserted=docs)
    return store.clean(docs, filter_bytes)


ORACLE = """
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, r, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM l),
often AS (SELECT key FROM (SELECT DISTINCT r, unnest(keys) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
e AS (SELECT doc_id, r, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS i FROM k)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN often USING (key) GROUP BY doc_id, r
"""
