"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often two of them meet in the corpus.

Each text (with a space in front) is cut by tokenizer A (byte-level BPE) and tokenizer B (sentencepiece, which puts the space there itself). Where tokens of
both end at one byte, a *group* ends. An A and a B token whose bytes overlap are a *link*: the pieces into which all ends of both cut the text
belong to one token of each, so links are found by one sorted union of ends.

1. Texts are encoded once; each document's row is written with its groups' digest and its distinct pairs, packed as int64 (A id times 2^32, plus B id), and how
   often each occurs.
2. Each task adds up its documents' pairs by np.unique; partial counts are dealt by range of the packed key and sorted, runs of equal keys are
   summed, and each range gives *count shards*: sorted keys and their counts, as binary images.
3. Documents look up their pairs by searchsorted. Up to COUNT_BYTES, each task maps the shards from a file without a name in its own folder, which is gone when the task
   ends; beyond that, pairs and counts meet by an exchange.

A pair's count is the number of documents that have it linked, and a pair is best if no other of its A id has a higher count.

Defined results: texts that are null or empty, or whose tokens don't give their bytes back (B spells U+2581 as a space), have no tokens: zeros and an
empty digest; special tokens' strings are plain text; rows are documents, be their doc_id repeated or null, and equal rows count each; a very
long text is aligned whole; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.llm.common import KEPT_CHARS, FastTokenizer, PieceMemo, claim, doc_texts, map_rows, settle, small_batches, tokenizer_path

#: Pairs in a count shard, and distinct pairs that a task adds up before it gives them out.
SHARD_PAIRS, TASK_PAIRS = 1 << 20, 1 << 20
#: All count shards up to so many bytes are sent to every task.
COUNT_BYTES = 256 << 20
SPACE = "▁"
B_BITS = np.int64(32)


#: Characters of texts whose new words are given to B's library at once.
BATCH_CHARS = 1 << 19


class Pieces:
    """A sentencepiece model, words memoised: no piece has a space behind another character, or a line end beside any, so lines' words with the spaces before them are cut by themselves.

    The words of several texts that are new go to the library in one call. The memo is emptied when it is full, and keeps neither long words nor such as don't give their bytes back.
    """

    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        self.model, self.most, self.memo = sentencepiece.SentencePieceProcessor(model_file=path), most, {}
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)]
        apart = not any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", n, re.DOTALL) for n in names)
        self.letter, self.line = self.cut("a"), self.cut("\n")
        self.words = re.compile("\n+| *[^ \n]+| +").findall if apart and len(self.line) == 2 else None

    def cut(self, text: str | list[str]) -> list:
        return self.model.encode(text, num_threads=1)

    def odd_word(self, word: str) -> list[int]:
        """The ids of line ends, of what stands behind one, and of spaces at an end, as they are within a text."""
        if word[0] == "\n":
            return self.cut(word)[1:]
        return self.cut("\n" + word)[len(self.line) :] if word[0] != " " else self.cut("a" + word)[len(self.letter) :]

    def same(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == text.encode()

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """For each text its ids, as ``encode`` gives them, and whether their bytes are those of a space and the text."""
        if self.words is None:
            return [(np.array(ids, "<i4"), self.same(ids, " " + t)) for t, ids in zip(texts, self.cut(texts))]
        memo, listed = self.memo, [self.words(" " + t) for t in texts]
        if len(memo) > self.most:
            memo.clear()
        new = set().union(*listed) - memo.keys()
        plain = [w for w in new if w[0] == " " and not w.isspace()]
        made = dict(zip(plain, self.cut([w[1:] for w in plain]))) if plain else {}
        made |= {w: self.odd_word(w) for w in new if w not in made}
        lossy = {w for w, ids in made.items() if not self.same(ids, w)}
        memo.update((w, array("i", ids).tobytes()) for w, ids in made.items())
        out = []
        for t, words in zip(texts, listed):
            ids = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<i4")
            out.append((ids, not lossy or lossy.isdisjoint(words) or self.same(ids.tolist(), " " + t)))
        for w in [w for w in new if len(w) > 64 or w in lossy]:
            del memo[w]
        return out


class LeanMemo(PieceMemo):
    """As it is; a piece that is new costs less."""

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        packed = array("H", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]).tobytes()
        if len(piece) <= KEPT_CHARS:
            self[piece] = packed
        return packed


class Aligner:
    """Both tokenizers, and what their tokens' bytes are."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = FastTokenizer(a_path, False), Pieces(b_path)
        self.a.whole.encode_special_tokens = True
        self.a.added = []  # plain text here, which the memo gives too
        self.a.memo = LeanMemo(self.a.whole.model)
        back = {c: b for b, c in self.a.memo.alphabet.items()}
        vocabulary = {k: t for t, k in self.a.whole.get_vocab(with_added_tokens=True).items()}
        specials = {t.content for t in self.a.whole.get_added_tokens_decoder().values()}
        names = [vocabulary.get(k, "") for k in range(max(vocabulary) + 1)]
        self.a_bytes = [t.encode() if t in specials else bytes(map(back.__getitem__, t)) for t in names]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b.bytes))
        self.n_a = len(self.a_bytes)
        # with every byte in its vocabulary and nothing that changes texts before, A gives all bytes back
        self.a_whole = self.a.whole.normalizer is None and {bytes([k]) for k in range(256)} <= set(self.a_bytes)
        # what stands behind an id in the digest: more of its side, or the side's end
        self.spelled = [f"{k}{mark}" for mark in (",", "|") for k in range(self.n_a)] + [f"{k}{mark}" for mark in (",", ";") for k in range(len(self.b.bytes))]

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """``align`` of each text, in order."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars < BATCH_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            cut = iter(self.b.ids([t for t in texts[at:stop] if t]))
            for t in texts[at:stop]:
                yield self.align(t, *next(cut)) if t else None
            at = stop

    def align(self, text: str, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B, the ends at which groups end, and the packed pair of every link; None without tokens. ``b``: B's ids, ``same``: whether they give the bytes back."""
        spaced = " " + text
        a, b = self.a.ids(spaced).astype(np.int64), b.astype(np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if not same or a_ends[-1] != b_ends[-1] or not (self.a_whole or b"".join(map(self.a_bytes.__getitem__, a.tolist())) == spaced.encode()):
            return None
        # two ascending runs are merged; an end of both is there twice
        every = np.concatenate([a_ends, b_ends])
        every.sort(kind="stable")
        twice = every[1:] == every[:-1]
        cuts, ends = every[np.append(True, ~twice)], every[1:][twice]
        links = a[np.searchsorted(a_ends, cuts)] << B_BITS | b[np.searchsorted(b_ends, cuts)]
        return a, b, ends, links

    def digest(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> str:
        """All groups: ids of A, a bar, ids of B, with semicolons between groups."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        a_code = a + self.n_a * (ends[a_group] == a_ends)
        b_code = 2 * self.n_a + b + len(self.b.bytes) * (ends[b_group] == b_ends)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        return "".join(map(self.spelled.__getitem__, np.concatenate([a_code, b_code])[order].tolist()))[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    key = a_path, b_path
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)

    def empty() -> None:
        _ALIGNERS[key].a.memo.clear()
        _ALIGNERS[key].b.memo.clear()

    claim(str(key), empty)
    return _ALIGNERS[key]


def pack(numbers: np.ndarray) -> bytes:
    """Sorted whole numbers, from 0 up, as compressed planes of their differences."""
    import zstandard

    steps = np.diff(numbers, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpack(image: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(image), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<i8"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the document's distinct pairs (``pairs``) with how often each is linked (``times``)."""

    def start():
        import zstandard

        al, press = aligner(a_path, b_path), zstandard.ZstdCompressor(level=1).compress

        def work(cols: dict) -> list[tuple]:
            out = []
            for doc_id, found in zip(cols["doc_id"], al.align_all(cols["text"])):
                if found is None:
                    out.append((doc_id, 0, 0, 0, 0, "", b"", b""))
                    continue
                a, b, ends, links = found
                pairs, times = np.unique(links, return_counts=True)
                sha = hashlib.sha256(al.digest(a, b, ends).encode()).hexdigest()
                out.append((doc_id, len(a), len(b), len(ends), len(links), sha, pack(pairs), press(times.astype("<u4").tobytes())))
            return out

        return work

    return map_rows(doc_texts(docs), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary", start)


def run_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with the sums of their runs."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def partial_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): documents by pair, as each task has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not waiting:
                return keys, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, weights = np.concatenate([keys, new]), np.concatenate([counts, n])
            order = np.argsort(both, kind="stable")
            return run_sums(both[order], weights[order])

        size = 0
        for b in batches:
            for image in b.column(0):
                if image := image.as_py():
                    waiting.append(unpack(image))
                    size += len(waiting[-1])
            if size >= TASK_PAIRS:
                keys, counts = merged()
                waiting, size = [], 0
                if len(keys) >= TASK_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    return small_batches(rows.select("pairs")).mapInArrow(count, "pair long, n long")


def count_shards(partial: DataFrame, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """(first, n_pairs, pairs, counts): sorted pairs and their document counts, in images of at most ``shard_pairs`` pairs; written."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("first", pa.int64()), ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def image(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((int(k[0]), len(k), k.astype("<i8").tobytes(), n.astype("<i8").tobytes()), schema)], schema=schema)

        for b in batches:
            # the last run may go on in the next batch, and is summed up there
            keys, counts = run_sums(np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([counts, b.column(1).to_numpy()]))
            while len(keys) > shard_pairs:
                yield image(keys[:shard_pairs], counts[:shard_pairs])
                keys, counts = keys[shard_pairs:], counts[shard_pairs:]
        if len(keys):
            yield image(keys, counts)

    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = partial.repartitionByRange(parts, "pair").sortWithinPartitions("pair")
    return settle(small_batches(ordered).mapInArrow(shards, "first long, n_pairs long, pairs binary, counts binary"), "count-shards")


class Counts:
    """Sorted count shards in one file without a name, mapped into memory, and the highest count of every A id."""

    def __init__(self, shards: list[tuple[bytes, bytes]]):
        n = sum(len(k) for k, _ in shards) // 8
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n:
            with tempfile.TemporaryFile() as f:
                for k in (0, 1):
                    for s in shards:
                        f.write(s[k])
                f.flush()
                mapped = np.memmap(f, "<i8", "r", shape=(2, n))
            self.keys, self.counts = mapped[0], mapped[1]
        firsts = np.flatnonzero(np.diff(self.keys >> B_BITS, prepend=-1)) if n else np.zeros(0, np.int64)
        self.ids = self.keys[firsts] >> B_BITS
        self.best = np.maximum.reduceat(self.counts, firsts) if n else self.counts

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs that are there, and whether each is its A id's highest."""
        n = self.counts[np.searchsorted(self.keys, pairs)]
        return n, n == self.best[np.searchsorted(self.ids, pairs >> B_BITS)]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_counts(rows: DataFrame, shards: DataFrame, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """The documents' rows with n_best and count_sum from the count shards."""
    size = shards.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n")).collect()[0]["n"] * 16
    if size > count_bytes:
        return _with_counts_by_exchange(rows, shards)
    images = [(bytes(r["pairs"]), bytes(r["counts"])) for r in shards.orderBy("first").select("pairs", "counts").collect()]
    sent = rows.sparkSession.sparkContext.broadcast(images)
    plain = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def start():
        import zstandard

        counts, opened = Counts(sent.value), zstandard.ZstdDecompressor().decompress

        def work(cols: dict) -> list[tuple]:
            out = []
            for doc_id, n_a, n_b, n_groups, n_links, sha, pairs, times in zip(*(cols[c] for c in (*plain, "pairs", "times"))):
                best = total = 0
                if pairs:
                    t = np.frombuffer(opened(times), "<u4").astype(np.int64)
                    n, top = counts.look_up(unpack(pairs))
                    best, total = int(t[top].sum()), int((t * n).sum())
                out.append((doc_id, n_a, n_b, n_groups, n_links, best, total, sha))
            return out

        return work

    return map_rows(rows.select(*plain, "pairs", "times"), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string", start)


def _with_counts_by_exchange(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """As ``with_counts``: a row for each pair of a document meets the pair's count; a join that splits what is frequent."""
    placed = settle(rows.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pairs, n in zip(b.column(0), b.column(1)):
                keys, counts = np.frombuffer(pairs.as_py(), "<i8"), np.frombuffer(n.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys >> B_BITS), pa.array(keys), pa.array(counts)], names=["a", "pair", "n"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for row, pairs, times in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if raw := pairs.as_py():
                    keys, t = unpack(raw), np.frombuffer(zstandard.ZstdDecompressor().decompress(times.as_py()), "<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys), pa.array(t)], names=["row", "pair", "t"])

    counts = small_batches(shards.select("pairs", "counts")).mapInArrow(opened, "a long, pair long, n long")
    highest = counts.groupBy("a").agg(F.max("n").alias("most")).withColumnRenamed("a", "of")
    known = counts.join(highest, F.col("a") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    links = small_batches(placed.select("row", "pairs", "times")).mapInArrow(of_rows, "row long, pair long, t long").join(known, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    return placed.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(*COLUMNS)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, count_bytes: int = COUNT_BYTES, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """Every document's tokens, groups and links, and how its links' pairs stand in the whole corpus."""
    rows = settle(aligned(docs, a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")), "aligned")
    return with_counts(rows, count_shards(partial_counts(rows), shard_pairs), count_bytes)
