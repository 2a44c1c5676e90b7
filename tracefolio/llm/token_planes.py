"""Token-ID output as byte- or bit-plane segments.

A *segment* is a self-contained binary image::

    b"TPL1" | u8 bits (8: byte planes, 1: bit planes) | u8 id width in bytes | u16 0 | u32 block size | u32 blocks | u64 ids | u32 docs
    chunk index: for each block and plane u32 length of the compressed plane
    doc index:   zstd of (i64 doc_id)*, u32 length before it;  zstd of (u32 n_ids)*, u32 length before it
    planes:      the compressed planes, block by block

A block holds ``block`` ids (the last one fewer). Its little-endian ids are transposed to planes - plane k has byte k (or
bit k, packed eight to a byte) of every id - and each plane is compressed with zstandard by itself. With the chunk index
a reader opens only the blocks it needs (``read_ids``).

Segments are the rows of a Parquet table in the shared folder, written by Spark's committer: a task that is lost is
written again, never twice. Texts are moved once (a range exchange on doc_id and the text's hash, so that one doc_id, or
rows without one, may hold any share of the table); ids never are.

Defined results: a null text is an empty one and gives the end id alone; a null doc_id sorts first; rows with equal
doc_id are ordered by the text's hash, then by text; equal rows each get their own place; a very long text is encoded whole and
makes a segment as long as it is; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.llm.common import doc_texts, fast_tokenizer, in_order, map_rows, settle, small, small_batches, tokenizer_path

MAGIC = b"TPL1"
HEAD = struct.Struct("<4sBBHIIQI")
BLOCK = 1 << 16
#: Ids after which a segment is closed: images stay under a megabyte, for readers hold several at once.
SEGMENT_IDS = 1 << 19
#: Pieces whose ids a worker keeps; more than elsewhere, for here no other operator's memos lie beside them.
KEPT_PIECES = 900_000
END_ID = 0
NULL_ID = -(1 << 63)


def split_planes(ids: np.ndarray, width: int, bits: int) -> list[bytes]:
    """The planes of one block."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(width)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(width * 8)]


def join_planes(planes: list[bytes], n: int, width: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.empty((n, width), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        flat = np.empty((n, width * 8), np.uint8)
        for k, p in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(flat, axis=1, bitorder="little")
    return raw.reshape(-1).view(f"<u{width}")


def write_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray, *, block: int = BLOCK, bits: int = 8, level: int = 3) -> bytes:
    """The image of one segment."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    planes = [press(p) for at in range(0, len(ids), block) for p in split_planes(ids[at : at + block], width, bits)]
    docs = [press(np.array(doc_ids, "<i8").tobytes()), press(np.array(lengths, "<u4").tobytes())]
    head = HEAD.pack(MAGIC, bits, width, 0, block, -(-len(ids) // block), len(ids), len(doc_ids))
    return b"".join([head, np.array([len(p) for p in planes], "<u4").tobytes(), *(struct.pack("<I", len(d)) + d for d in docs), *planes])


class Segment:
    """A reader over an image; nothing but the indexes is opened before it is asked for."""

    def __init__(self, image: bytes):
        import zstandard

        magic, self.bits, self.width, _, self.block, self.blocks, self.n_ids, self.n_docs = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token-plane segment")
        self.image, self.open = image, zstandard.ZstdDecompressor().decompress
        self.planes = self.width * (8 if self.bits == 1 else 1)
        n = self.blocks * self.planes
        sizes = np.frombuffer(image, "<u4", n, HEAD.size).astype(np.int64)
        at, found = HEAD.size + 4 * n, []
        for _ in range(2):
            (size,) = struct.unpack_from("<I", image, at)
            found.append(self.open(image[at + 4 : at + 4 + size]))
            at += 4 + size
        self.doc_ids, self.lengths = np.frombuffer(found[0], "<i8"), np.frombuffer(found[1], "<u4").astype(np.int64)
        self.offsets = at + np.concatenate([[0], np.cumsum(sizes)])

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        at = self.offsets[k * self.planes : (k + 1) * self.planes + 1]
        return join_planes([self.open(self.image[a:b]) for a, b in zip(at, at[1:])], n, self.width, self.bits)

    def read_ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop; only the blocks between them are opened."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.empty(0, f"<u{self.width}")
        first = start // self.block
        got = np.concatenate([self.read_block(k) for k in range(first, -(-stop // self.block))])
        return got[start - first * self.block : stop - first * self.block]


def write_store(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, block: int = BLOCK, bits: int = 8, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text and write segments in ascending doc_id order; gives the written table (part, seg, first, n_docs, n_ids, image)."""
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part, seg = fast_tokenizer(tokenizer, False, most=KEPT_PIECES), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2")
        held: list[np.ndarray] = []
        names: list[int] = []
        lengths: list[int] = []
        n = 0

        def flush() -> pa.RecordBatch:
            image = write_segment(names, lengths, np.concatenate(held), block=block, bits=bits)
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((part, seg, len(names), n, image), schema)], schema=schema)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tok.all_ids(b.column(1))):
                ids = np.concatenate([ids, end])
                held.append(ids)
                names.append(NULL_ID if doc_id is None else doc_id)
                lengths.append(len(ids))
                n += len(ids)
                if n >= segment_ids:
                    yield flush()
                    seg += 1
                    held, names, lengths, n = [], [], [], 0
        if names:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_order(doc_texts(docs), parts)
    return settle(small_batches(ordered).mapInArrow(encode, "part int, seg int, n_docs long, n_ids long, image binary"), "planes")


def read_store(store: DataFrame) -> DataFrame:
    """Every document of a store, from its images: doc_id, start, n_tokens, ids_crc32, segment."""
    sizes = store.select("part", "seg", "n_ids")
    # one row a part is summed up in one task; segments are summed up within their part
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(small(parts, per_part.count()), F.col("part") == F.col("p"))
    index = index.select("part", "seg", (F.col("first") + F.col("within")).cast("long").alias("base"))
    placed = store.select("part", "seg", "image").join(small(index, sizes.count()), ["part", "seg"])

    def start():
        def work(cols: dict) -> list[tuple]:
            out = []
            for part, seg, base, image in zip(cols["part"], cols["seg"], cols["base"], cols["image"]):
                s = Segment(image)
                raw = s.read_ids().astype("<u4").tobytes()
                stops = np.cumsum(s.lengths)
                for doc, a, b in zip(s.doc_ids.tolist(), (stops - s.lengths).tolist(), stops.tolist()):
                    out.append((None if doc == NULL_ID else doc, base + a, b - a, zlib.crc32(raw[4 * a : 4 * b]), f"{part}-{seg}"))
            return out

        return work

    return map_rows(placed.select("part", "seg", "base", "image"), "doc_id long, start long, n_tokens long, ids_crc32 long, segment string", start, batch=1)


def token_planes(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Encode, write and read back (see the module's text)."""
    return read_store(write_store(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), **options))
