"""What the operators of this subpackage share: tables, the shared folder, Arrow row maps and tokenizer memos."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.session import small_batches

#: More rows than this are never broadcast; the join is then a shuffled one.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table, read by Spark (the folder may be one that only Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and there is but one machine."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracefolio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracefolio/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove tables that ``settle`` wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_settled_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcasting if it has no more than BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) in ``parts`` ranges, each in order of doc_id, the text's hash and text. The hash is in the range key, so rows of one doc_id, or of none, may lie in many tasks; keys that the driver samples stay short."""
    hashed = rows.withColumn("__h", F.xxhash64("text"))
    return hashed.repartitionByRange(parts, "doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text").drop("__h")


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the columns named."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: How to empty what operators keep between tasks, by the operator's name. A Python worker serves many stages.
_KEPT: dict[str, Callable[[], None]] = {}


def claim(name: str, empty: Callable[[], None] = lambda: None) -> None:
    """From now on this worker's memory is for what ``name`` keeps; what others have kept is emptied. Who keeps nothing claims it, too, or what was kept before stays.

    Called with a global's method it must be called by a function of that global's module: nested functions go to workers with copies of the globals that they name.
    """
    for other, clear in _KEPT.items():
        if other != name:
            clear()
    _KEPT[name] = empty


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[dict], list[tuple]]], batch: int = 256) -> DataFrame:
    """Rows to rows by Arrow. ``start()`` runs once a task and gives a function from the columns of a slice (lists) to rows."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                rows = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield to_batch(rows, arrow)

    return small_batches(df).mapInArrow(run, schema)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a DataFrame, sent as Arrow data. From a list Spark would make an RDD of Python's, for which each executor starts a second set of Python workers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_batches([to_batch(rows, to_arrow_schema(kind))]), kind)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)


# --- tokenizers -------------------------------------------------------------------------------------------------------

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes to the characters that stand for them in byte-level vocabularies: printable ones stand for themselves, the rest from U+0100 on.
def byte_alphabet() -> dict[int, str]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Beyond these characters a text goes to the library whole: there, its Unicode tables and Python's may differ.
PLAIN = re.compile("[^\t\n\r -~À-įı-ſ]")
#: That, or white space beside other one; for Arrow's matcher.
CROWDED = f"{PLAIN.pattern}|[\t\n\r ][\t\n\r ]"
#: Bytes of text whose words are looked up together; a longer text stands alone, or first.
SLICE_BYTES = 4 << 20
#: Letters among the plain characters.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
CONTRACTED = "'(?:[stmd]|re|ve|ll)"


#: Longer pieces are not kept by memos.
KEPT_CHARS = 64


class PieceMemo(dict):
    """Piece to packed ids, each piece encoded once by the library's model. Half of the ``most`` pieces are young: when that many are there they become the old ones, of which those that are met again come back. Long pieces are not kept, so its memory is bounded."""

    def __init__(self, model, most: int = 300_000):
        super().__init__()
        self.model, self.most, self.alphabet, self.old = model, most, byte_alphabet(), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = self.packed(piece)
            if len(piece) > KEPT_CHARS:
                return packed
        if len(self) >= self.most // 2:
            self.old = self.copy()
            self.clear()
        self[piece] = packed
        return packed

    def packed(self, piece: str) -> bytes:
        # of printable ASCII only the space has another character that stands for it
        spelled = piece.replace(" ", self.alphabet[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()


class FastTokenizer:
    """A tokenizers file whose pieces are memoised. ``ids(text)`` equals ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, lower: bool, **memo):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # the memo's pieces know no added tokens: texts that have one go to the library whole, too
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.lower = lower
        self.memo = PieceMemo(self.whole.model, **memo)
        # letters and digits begin no contraction, so they may stand first
        space, digits, white = ("", "[0-9]", "") if lower else (" ?", " ?[0-9]+", r"|\s+(?!\S)|\s+")
        self.pieces = re.compile(rf"{space}[{LETTERS}]+|{digits}|{CONTRACTED}|{space}[^\s0-9{LETTERS}]+{white}").findall

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces(text.lower() if self.lower else text)))

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2")
        return np.frombuffer(self.packed(text), "<u2")

    def all_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``ids`` of every text of a column, slice by slice, so that what is held does not grow with the column."""
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:]):
            yield from self.slice_ids(texts.slice(a, b - a))

    def slice_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """A word that occurs often is cut and looked up once. Where no white space stands beside other one, no piece goes on over a space or a line end, so texts can be cut before each: words have their space before them, or a line end, which is a piece of its own."""
        odd = pc.match_substring_regex(texts, CROWDED)
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        words = pc.split_pattern(pc.replace_substring(pc.if_else(odd, pa.scalar("", texts.type), texts), "\n", " \n"), " ")
        found = words.flatten().dictionary_encode()
        names, at, stops = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), words.offsets.to_numpy()
        packed = list(map(self.word, names))
        for k, (whole, a, b) in enumerate(zip(odd.to_pylist(), stops.tolist(), stops[1:].tolist())):
            # a text's first word has no space before it
            yield self.ids(texts[k].as_py()) if whole else np.frombuffer(self.packed(names[at[a]]) + b"".join([packed[i] for i in at[a + 1 : b].tolist()]), "<u2")

    def word(self, word: str) -> bytes:
        """The ids of a space and the word; or of a line end and it."""
        name = word.rstrip(".,;:!?")
        if not name.isalpha():
            return self.packed(word if word.startswith("\n") else " " + word)
        ids = self.memo[name.lower() if self.lower else " " + name]
        return ids if len(name) == len(word) else ids + self.memo[word[len(name) :]]


_TOKENIZERS: dict[tuple, FastTokenizer] = {}


def fast_tokenizer(path: str, lower: bool, **memo) -> FastTokenizer:
    """One for each Python worker: workers live longer than tasks. ``memo``: how many pieces it keeps, where it is made."""
    if (path, lower) not in _TOKENIZERS:
        _TOKENIZERS[path, lower] = FastTokenizer(path, lower, **memo)
    claim(path, lambda: _drop(path))
    return _TOKENIZERS[path, lower]


def _drop(path: str) -> None:
    """The tokenizer goes with its memo: its tables are large as well."""
    for key in [k for k in _TOKENIZERS if k[0] == path]:
        del _TOKENIZERS[key]
