"""Stored artifacts: registries and headline records as JSON, the fact table, imported files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio import schemas
from tracefolio.sources.registry import require_none

ACCEPTED = (".pdf", ".html", ".htm", ".txt", ".md")


def filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry's entries from JSON; a record of another shape fails the read."""
    return spark.read.schema(schemas.REGISTRY).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_headlines(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """One record a file, from all files under a folder, with the path each came from."""
    rows = spark.read.schema(schemas.HEADLINE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(folder)
    return rows.withColumn("artifact_path", F.input_file_name())


def write_artifact(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII kept as it is."""
    df.write.mode("overwrite").json(path)


class Versions:
    """Versions of a table in a folder, and a pointer file that names the one that holds. A write makes a new version beside the old ones and then renames a new pointer over the old one, in one step: whenever
    it is broken off, readers see one whole version or the other, and there is always one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> str | None:
        fs, p = filesystem(self.spark, f"{self.folder}/CURRENT")
        return self.spark.read.text(f"{self.folder}/CURRENT").collect()[0][0] if fs.exists(p) else None

    def path(self) -> str | None:
        version = self.current()
        return f"{self.folder}/{version}" if version else None

    def new(self) -> str:
        return f"v-{uuid.uuid4().hex}"

    def switch(self, version: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        fs, new = filesystem(self.spark, f"{self.folder}/CURRENT.{version}")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = sc._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration())
        files.rename(new, filesystem(self.spark, f"{self.folder}/CURRENT")[1], over)

    def drop_others(self, *keep: str | None) -> None:
        """Remove versions that nobody reads any more."""
        fs, p = filesystem(self.spark, self.folder)
        for f in fs.listStatus(p):
            if f.isDirectory() and f.getPath().getName().startswith("v-") and f.getPath().getName() not in keep:
                fs.delete(f.getPath(), True)


class Buckets(Versions):
    """A table in hash buckets of the column ``by``. Each version has a manifest, which names for every bucket the version in whose folder it lies; so a change writes the buckets that it touches, and
    a manifest, and takes the others over. It holds from when the pointer is renamed; broken off at any step, it leaves the table as it was. Buckets of one version may be partitioned further by columns.

    A change that another one has overtaken is refused (``change`` compares the pointer before it is renamed): one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, by: str, *, buckets: int = 16, partitions: tuple[str, ...] = (), schema: str | None = None):
        super().__init__(spark, folder)
        self.by, self.buckets, self.partitions, self.schema = by, buckets, partitions, schema

    def manifest(self) -> dict[int, str]:
        """Bucket to version; as many rows as there are buckets."""
        path = self.path()
        rows = self.spark.read.parquet(f"{path}/manifest").collect() if path else []
        self.buckets = rows[0]["buckets"] if rows else self.buckets
        return {r["bucket"]: r["version"] for r in rows if r["version"]}

    def bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first version of a table without a schema."""
        lie: dict[str, list[int]] = {}
        for k, v in self.manifest().items():
            if only is None or k in only:
                lie.setdefault(v, []).append(k)
        out = None
        for v, ks in sorted(lie.items()):
            at = f"{self.folder}/{v}/data"
            reader = self.spark.read.option("basePath", at)
            part = (reader.schema(self.schema) if self.schema else reader).parquet(*(f"{at}/bucket={k}" for k in sorted(ks))).drop("bucket")
            out = part if out is None else out.unionByName(part)
        if self.schema is None:
            return out
        empty = self.spark.createDataFrame([], self.schema)
        # partition columns are read last: back to the schema's order
        return empty if out is None else out.select(*empty.columns)

    def change(self, touched: set[int], rows: DataFrame, base: str | None) -> None:
        """``rows`` are what the touched buckets hold from now on."""
        before, version = self.manifest(), self.new()
        at = f"{self.folder}/{version}"
        placed = rows.withColumn("bucket", self.bucket(F.col(self.by)))
        placed.repartition("bucket", *self.partitions).write.partitionBy("bucket", *self.partitions).parquet(f"{at}/data")
        fs, p = filesystem(self.spark, f"{at}/data")
        names = (f.getPath().getName() for f in fs.listStatus(p))
        written = {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}
        if not written <= touched:
            raise ValueError("rows of buckets that are not changed")
        now = {k: v for k, v in before.items() if k not in touched} | dict.fromkeys(written, version)
        listed = sorted(now.items()) or [(-1, None)]
        self.spark.createDataFrame([(k, v, self.buckets) for k, v in listed], "bucket int, version string, buckets int").coalesce(1).write.parquet(f"{at}/manifest")
        if self.current() != base:
            raise RuntimeError(f"{self.folder} was changed meanwhile")
        self.switch(version)

    def replace(self, rows: DataFrame) -> None:
        """All rows anew."""
        base = self.current()
        self.manifest()
        self.change(set(range(self.buckets)), rows, base)

    def merge(self, new: DataFrame, make: Callable[[DataFrame | None, DataFrame], DataFrame], also: tuple = ()) -> None:
        """``make(old, new)`` over the buckets in which ``new`` has rows, or to which the values ``also`` of the column belong; other buckets are neither read nor written."""
        base = self.current()
        self.manifest()
        named = self.spark.createDataFrame([(str(v),) for v in also], "v string").select(self.bucket(F.col("v")).alias("b"))
        touched = {r["b"] for r in new.select(self.bucket(F.col(self.by)).alias("b")).union(named).distinct().collect()}  # as many as there are buckets, at most
        if touched:
            self.change(touched, make(self.read(touched), new), base)

    def vacuum(self, *keep: str | None) -> None:
        """Remove versions in which neither the current table nor those named have a bucket."""
        self.drop_others(*keep, self.current(), *self.manifest().values())


class FactTable(Buckets):
    """The fact table, in buckets of documents; files are partitioned by metric and year, which are what questions filter by. A fact_id that is missing or comes twice is refused."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        super().__init__(spark, folder, "document_id", buckets=buckets, partitions=("metric_id", "fiscal_year"), schema=schemas.FACT)

    def _checked(self, facts: DataFrame) -> DataFrame:
        require_none(facts.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or fact_id is null").select(F.coalesce("fact_id", F.lit("")).alias("fact_id"), F.lit("fact_id must be there once").alias("rule")), "fact_id")
        return facts.select(*self.spark.createDataFrame([], schemas.FACT).columns)

    def write(self, facts: DataFrame) -> None:
        """All facts anew."""
        self.replace(self._checked(facts))

    def upsert(self, new: DataFrame, order: str = "pos") -> None:
        """Facts in place of those of their fact_id; of equal ones the last by ``order`` holds. Only buckets of their documents are read and written."""
        from tracefolio.operators.facts import upsert

        self.merge(new, lambda old, rows: self._checked(upsert(old, rows, order=order)))

    def replace_document(self, document_id: str, new: DataFrame, order: str = "pos") -> None:
        """All facts of one document anew: its bucket is read and written."""
        from tracefolio.operators.facts import replace_document

        self.merge(new, lambda old, rows: self._checked(replace_document(old, document_id, rows, order=order)), also=(document_id,))


def import_name(name: str, size: int, taken: set[str], stamp: str) -> str:
    """The name under which a file is taken in: its own without folders, with a time and then a number if that is taken. Unknown kinds and empty files are errors."""
    base = re.split(r"[/\\]", name)[-1].strip()
    stem, dot, suffix = base.rpartition(".")
    if f"{dot}{suffix}".lower() not in ACCEPTED or not stem:
        raise ValueError(f"unsupported file: {base or name}")
    if size <= 0:
        raise ValueError(f"empty file: {base}")
    names = [base, f"{stem}_{stamp}.{suffix}"]
    n = 2
    while (choice := next((x for x in names if x not in taken), None)) is None:
        names, n = [f"{stem}_{stamp}_{n}.{suffix}"], n + 1
    return choice


def page_sources(files: DataFrame, parse_pdf=None) -> DataFrame:
    """(path, content) to path, page_number, text, parser_kind, error. Each suffix has its parsers in order; the first that gives text is taken, and a file that none can read is a row with an error.

    PDF parsing is a plug-in (bytes to page texts): no PDF library is assumed.
    """
    from tracefolio.operators.documents import each
    from tracefolio.sources.html import decode, pages_of

    parsers = {"html": [("tag", lambda b: pages_of(decode(b))), ("basic", lambda b: [decode(b)])], "pdf": [("plugin", parse_pdf)] if parse_pdf else [], "": [("basic", lambda b: decode(b).split("\n---\n"))]}

    def make(row: tuple) -> list[tuple]:
        path, content = row
        suffix = path.rsplit(".", 1)[-1].lower() if path else ""
        error = f"no parser for .{suffix}"
        for kind, run in parsers.get("html" if suffix in ("html", "htm") else suffix, parsers[""]):
            try:
                texts = [(n, t.strip()) for n, t in enumerate(run(bytes(content or b"")), 1) if t.strip()]
            except Exception as e:  # a broken file is a row, not a failed job
                error = type(e).__name__
                continue
            if texts:
                return [(path, n, t, kind, None) for n, t in texts]
            error = "no text"
        return [(path, None, None, None, error)]

    return each(files, ["path", "content"], make, "path string, page_number long, text string, parser_kind string, error string")


# The parser that a suffix is read by first, and the warning of a file without text.
CANDIDATES = {".pdf": "pymupdf", ".htm": "html_tag", ".html": "html_tag"}
EMPTY_TEXT = "empty_extracted_text"
SMOKE = "document_key string, local_path string, suffix string, status string, parser_kind_candidate string, page_count_estimate long, sample_text_chars long, sample_pages_checked array<long>, error_type string, error_message string, warnings array<string>"


def parser_smoke(entries: DataFrame, *, supported: tuple[str, ...], parse_pdf=None, sample_pages: int = 3, least: int = 1) -> DataFrame:
    """Can the files be read? (document_key, local_path, suffix, content, warnings) to a row a file: passed, failed or skipped, what was sampled, and what went wrong.

    Of a PDF the first ``sample_pages`` pages are read (``parse_pdf``: bytes to page texts), of HTML the visible text. A kind that is not supported is skipped; a file that is missing (null content), breaks its parser or
    gives fewer than ``least`` characters has failed. No failure stops the run.
    """
    if sample_pages < 1 or least < 1:
        raise ValueError("sample_pages and least must be 1 or more")
    from tracefolio.operators.documents import each
    from tracefolio.sources.html import decode, visible

    def sample(suffix: str, content: bytes) -> tuple[int, str, list[int]]:
        if suffix in (".htm", ".html"):
            return 1, visible(decode(content)), [1]
        if suffix == ".pdf" and parse_pdf:
            pages = list(parse_pdf(content))
            return len(pages), "\n".join(pages[:sample_pages]), list(range(1, min(sample_pages, len(pages)) + 1))
        raise ValueError(f"no parser for {suffix}")

    def make(row: tuple) -> list[tuple]:
        key, path, suffix, content, warnings = row
        head, warnings = (key, path, suffix), list(warnings or [])
        kind = CANDIDATES.get(suffix, "unsupported")
        if suffix not in supported:
            return [(*head, "skipped", kind, None, 0, [], None, None, warnings)]
        if content is None:
            return [(*head, "failed", kind, None, 0, [], "FileNotFoundError", f"File not found: {path}", warnings)]
        try:
            pages, text, checked = sample(suffix, bytes(content))
        except Exception as e:  # a broken file is a row
            return [(*head, "failed", kind, None, 0, [], type(e).__name__, str(e) or "the parser failed", warnings)]
        n = len(" ".join(text.split()))
        if n < least:
            return [(*head, "failed", kind, pages, n, checked, "EmptyTextError", f"{n} characters of text, {least} are required", [*warnings, EMPTY_TEXT])]
        return [(*head, "passed", kind, pages, n, checked, None, None, warnings)]

    return each(entries, ["document_key", "local_path", "suffix", "content", "warnings"], make, SMOKE)


def smoke_summary(results: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """(what, name, n): documents and supported ones, and counts by status, parser, error and warning."""
    one = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    kinds = [one("documents", F.lit("total")), F.when(F.col("suffix").isin(*supported), one("documents", F.lit("supported"))), one("status", F.col("status")), one("parser", F.col("parser_kind_candidate")), F.when(F.col("error_type").isNotNull(), one("error", F.col("error_type")))]
    every = F.concat(F.array_compact(F.array(*kinds)), F.transform("warnings", lambda w: one("warning", w)))
    return results.select(F.explode(every).alias("k")).groupBy("k.what", "k.name").agg(F.count(F.lit(1)).alias("n"))


# Folders of a data directory.
FOLDERS = ("samples", "raw", "parsed", "indexes", "outputs", "qdrant")


def ensure_folders(spark: SparkSession, root: str) -> dict[str, str]:
    """The folders under ``root``, made where they are missing, by Spark's own file system."""
    out = {}
    for name in FOLDERS:
        fs, p = filesystem(spark, f"{root.rstrip('/')}/{name}")
        fs.mkdirs(p)
        out[name] = str(p)
    return out


def import_file(spark: SparkSession, folder: str, name: str, content: bytes, stamp: str) -> str:
    """Take a file in under a name that is free (``import_name``); its bytes are written beside it first and renamed, so no reader sees half of it. Gives the path."""
    fs, base = filesystem(spark, folder)
    fs.mkdirs(base)
    taken = {f.getPath().getName() for f in fs.listStatus(base)}
    path = f"{folder.rstrip('/')}/{import_name(name, len(content), taken, stamp)}"
    _, part = filesystem(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(content))
    out.close()
    if not fs.rename(part, filesystem(spark, path)[1]):
        fs.delete(part, False)
        raise FileExistsError(path)
    return path


def index_once(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The table under ``key`` (a checksum of what it is made from), built by ``build()`` if it is not there. Two that build at once both write, each whole; the first to switch is read by both."""
    table = Versions(spark, f"{folder.rstrip('/')}/{key}")
    if not table.path():
        version = table.new()
        build().write.parquet(f"{table.folder}/{version}")
        if not table.path():
            table.switch(version)
    return spark.read.parquet(table.path())


def prewarm(spark: SparkSession, folder: str, key: str, build) -> str | None:
    """As ``index_once``, but what goes wrong is given back and not raised: a run does not fail for its index."""
    try:
        index_once(spark, folder, key, build)
    except Exception as e:
        return f"{type(e).__name__}: {e}"
    return None
