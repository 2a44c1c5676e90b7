"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger has one row for each (blob, rule version) that
has been scanned, with its findings, empty ones too. ``scan`` takes the versions' digests, and of these the ones that the ledger doesn't have under this
rule version; only their texts are moved, each scanned once, and a new run is written with their findings and no others. Then findings are joined
back to all paths. A second run over the same history moves no text and writes no row; new rules get a new version and scan each blob once more. Runs
stay as they are: ``compact`` makes one of them, when somebody asks.

Positions come from two native functions: the matches of a pattern, and the pieces of the text between them; their lengths
add up to code-point offsets.

Copies of a text meet in one row before anything is scanned: partial aggregation takes them together on the map side, so
a blob that a third of all paths share costs one row a task. The join back is keyed by blob with one row on the
ledger's side; adaptive execution splits its large partitions. Digests that are few are sent to every task, and the texts, or the ledger, filtered where they lie.

Defined results: a null text is an empty one; rows with equal paths are versions of their own and each gets a row; a blob without
findings gives zeros, an empty ``spans`` and the hash of the empty string; a very long text is scanned whole, by one task; an empty table gives no rows; columns of the
history other than its path columns and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefolio.llm.common import BROADCAST_ROWS, settle, shared_dir, small


@dataclass(frozen=True)
class Rule:
    """A pattern of which each match is a finding; ``group`` must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    needs: str = ""  # a text without this string has no match
    group: int = 0
    least: int = 0


#: In the order of kinds. The first three are the base; a run of fixed characters is matched whole, so that its least length can stand in the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
)
RULES = BASE + MORE


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(json.dumps([asdict(r) for r in rules]).encode()).hexdigest()[:16]


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of the rule's matches in ``text``."""
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("g"), part.alias("p"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        kept = F.when(F.length(x["p"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]) if rule.least else F.concat(acc["out"], one)
        return F.struct(end.alias("at"), kept.alias("out"))

    out = F.aggregate(rows, zero, step, lambda acc: acc["out"])
    return F.when(text.contains(rule.needs), out).otherwise(F.array().cast(kind)) if rule.needs else F.when(text.rlike(rule.pattern), out).otherwise(F.array().cast(kind))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text) to (blob, findings): all spans by start, then by the rules' order."""
    for k, r in enumerate(rules):
        blobs = blobs.withColumn(f"spans_{k}", spans(F.col("text"), r, k))
    return blobs.select("blob", F.array_sort(F.concat(*(f"spans_{k}" for k in range(len(rules))))).alias("findings"))


SCANNED = "blob string, findings array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def addressed(history: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return history.select(*paths, F.sha2(text, 256).alias("blob"), text.alias("text"))


def near(digests: DataFrame) -> DataFrame:
    """Sent to every task where it has no more rows than BROADCAST_ROWS, else shuffled."""
    return small(digests, digests.limit(BROADCAST_ROWS + 1).count())


def scan(history: DataFrame, *, paths: tuple[str, ...] = ("doc_id",), ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every version: the path columns, blob, findings. ``ledger``: a folder of the shared store; without it a new one is begun."""
    spark = history.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/tracefolio/ledger-{uuid.uuid4().hex}"
    here = f"{ledger}/rule_version={rule_version(rules)}"
    versions = addressed(history, paths)
    before = runs(spark, here)
    unseen = versions
    if before:
        digests = settle(versions.select("blob").distinct(), "digests")
        new = settle(digests.join(scanned(spark, before).select("blob"), "blob", "left_anti"), "unseen")
        unseen = versions.join(near(new), "blob", "left_semi")
    if not before or not new.isEmpty():
        scan_blobs(unseen.groupBy("blob").agg(F.first("text").alias("text")), rules).write.parquet(f"{here}/run={uuid.uuid4().hex}")
    done = runs(spark, here)
    found = scanned(spark, done)
    if len(done) > 1:
        # runs that overlapped, or one that was done again after a failure behind its commit, may both have a blob
        found = found.join(near(digests), "blob", "left_semi").dropDuplicates(["blob"]) if before else found.dropDuplicates(["blob"])
    return versions.drop("text").join(found, "blob")


def runs(spark, folder: str) -> list[str]:
    """The runs under one rule version. Each has a folder of its own, and counts from when Spark's committer has ended it."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/run=*/_SUCCESS")
    return sorted(str(f.getPath().getParent()) for f in p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p) or [])


def scanned(spark, done: list[str]) -> DataFrame:
    """The rows of runs; runs that overlapped may both have a blob."""
    return spark.read.schema(SCANNED).parquet(*done)


def read_ledger(spark, folder: str) -> DataFrame | None:
    """What has been scanned under one rule version, each blob once; None if nothing has."""
    done = runs(spark, folder)
    if not done:
        return None
    return scanned(spark, done).dropDuplicates(["blob"]) if len(done) > 1 else scanned(spark, done)


def compact(spark, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """All runs of a rule version to one. The new one is whole before the others go; a compaction that is broken off between leaves blobs in two runs, which ``scan`` allows for."""
    here = f"{ledger}/rule_version={rule_version(rules)}"
    done = runs(spark, here)
    if len(done) > 1:
        scanned(spark, done).dropDuplicates(["blob"]).write.parquet(f"{here}/run={uuid.uuid4().hex}")
        fs, sc = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
        for path in done:
            fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration()).delete(fs.Path(path), True)


def listed(findings: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, paths: tuple[str, ...] = ("doc_id",), base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The path columns, n_<kind> of the base kinds, base_sha256, spans."""
    of_base = F.filter("findings", lambda x: x["rank"] < len(base))

    def of_rank(k: int) -> Column:
        return F.size(F.filter("findings", lambda x: x["rank"] == k)).cast("long")

    counts = [of_rank(k).alias(f"n_{r.kind}") for k, r in enumerate(base)]
    return found.select(*paths, *counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The digest of ``documents`` as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cols, parts = [], []
    for k, r in enumerate(rules):
        cols.append(f"regexp_extract_all(text, {q(r.pattern)}) AS m{k}, regexp_split_to_array(text, {q(r.pattern)}) AS g{k}, regexp_extract_all(text, {q(r.pattern)}, {r.group}) AS p{k}")
        start = f"list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)"
        parts.append(f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(p{k}[i]) >= {r.least}), lambda i: {{'s': CAST({start} AS BIGINT), 'r': {k}, 'k': {q(r.kind)}, 'e': CAST({start} + length(m{k}[i]) AS BIGINT)}})")
    joined = lambda v: f"array_to_string(list_transform({v}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda x: x.r = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(base))
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, {', '.join(cols)} FROM t), "
        f"f AS (SELECT doc_id, list_sort(flatten([{', '.join(parts)}])) AS f FROM m) "
        f"SELECT doc_id, {counts}, sha256(coalesce({joined(f'list_filter(f, lambda x: x.r < {len(base)})')}, '')) AS base_sha256, coalesce({joined('f')}, '') AS spans FROM f"
    )
