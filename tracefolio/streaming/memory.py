"""Session memory: the last messages of a session, and versioned summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefolio.sources.artifacts import Buckets

KEEP = 8


def recent(messages: DataFrame, session: list[str], order: list[str], keep: int = KEEP, tie: list[str] | None = None) -> DataFrame:
    """The last ``keep`` messages of each session."""
    n = F.row_number().over(Window.partitionBy(*session).orderBy(*(F.desc(c) for c in order), *(tie or [])))
    return messages.withColumn("__n", n).where(F.col("__n") <= keep).drop("__n")


def latest(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The row of each key with the highest version; stale writes drop out. An aggregate: rows combine before the shuffle."""
    return df.groupBy(key).agg(F.max(version).alias(version), *(F.max_by(c, version).alias(c) for c in columns))


def remember(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """The streaming form: (document_id, session_id, turn, role, text) to what each session remembers after every batch: its last ``keep`` messages, its summary, and its version.

    A session is one of a document. Its version is its latest turn. A row of the role ``summary`` brings a new summary, made in the background from all up to its turn: it is taken
    only if no later turn has come since; a stale one is dropped. The state of a session is its last messages and one summary, so state grows with sessions only.
    """
    schema = "document_id string, session_id string, messages array<struct<turn:bigint,role:string,text:string>>, summary string, version bigint"
    place = {"user": 0, "assistant": 1, "summary": 2}

    def update(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        kept, summary, version = held.get if held.exists else ("[]", None, None)
        messages = json.loads(kept)
        rows = sorted({(int(t), place.get(r, 1), r, x) for f in frames for t, r, x in zip(f["turn"], f["role"], f["text"])}, key=lambda x: (x[0], x[1], str(x[3])))
        told = [[t, r, x] for t, _, r, x in rows if r != "summary"]
        messages = sorted(messages + [m for m in told if m not in messages], key=lambda m: (m[0], place.get(m[1], 1)))[-keep:]
        version = max([*(m[0] for m in messages), *([version] if version is not None else [])], default=None)
        for t, _, r, x in rows:
            if r == "summary" and version is not None and t >= version:
                summary = x
        held.update((json.dumps(messages, ensure_ascii=False), summary, version))
        shown = [{"turn": t, "role": r, "text": x} for t, r, x in messages]
        yield pd.DataFrame({"document_id": [key[0]], "session_id": [key[1]], "messages": [shown], "summary": [summary], "version": [version]})

    return stream.groupBy("document_id", "session_id").applyInPandasWithState(update, schema, "messages string, summary string, version bigint", "update", "NoTimeout")


def keep_latest(path: str, key: str, version: str, buckets: int = 16):
    """A function for foreachBatch: merge a batch into the table at ``path``, the highest version of each key wins. Running a batch again changes nothing; broken off at any point it leaves the table as it was.

    The table lies in buckets of the key (``sources.artifacts.Buckets``): a batch reads and writes the buckets of its keys. The version before stays for those who still read it.
    """

    def merge(batch: DataFrame, _: int) -> None:
        table = Buckets(batch.sparkSession, path, key, buckets=buckets)
        before = table.current(), *table.manifest().values()
        columns = [c for c in batch.columns if c not in (key, version)]
        table.merge(batch, lambda old, new: latest(old.select(*new.columns).unionByName(new) if old is not None else new, key, version, columns).select(*new.columns))
        table.vacuum(*before)

    return merge


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``keep_latest`` keeps; None before its first batch."""
    return Buckets(spark, path, "").read()
