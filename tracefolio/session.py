"""A session with the settings that the engine expects, its tables and its shared folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tracefolio", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is the cluster's."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and there is but one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracefolio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read again: lineage ends there, and several readers read it once made."""
    path = f"{shared_dir(df.sparkSession)}/tracefolio/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_key(df: DataFrame) -> str:
    """A name for what ``df`` holds: its plan, and paths, sizes and times of change of the files that it reads. One of its own where it reads none."""
    sc, paths = df.sparkSession.sparkContext, sorted(df.inputFiles())
    if not paths:
        return uuid.uuid4().hex
    seen = hashlib.sha256(df._jdf.queryExecution().normalized().canonicalized().toString().encode())
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p)
        seen.update(f"{path} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()


#: Rows and bytes of an Arrow batch, at most: texts and images are long, and a batch lies in the JVM and in Python at once.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have no more than ARROW_ROWS rows and ARROW_BYTES bytes. Spark has no such setting for one plan, so the session's is lowered, and stays so."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < int((conf.get(key, None) or "0").rstrip("b")) <= most:
            conf.set(key, most)
    return df


@contextmanager
def split_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Files that are read meanwhile come to tasks of at most ``most`` bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)
