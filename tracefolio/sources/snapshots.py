"""Snapshots of a folder of raw files: a scan reads what has changed since the one before, and nothing else.

A snapshot has a row for each file: path, length, modified, checksum. A scan lists the files without their contents, takes over the checksums of those whose length and time
of change are as they were, reads and hashes the others, and writes the next snapshot, which holds from when its pointer is renamed. Files that are gone are told as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefolio.sources.artifacts import Versions

SNAPSHOT = "path string, length long, modified timestamp, checksum string"
#: Paths that one read of contents names.
READ_AT_ONCE = 10_000


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def read(self) -> DataFrame:
        """The last snapshot; no rows before the first."""
        path = self.versions.path()
        return self.spark.read.schema(SNAPSHOT).parquet(f"{path}/files") if path else self.spark.createDataFrame([], SNAPSHOT)

    def listed(self, files: str) -> DataFrame:
        """path, length and time of change of every file under ``files``: contents are not opened."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], "path string, length long, modified timestamp")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(files)
        return found.select("path", "length", F.col("modificationTime").alias("modified"))

    def hashed(self, paths: list[str]) -> DataFrame:
        """path, length, modified, checksum of the files named, whose contents are read."""
        out = self.spark.createDataFrame([], SNAPSHOT)
        for at in range(0, len(paths), READ_AT_ONCE):
            some = self.spark.read.format("binaryFile").load([p.replace("\\", "\\\\").translate({ord(c): f"\\{c}" for c in "{}[]*?"}) for p in paths[at : at + READ_AT_ONCE]])
            out = out.unionByName(some.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum")))
        return out

    def scan(self, files: str) -> DataFrame:
        """Bring the snapshot up to date; (path, change) of what is ``new``, ``changed``, ``touched`` (another time, the same content) or ``gone``. The driver holds the paths to be read: the difference, not the folder."""
        before, now = self.read(), self.listed(files)
        same = F.col("b.length").eqNullSafe(F.col("n.length")) & F.col("b.modified").eqNullSafe(F.col("n.modified"))
        met = now.alias("n").join(before.alias("b"), F.col("n.path") == F.col("b.path"), "left")
        kept = met.where(same).select("n.path", "n.length", "n.modified", "b.checksum")
        unread = [r[0] for r in met.where(~same).select("n.path").collect()]
        version = self.versions.new()
        at = f"{self.versions.folder}/{version}"
        kept.unionByName(self.hashed(unread)).write.parquet(f"{at}/files")
        after = self.spark.read.schema(SNAPSHOT).parquet(f"{at}/files")
        both = after.alias("a").join(before.alias("b"), F.col("a.path") == F.col("b.path"), "full")
        change = (
            F.when(F.col("a.path").isNull(), "gone").when(F.col("b.path").isNull(), "new").when(F.col("a.checksum") != F.col("b.checksum"), "changed")
            .when((F.col("a.modified") != F.col("b.modified")) | (F.col("a.length") != F.col("b.length")), "touched")
        )
        both.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).where("change is not null").write.parquet(f"{at}/changes")
        self.versions.switch(version)
        return self.spark.read.schema("path string, change string").parquet(f"{at}/changes")
