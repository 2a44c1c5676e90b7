"""Rows against a stated set of queries, all of them, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block that meets a block of queries.
ROWS = 256


def against(rows: DataFrame, asked: DataFrame, start: Callable[[list[tuple]], Callable[[list[tuple]], list[tuple]]], schema: str, *, ask_block: int) -> DataFrame:
    """What every row gives with every asked row. ``start`` makes a block of asked rows ready, what it gives is called with blocks of rows, and gives rows of ``schema``.

    Up to ``ask_block`` asked rows go to every task with its code. More of them stay a table: it is dealt to blocks by a hash, rows are packed to blocks, too, and each block of rows joins every block of asked
    rows, over as many tasks as there are shuffle partitions. The driver holds no more than ``ask_block`` asked rows at any size, and rows are read once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    few = asked.limit(ask_block + 1).collect()
    if len(few) <= ask_block:
        held = [tuple(r) for r in few]
        return rows.mapInArrow(lambda batches: _meet(batches, held, start, arrow), schema)

    n = ceil(asked.count() / ask_block)
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n)
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    mine = asked.groupBy(F.pmod(F.xxhash64(*asked.columns), F.lit(n)).alias("part")).agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
    packed = rows.mapInArrow(_pack, f"block array<{rows.schema.simpleString()}>")
    # the salt comes from the block itself, so that a task that is run again deals its blocks alike
    placed = packed.withColumn("salt", F.pmod(F.xxhash64(F.col("block")[0]), F.lit(spread)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    joined = placed.join(mine.withColumn("salt", salts), ["part", "salt"]).select("part", "asked", "block")

    def run(batches: Iterator) -> Iterator:
        part, work = None, None
        for b in batches:
            for k in range(b.num_rows):
                key = b.column(0)[k].as_py()
                if key != part:
                    part, work = key, start([tuple(r.values()) for r in b.column(1)[k].as_py()])
                yield _batch(work([tuple(r.values()) for r in b.column(2)[k].as_py()]), arrow)

    return joined.mapInArrow(run, schema)


def _meet(batches: Iterator, asked: list[tuple], start: Callable, arrow) -> Iterator:
    work = start(asked)
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield _batch(work(list(zip(*(part.column(k).to_pylist() for k in range(part.num_columns))))), arrow)


def _pack(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = pa.StructArray.from_arrays(b.slice(at, ROWS).columns, fields=list(b.schema))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["block"])


def _batch(rows: list[tuple], arrow):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)
