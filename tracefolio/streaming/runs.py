"""Runs: time spent in stages, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def stage_durations(events: DataFrame, run: str, stage: str, ts: str, tie: str) -> DataFrame:
    """Seconds in each stage of each run: from its opening to the next one; a stage that comes again adds up; the last one stays open."""
    after = F.lead(seconds(ts)).over(Window.partitionBy(run).orderBy(ts, tie))
    timed = events.select(run, F.col(stage).alias("stage"), (after - seconds(ts)).alias("s")).where("s is not null")
    return timed.groupBy(run, "stage").agg(F.sum("s").alias("seconds"))


def daily(events: DataFrame, watermark: str | None = "1 day") -> DataFrame:
    """Events and values by day and type; with a watermark late rows are bounded, which a stream needs."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    g = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def track(stream: DataFrame) -> DataFrame:
    """The streaming form: (run, stage, at seconds) to the run's open stage and its total so far. The state is one open stage and a sum for each run; a run ends with done or failed."""
    schema = "run string, stage string, total double, finished boolean"

    def update(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        stage, since, total = held.get if held.exists else (None, None, 0.0)
        for f in frames:
            for s, at in sorted(zip(f["stage"], f["at"]), key=lambda x: x[1]):
                if stage in ("done", "failed"):
                    break
                total += at - since if since is not None else 0.0
                stage, since = s, at
        held.update((stage, since, total))
        yield pd.DataFrame({"run": [key[0]], "stage": [stage], "total": [total], "finished": [stage in ("done", "failed")]})

    return stream.groupBy("run").applyInPandasWithState(update, schema, "stage string, since double, total double", "update", "NoTimeout")
