"""One filing after another through the whole reading: pages are read once, summary points and facts are drafted side by side, and the verifier waits for both.

The two branches are DataFrames from the same pages; the barrier is the union of what they give, so Spark runs them as it can. Progress is told by rows, too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.operators import review

#: The steps, and what each waits for.
STEPS = {"orchestrate": (), "reader": ("orchestrate",), "fact_extractor": ("orchestrate",), "verifier": ("reader", "fact_extractor")}


@dataclass(frozen=True)
class Result:
    cited: DataFrame
    facts: DataFrame
    issues: DataFrame
    states: DataFrame

    def progress(self) -> DataFrame:
        """(document_id, seq, step, items): what each step has given, in an order in which no step stands before one that it waits for."""
        every = self.states.select("document_id")
        counts = {"orchestrate": every, "reader": self.cited.select("document_id"), "fact_extractor": self.facts.select("document_id"), "verifier": self.issues.select("document_id")}
        order = in_order(STEPS)
        steps = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("seq"), F.lit(s).alias("step")) for k, s in enumerate(order))))
        told = None
        for step, rows in counts.items():
            one = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("items")).withColumn("step", F.lit(step))
            told = one if told is None else told.unionByName(one)
        return every.select("document_id", steps.alias("s")).select("document_id", "s.*").join(told, ["document_id", "step"], "left").na.fill(0, ["items"])


def in_order(steps: dict[str, tuple[str, ...]]) -> list[str]:
    out: list[str] = []
    while len(out) < len(steps):
        ready = [s for s, waits in steps.items() if s not in out and all(w in out for w in waits)]
        if not ready:
            raise ValueError("steps wait for each other")
        out += ready
    return out


def read_filings(documents: DataFrame, pages: DataFrame, points: DataFrame, facts: DataFrame) -> Result:
    """``documents``: document_id; ``pages``: document_id, page_number, text; ``points`` and ``facts`` are what the models have drafted (see operators.review)."""
    cited = review.cite_points(points, pages)
    found = review.issues(cited, facts, documents)
    return Result(cited, facts, found, review.states(cited, facts, found, documents))
