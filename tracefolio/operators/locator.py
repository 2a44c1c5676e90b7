"""Candidate pages: which pages of a report may hold which field. The lexicon is a parameter; scores are native expressions, one pass over the pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefolio.functions.text import compact, truncate


@dataclass(frozen=True)
class Lexicon:
    """Terms by role. ``fields`` names each field's own terms; ``front`` how many first pages it has a claim on; ``paired`` the field whose terms speak for it."""

    fields: dict[str, tuple[str, ...]]
    shared: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    balance: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    periods: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    paired: dict[str, str] = field(default_factory=dict)
    front: dict[str, int] = field(default_factory=dict)


def found(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms the compacted text has."""
    return sum((F.contains(text, compact(F.lit(t))).cast("int") for t in terms), F.lit(0))


def some(text: Column, terms: tuple[str, ...]) -> Column:
    return found(text, terms) > 0


def shared_score(text: Column, front: Column, lex: Lexicon) -> Column:
    """Eight a summary term; three on a front page or in a table's context; one for units and periods."""
    one = lambda test, n: F.when(test, n).otherwise(0)
    return 8 * found(text, lex.shared) + one(front, 3) + one(some(text, lex.context), 3) + one(some(text, lex.units), 1) + one(some(text, lex.periods), 1)


def field_score(text: Column, name: str, front: Column, early: Column, lex: Lexicon) -> Column:
    """Ten a term of the field; what stands around it counts only with one. Null where the page is no candidate."""
    one = lambda test, n: F.when(test, n).otherwise(0)
    own = found(text, lex.fields[name])
    score = one(front, 2) + 10 * own
    if name in lex.metrics:
        around, units, periods = some(text, lex.context), some(text, lex.units), some(text, lex.periods)
        partner = some(text, lex.fields[lex.paired[name]]) if name in lex.paired else F.lit(False)
        extra = one(around, 4) + one(units, 2) + one(periods, 1) + one(early & (units | periods) & (around | partner), 8)
        if name in lex.paired:
            extra = extra + one(some(text, lex.balance), 5) + one(partner, 3)
        score = score + F.when(own > 0, extra).otherwise(0)
    elif name == "unit":
        score = score + one(some(text, lex.units), 4)
    elif name == "fiscal_period":
        score = score + one(some(text, lex.periods), 4)
    return F.when((own > 0) | front, score)


def locate(pages: DataFrame, lex: Lexicon, *, by: str, order: str, top_shared: int = 4, top_field: int = 5, early: int = 30) -> DataFrame:
    """(by, order, text) to by, field, order, score, pos: for each field the front pages, then the best ones, each once. ``shared`` is a field of its own."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    numbered = pages.select(by, order, compact(F.coalesce("text", F.lit(""))).alias("t"), place.alias("place"))
    fronts = {"shared": 2} | {f: lex.front.get(f, 0) for f in lex.fields}
    score = {"shared": shared_score(F.col("t"), F.col("place") <= 2, lex)} | {f: field_score(F.col("t"), f, F.col("place") <= fronts[f], F.col("place") <= early, lex) for f in lex.fields}
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), s.cast("int").alias("score"), F.lit(fronts[f]).alias("front")) for f, s in score.items())))
    long = numbered.select(by, order, "place", rows.alias("r")).select(by, order, "place", "r.*")
    best = F.row_number().over(Window.partitionBy(by, "field").orderBy(F.desc(F.coalesce("score", F.lit(0))), order))
    top = F.when(F.col("field") == "shared", top_shared).otherwise(top_field)
    ranked = long.withColumn("best", best)
    kept = ranked.where((F.col("place") <= F.col("front")) | ((F.col("best") <= top) & (F.coalesce("score", F.lit(0)) > 0)))
    pos = F.row_number().over(Window.partitionBy(by, "field").orderBy(F.when(F.col("place") <= F.col("front"), F.col("place")).otherwise(F.lit(1 << 20) + F.col("best"))))
    return kept.withColumn("pos", pos).select(by, "field", order, F.coalesce("score", F.lit(0)).alias("score"), "pos")


def table_page_score(text: Column, contexts: tuple[str, ...], metrics: tuple[str, ...], balance: tuple[str, ...], english: tuple[str, ...]) -> Column:
    """Four a context term, two a metric term, four for any term of each balance-sheet family."""
    t = compact(text)
    return 4 * found(t, contexts) + 2 * found(t, metrics) + F.when(some(t, balance), 4).otherwise(0) + F.when(some(t, english), 4).otherwise(0)


def snippet(text: Column, term: str, reach: int = 90) -> Column:
    """The text around the first place of a term."""
    at = F.instr(F.lower(text), term.lower())
    return F.when(at > 0, truncate(F.substring(text, F.greatest(at - reach, F.lit(1)), 2 * reach + len(term)), 2 * reach + len(term)))
