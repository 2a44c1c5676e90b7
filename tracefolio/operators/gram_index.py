"""Which pages may hold a needle, by a stored table of grams; no page meets a needle that it shares no gram with.

A *gram* is the hash of GRAM characters after each other, and of each SPAN grams after each other the least one is *marked*. What is marked goes by the SPAN + GRAM - 1 = 12
characters alone, so a text of twelve characters or more that stands in a page has all its marks among the page's: one of them, the rarest, finds every such page. The table has, for each
page, its marks, and the marks of the first twelve characters of each line (``begins``), which find needles that a window of lines stands in. Marks are written as their upper 32 bits, a page's
in one row where the page lies: a build moves nothing, and what is taken for another gram is matched in vain.

Needles of less than twelve characters are looked up by their first GRAM characters among all grams of the pages; these are made in the scan and filtered there, and are not stored.

What is moved are grams that needles ask for, and pairs of ids; how many needles there are does not multiply the pages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.operators.retrieval import MOST_TERMS
from tracefolio.session import content_key, settle, shared_dir, small_batches
from tracefolio.sources.artifacts import index_once

GRAM, SPAN = 6, 7
LONG = GRAM + SPAN - 1
#: Fixed multipliers, odd.
FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 % (1 << 64) | 1 for k in range(GRAM)], np.uint64)
MIX = np.uint64(0xD6E8FEB86659FD93)


def grams(text: str) -> np.ndarray:
    """The hash of every GRAM characters after each other."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = sum((c[k : k + n] * FACTORS[k] for k in range(GRAM)), np.zeros(n, np.uint64))
    h = (h ^ (h >> np.uint64(29))) * MIX
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def least(hashes: np.ndarray) -> np.ndarray:
    """The least of every SPAN hashes after each other, by their place."""
    return np.lib.stride_tricks.sliding_window_view(hashes, SPAN).min(axis=1) if len(hashes) >= SPAN else hashes[:0]


def written(hashes: np.ndarray) -> np.ndarray:
    """Each once, as they are stored."""
    return np.unique((hashes >> 32).astype(np.int32))


def page_grams(pages: DataFrame, spell: Callable[[str], tuple[str, list[int]]], every: bool = False) -> DataFrame:
    """(doc_id, begins, grams) of (doc_id, text): the marks, or with ``every`` all grams. ``spell`` gives a page's text as it is compared, and where its lines begin, if one of these may stand in a needle."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found, ids, begins = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    spelled, starts = spell(text)
                    h = grams(spelled)
                    low = least(h)
                    for values, first in ((written(h if every else low), False), (written(low[[s for s in starts if s < len(low)]]) if not every else low[:0], True)):
                        if len(values):
                            found.append(values)
                            begins.append(first)
                            ids.append(doc_id)
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.bool_()), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "begins", "grams"])

    return small_batches(pages.select("doc_id", "text")).mapInArrow(run, "doc_id long, begins boolean, grams array<int>")


def spread(rows: DataFrame) -> DataFrame:
    """doc_id, begins, gram."""
    return rows.select("doc_id", "begins", F.explode("grams").alias("gram"))


def needle_grams(needles: DataFrame, sought: Callable[[str], list[str]]) -> DataFrame:
    """(quote_id, needle, gram, long) of (quote_id, quote): all marks of each needle of twelve characters or more, the first gram of a shorter one."""
    from tracefolio.operators.documents import each

    def make(row: tuple) -> list[tuple]:
        out = []
        for n in sought(row[1]) if row[1] else []:
            h = grams(n)
            # by the needle itself, for several quotes may have one id
            k = int.from_bytes(hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            marks = written(least(h) if len(n) >= LONG else h[:1])
            out += [(row[0], k, int(g), len(n) >= LONG) for g in marks]
        return out

    return each(needles, ["quote_id", "quote"], make, "quote_id long, needle long, gram int, long boolean")


def candidates(quotes: DataFrame, pages: DataFrame, sought: Callable[[str], list[str]], spell: Callable[[str], tuple[str, list[int]]], label: str) -> DataFrame:
    """(quote_id, doc_id), each once: every pair in which the page has a needle of the quote, or a needle has one of the page's windows; and some more. Needles have GRAM characters or more."""
    spark = pages.sparkSession
    stored = index_once(spark, f"{shared_dir(spark)}/tracefolio/grams", f"{label}-rows-{content_key(pages)}", lambda: page_grams(pages, spell))
    needles = settle(needle_grams(quotes, sought), "needles")
    asked = needles.where("long").select("gram").distinct()
    held = settle(spread(stored).join(near(asked), "gram", "left_semi"), "held-grams")
    marks = held.where("not begins").select("gram", "doc_id")
    rare = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    counted = needles.where("long").join(marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    # a needle with a mark that no page has stands in no page
    rarest = counted.groupBy("quote_id", "needle").agg(F.min(rare).alias("r")).where("r.n > 0").select("quote_id", F.col("r.gram").alias("gram"))
    whole = near(rarest).join(marks, "gram").select("quote_id", "doc_id")
    windows = near(needles.where("long").select("quote_id", "gram")).join(held.where("begins").select("gram", "doc_id"), "gram").select("quote_id", "doc_id")
    out = whole.unionByName(windows)
    short = needles.where("not long").select("quote_id", "gram")
    if not short.isEmpty():
        out = out.unionByName(spread(page_grams(pages, spell, every=True)).join(near(short), "gram").select("quote_id", "doc_id"))
    return settle(out.distinct(), "candidates")


def meet(found: DataFrame, quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, doc_id, quote, text) of candidate pairs; rows of equal ids each. Texts move only if there are more pairs than can be sent to them."""
    named = found.select(F.col("quote_id").alias("q"), F.col("doc_id").alias("d"))
    few = quotes.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS
    if not few:
        named = named.join(quotes.select("quote_id", "quote"), F.col("q").eqNullSafe(F.col("quote_id"))).select("quote_id", "quote", "d")
    met = pages.select("doc_id", "text").join(near(named), F.col("d").eqNullSafe(F.col("doc_id")))
    # ids alone go to the pages, and quotes to what has met
    met = met.join(F.broadcast(quotes.select("quote_id", "quote")), F.col("q").eqNullSafe(F.col("quote_id"))) if few else met
    return met.select("quote_id", "doc_id", "quote", "text")


#: Quotes, or pairs with their quotes, that are sent to every task, at most.
MOST_PAIRS = 50_000


def near(df: DataFrame) -> DataFrame:
    """Sent to every task where it has few rows, else shuffled."""
    most = MOST_PAIRS if "quote" in df.columns else MOST_TERMS
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
