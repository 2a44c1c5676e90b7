"""Whole-document transforms: chunks and fuzzy citations. One document at a time, wherever it lies; none needs another's rows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from tracefolio.functions.text import folded
from tracefolio.operators import gram_index

LINE_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def each(df: DataFrame, columns: list[str], make: Callable[[tuple], list[tuple]], schema: str) -> DataFrame:
    """Rows from every row's ``columns`` by a Python function, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                rows = [r for row in zip(*(part.column(k).to_pylist() for k in range(part.num_columns))) for r in make(row)]
                cols = list(zip(*rows)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def split_lines(text: str | None) -> list[str]:
    return [x.strip() for x in LINE_ENDS.split(text or "") if x.strip()]


# --- chunks ----------------------------------------------------------------------------------------------------------

WORD = re.compile(r"\s*\S+")
SENTENCE = re.compile(r"[.!?。！？](?=\s|$)|[。！？]|\n")


def chunk_text(text: str | None, size: int = 800, overlap: int = 120) -> list[tuple[int, int]]:
    """Spans of at most ``size`` words that end at a sentence's end where there is one in their last half; each begins ``overlap`` words before the end of the one before.

    Our own contract (words, not another library's tokens): spans are in order, together they cover every word, and a blank text has none.
    """
    words = [m.span() for m in WORD.finditer(text or "")]
    ends = {i for i, (_, b) in enumerate(words) if SENTENCE.search(text, b - 1, b + 1)}
    out, at, stop = [], 0, 0
    while at < len(words):
        least, stop = max(at + size // 2, stop - 1), min(at + size, len(words))
        if stop < len(words):
            stop = next((i + 1 for i in range(stop - 1, least, -1) if i in ends), stop)
        out.append((words[at][0], words[stop - 1][1]))
        if stop == len(words):
            break
        at = max(stop - overlap, at + 1)
    return out


def chunks(pages: DataFrame, key: str = "doc_id", size: int = 800, overlap: int = 120) -> DataFrame:
    """key, chunk_index, start, end, text."""
    make = lambda r: [(r[0], i, a, b, r[1][a:b].strip()) for i, (a, b) in enumerate(chunk_text(r[1], size, overlap))]
    return each(pages, [key, "text"], make, f"{key} long, chunk_index long, start long, end long, text string")


# --- citations -------------------------------------------------------------------------------------------------------


#: Characters that a quote has at least, a clause of it, and a window of lines that stands in one.
LEAST, LEAST_CLAUSE, LEAST_WINDOW, WINDOW_LINES, SHOWN = 6, 10, 12, 3, 240


def shown(text: str, most: int = SHOWN) -> str:
    return text if len(text) <= most else text[: most - 3].rstrip() + "..."


class Page:
    """A page's folded text with the place at which each of its lines begins, so that a window of lines is a piece of it."""

    def __init__(self, text: str | None):
        self.lines = split_lines(text)
        parts = [folded(x) for x in self.lines]
        self.text = "".join(parts)
        self.starts = [0, *accumulate(map(len, parts))]
        self.heads = [self.text[s : s + LEAST_WINDOW] for s in self.starts[:-1]]

    def window(self, i: int, n: int) -> str:
        return self.text[self.starts[i] : self.starts[i + n]]

    def windows(self) -> Iterator[tuple[int, int]]:
        """(first line, lines) of the windows, by their first line, then by length."""
        return ((i, n) for i in range(len(self.lines)) for n in range(1, min(WINDOW_LINES, len(self.lines) - i) + 1))

    def spelled(self, at: tuple[int, int]) -> str:
        return shown(" ".join(self.lines[at[0] : at[0] + at[1]]))

    def around(self, needle: str) -> tuple[int, int] | None:
        """The first window that holds the needle."""
        at = self.text.find(needle)
        while at >= 0:
            first, last = bisect_right(self.starts, at) - 1, bisect_left(self.starts, at + len(needle)) - 1
            if last - first < WINDOW_LINES:
                i = max(0, last - WINDOW_LINES + 1)
                return i, last - i + 1
            at = self.text.find(needle, at + 1)
        return None

    def inside(self, needle: str) -> tuple[int, int] | None:
        """The first window that the needle holds, if it is half of it and no mere word."""
        least = max(LEAST_WINDOW, len(needle) // 2)
        # a window in the needle has its first characters there
        near = ((i, n) for i, head in enumerate(self.heads) if head in needle for n in range(1, min(WINDOW_LINES, len(self.lines) - i) + 1))
        return next((w for w in near if least <= self.starts[w[0] + w[1]] - self.starts[w[0]] <= len(needle) and self.window(*w) in needle), None)


def find_quote(page: str | None, quote: str | None) -> str | None:
    """The quote as the page has it, null if it hasn't.

    The quote and its parts between ellipses are tried, the longest first: one that the page holds is given as it is; else the first window of
    up to three lines that is half of it or more. Else two or more of its clauses have to be found in windows, which are given one after the other.
    """
    p, (parts, clauses) = page_of(page), tiers(quote or "")
    for part, needle in parts:
        if needle in p.text:
            return shown(part)
        if at := p.inside(needle):
            return p.spelled(at)
    found = [p.spelled(min(w)) for c in clauses if (w := [x for x in (p.around(c), p.inside(c)) if x])] if len(clauses) > 1 else []
    return shown(" ".join(dict.fromkeys(found))) if len(found) > 1 else None


@lru_cache(maxsize=2)
def page_of(text: str | None) -> Page:
    """The pairs of a page come after each other."""
    return Page(text)


@lru_cache(maxsize=1000)
def tiers(quote: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The quote's parts, the longest first, each as it is and folded; and its clauses, folded."""
    parts = [(part, needle) for part in by_length(quote) if len(needle := folded(part)) >= LEAST]
    return parts, [f for f in map(folded, re.split("[;；。]", quote)) if len(f) >= LEAST_CLAUSE]


def by_length(quote: str) -> list[str]:
    """The quote and its parts between ellipses, longest first, each once."""
    return sorted(dict.fromkeys(x for x in map(str.strip, [quote, *re.split(r"\.{3,}|…+", quote)]) if x), key=len, reverse=True)


def sought(quote: str | None) -> list[str]:
    """What a tier of ``find_quote`` looks for, folded: the quote, its parts between ellipses, its clauses."""
    parts, clauses = map(folded, by_length(quote or "")), map(folded, re.split("[;；。]", quote or ""))
    return sorted({p for p in parts if len(p) >= LEAST} | {c for c in clauses if len(c) >= LEAST_CLAUSE})


def even(text: str) -> str:
    """``lower`` writes a sigma by what stands after it, which a window's end and a page's middle tell otherwise."""
    return text.replace("ς", "σ")


def spelled_page(text: str) -> tuple[str, list[int]]:
    """A page as quotes are looked for in it, and where lines begin that a window of LEAST_WINDOW characters begins with."""
    p = Page(text)
    return even(p.text), [s for s, e in zip(p.starts, p.starts[WINDOW_LINES:] + [p.starts[-1]] * WINDOW_LINES) if e - s >= LEAST_WINDOW]


def cite(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, quote) and (doc_id, text) to quote_id, doc_id, found, for all pairs that ``find_quote`` finds.

    Pages are found by the grams of the needles (``gram_index``), and pairs that share one are matched.
    """
    asked = quotes.select("quote_id", "quote").where("quote is not null")
    found = gram_index.candidates(asked, pages, lambda q: [even(n) for n in sought(q)], spelled_page, "folded")
    make = lambda r: [(r[0], r[1], f)] if (f := find_quote(r[3], r[2])) else []
    return each(gram_index.meet(found, asked, pages), ["quote_id", "doc_id", "quote", "text"], make, "quote_id long, doc_id long, found string")
