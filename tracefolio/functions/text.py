"""Text functions. White space is Unicode's, as in ``str.split``; lengths are in code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters at which ``str.splitlines`` ends a line.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACES = "(?U)\\s+"
SPACE_EDGES = "(?U)^\\s+|\\s+$"

#: Runs of ideographs; words with inner - or _; numbers with inner . or , and a trailing %.
BM25_TOKEN = r"[㐀-鿿豈-﫿]+|[A-Za-z]+(?:[-_][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*%?"
IDEOGRAPH = r"^[㐀-鿿豈-﫿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_EDGES, "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs to one blank, none at the edges."""
    return strip(F.regexp_replace(c, SPACES, " "))


def compact(c: Column) -> Column:
    """Lower case without any white space: the native match normaliser. White space goes first, for a sigma is lowered by whether a letter follows."""
    return F.lower(F.regexp_replace(c, SPACES, ""))


@F.pandas_udf(StringType())
def nfkc_compact(s: pd.Series) -> pd.Series:
    """NFKC, no white space, lower case."""
    return s.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()).lower())


# Punctuation that counts for nothing when quotes are compared.
UNSEEN = str.maketrans("", "", ",.;:，。；：()[]{}<>％%/\\-—_")


def folded(text: str) -> str:
    """NFKC, without white space and punctuation, in lower case: how quotes and pages are compared."""
    return "".join(unicodedata.normalize("NFKC", text).split()).lower().translate(UNSEEN)


@F.pandas_udf(StringType())
def nfkc_letters(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else folded(t))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


def truncate(c: Column, limit: int, mark: str = "...") -> Column:
    """At most ``limit`` characters, with ``mark`` at the end of what is cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.substring(c, 1, limit - len(mark))), F.lit(mark)))


def preview(c: Column, limit: int = 180) -> Column:
    return rstrip(F.substring(collapse(c), 1, limit))


def lines(c: Column) -> Column:
    """Lines, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(c, LINE_ENDS, -1), strip), lambda x: x != "")


def bm25_tokens(c: Column) -> Column:
    """Tokens for BM25 in the text's order; ideographs as overlapping pairs (one alone stays)."""

    def spread(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: t.substr(i, F.lit(2)))
        return F.when(t.rlike(IDEOGRAPH), pairs).otherwise(F.array(F.lower(t)))

    return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(BM25_TOKEN), F.lit(0)), spread))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """Those terms, in their order, that the text has; both compacted."""
    # one expression a term, not a lambda: the text is compacted once
    return F.array_compact(F.array(*(F.when(F.contains(compact(text), F.lit("".join(t.lower().split()))), F.lit(t)) for t in terms)))


def windows(lines_: Column, most: int = 3) -> Column:
    """array<struct<i, n, text>>: 1 to ``most`` consecutive lines, by start, then length. ``lines_`` should be a column of its own, for a lambda computes it anew for every element."""

    def at(i: Column) -> Column:
        rows = [F.when(i + n <= F.size(lines_), F.struct(i.alias("i"), F.lit(n).alias("n"), F.concat_ws(" ", F.slice(lines_, i + 1, F.lit(n))).alias("text"))) for n in range(1, most + 1)]
        return F.array_compact(F.array(*rows))

    return F.when(F.size(lines_) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines_) - 1), at))).otherwise(F.array().cast("array<struct<i:int,n:int,text:string>>"))


def context(lines_: Column, i: Column, before: int, after: int) -> Column:
    """Lines i - before to i + after, clipped."""
    first = F.greatest(i - before, F.lit(0))
    return F.slice(lines_, first + 1, F.least(i + after, F.size(lines_) - 1) - first + 1)


def snippets(text: Column, terms: list[str], most: int = 2, limit: int = 260) -> Column:
    """Around the first lines with a term: the line and its neighbours, joined by `` / ``."""
    ls = lines(text)
    hit = lambda l: F.array_size(matched_terms(l, terms)) > 0
    places = F.filter(F.transform(ls, lambda l, i: F.when(hit(l), i)), lambda i: i.isNotNull())
    return F.transform(F.slice(places, 1, most), lambda i: truncate(F.concat_ws(" / ", context(ls, i, 1, 1)), limit))


def deltas(text: Column, size: int = 36) -> Column:
    """The stripped text in parts of ``size`` characters; none of an empty one."""
    t = strip(text)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda k: t.substr(k * size + 1, F.lit(size)))
    return F.when(F.length(t) > 0, parts).otherwise(F.array().cast("array<string>"))
