"""Source audit: against a plain version with whole numbers of any size, over many sources in small blocks; SQL; edges."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tracefolio.llm import queries as llm_queries
from tracefolio.llm import source_audit


def plain(rows: list, least: int, ranks: int) -> list:
    """(lang, source, text) to the audit's rows."""
    n, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in seen:
        terms = [t for t, k in seen[lang].items() if k >= least]
        v, sources = len(terms), sorted(s for a, s in n if a == lang)
        total = Counter({t: sum(n[lang, s][t] for s in sources) for t in terms})

        def p(counts, big_n):
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (big_n + 5 * v) for t in terms}

        q = p(total, sum(total.values()))
        of = {s: p(n[lang, s], sum(n[lang, s][t] for t in terms)) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(of[s][t] - of[o][t]) for t in terms)) for o in sources if o != s]
            above = [(t, of[s][t] - q[t]) for t in terms if n[lang, s][t] and of[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", above, ranks)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [3, source_audit.BLOCK])
def test_against_a_plain_version(spark, block):
    r = random.Random(5)
    words = ["Alpha", "beta", "ÉCOLE", "école", "中文", "naïve", "x-ray", "don't"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(400):
        source = r.choice(["", None, "hot", "hot", "hot"] + [f"s{j}" for j in range(11)])
        own = r.sample(words, 12) if source == "hot" else words[: 8 + 5 * (hash(str(source)) % 3)]
        rows.append((r.choice(["en", "fr", None]), source, None if r.random() < 0.05 else " ".join(r.choices(own, k=r.randrange(30)))))
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(source_audit.audit(df, min_docs=6, term_ranks=7, block=block)) == plain(rows, 6, 7)


def test_groups_without_terms_and_single_sources(spark):
    rows = [("de", "a", "only once"), ("de", "b", None), ("de", "c", "12 34"), ("es", "lone", "uno uno dos"), ("es", "lone", "uno")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'x' as term", "2 as sid", "null as p0", "4L as docs")
    assert got(source_audit.audit(df, min_docs=2)) == plain(rows, 2, 50)
    assert [x[4] for x in got(source_audit.audit(df, min_docs=2)) if x[0] == "de"] == [0] * 6
    assert got(source_audit.audit(df.where("false"))) == []


def test_ties_repeats_and_long_texts(spark):
    rows = [("en", s, t) for s, t in [("a", "bb aa"), ("a", "bb aa"), ("b", "cc dd " * 50_000), ("c", "z" * 300_000 + " aa"), ("c", "Z" * 300_000), ("d", "é É")]]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(source_audit.audit(df, min_docs=1, term_ranks=1)) == plain(rows, 1, 1)


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(9_999_999_999, 123_456_789_012_345, 30_000_011)], "c long, n long, v long")
    assert df.select(source_audit.share(F.col("c"), F.col("n"), F.col("v"))).collect()[0][0] == 1 + 1_000_000_000 * (9_999_999_999 + 5) // (123_456_789_012_345 + 5 * 30_000_011)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = llm_queries.QUERIES["op11_source_audit"](spark, sf)
    cursor = con.execute(llm_queries.ORACLES["op11_source_audit"])
    assert [d[0] for d in cursor.description] == df.columns and got(df) == sorted(cursor.fetchall())
