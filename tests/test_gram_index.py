"""Quotes by grams: equal to all pairs, for thousands of quotes, short and Chinese ones too; what is moved does not grow with the number of quotes."""

import random
import re

import pytest

from tracefolio.operators import documents, evidence, gram_index


@pytest.fixture(scope="module")
def tables():
    r = random.Random(11)
    latin = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(300)]
    han = "营业收入净利润资产负债总额同比增长下降百分点公司本年度报告期内现金流量"
    pages = []
    for k in range(120):
        lines = [" ".join(r.choices(latin, k=r.randrange(1, 9))) if r.random() < 0.7 else "".join(r.choices(han, k=r.randrange(3, 30))) for _ in range(25)]
        pages.append((k if k % 40 else None, r.choice(["\n", "\r\n"]).join(lines)))
    pages += [pages[5], (7, None), (8, ""), (9, "Ａｂｃ　ΤΕΛΟΣ ﬁne" * 3)]
    quotes = []
    for k in range(3000):
        text = r.choice(pages)[1] or "nothing at all"
        a = r.randrange(len(text))
        piece = text[a : a + r.choice([6, 8, 11, 12, 13, 40, 120])]
        kind = r.random()
        if kind < 0.3:
            piece = r.choice(latin) + "x " + piece + " ... " + " ".join(r.choices(latin, k=3))
        elif kind < 0.5:
            piece = piece.upper() + r.choice("；;。") + (r.choice(pages)[1] or "")[:30]
        elif kind < 0.6:
            piece = " ".join(r.choices(latin, k=4))
        quotes.append((k % 2900, piece))
    return quotes + [(1, None), (2, ""), (3, "a"), (None, "Abcτελος")], pages


@pytest.mark.parametrize("most", [None, 0])
def test_citations_equal_all_pairs(spark, tables, monkeypatch, most):
    quotes, pages = tables
    if most is not None:
        monkeypatch.setattr(gram_index, "MOST_PAIRS", most)
        monkeypatch.setattr(gram_index, "MOST_TERMS", most)
        quotes, pages = quotes[:300] + quotes[-4:], pages[:40]
    got = documents.cite(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(pages, "doc_id long, text string").repartition(4)).collect()
    folded = [(d, t, documents.even(documents.Page(t).text), {documents.even(documents.Page(t).window(*w)) for w in documents.Page(t).windows()}) for d, t in pages]
    want = []
    for i, q in quotes:
        needles = [documents.even(n) for n in documents.sought(q)]
        for d, t, text, windows in folded:
            # a plain form of what any tier needs, so that all pairs can be tried
            if any(n in text or any(len(w) >= 12 and w in n for w in windows) for n in needles) and (f := documents.find_quote(t, q)):
                want.append((i, d, f))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > len(quotes) / 4


def test_quoted_pages_equal_all_pairs(spark, tables):
    quotes, pages = tables
    got = evidence.quote_pages(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(pages, "doc_id long, text string")).collect()
    compact = lambda t: re.sub(r"\s+", "", t or "").lower()
    want = [(i, d) for i, q in quotes for d, t in pages if len(compact(q)) >= 6 and compact(q) in compact(t)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 500


def test_a_text_of_twelve_characters_has_a_mark_of_every_page_that_holds_it():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choices("abc", k=60))
        a = r.randrange(40)
        needle = text[a : a + r.randrange(12, 20)]
        assert set(gram_index.least(gram_index.grams(needle))) <= set(gram_index.least(gram_index.grams(text)))
        assert gram_index.least(gram_index.grams(text))[a] == gram_index.least(gram_index.grams(text[a : a + 12]))[0]
    assert len(gram_index.grams("abcde")) == 0 and len(gram_index.grams("abcdef")) == 1 and len(gram_index.least(gram_index.grams("abcdefghijk"))) == 0


def test_the_table_is_made_once_and_candidates_are_few(spark, tables, tmp_path, monkeypatch):
    quotes, pages = tables
    path = f"file://{tmp_path}/pages"
    spark.createDataFrame(pages, "doc_id long, text string").write.parquet(path)
    made = []
    page_grams = gram_index.page_grams
    monkeypatch.setattr(gram_index, "page_grams", lambda *a, **k: made.append(k) or page_grams(*a, **k))
    sought = lambda q: [documents.even(n) for n in documents.sought(q)]
    long = [(i, q) for i, q in quotes if q and all(len(n) >= 12 for n in documents.sought(q))]
    n = []
    for some in (long[:200], long):
        found = gram_index.candidates(spark.createDataFrame(some, "quote_id long, quote string"), spark.read.parquet(path), sought, documents.spelled_page, "test")
        n.append(found.count())
    assert len(made) == 1
    assert n[1] < 0.1 * len(long) * len(pages)


def test_a_build_moves_nothing(spark, tables, monkeypatch):
    plans = []
    index_once = gram_index.index_once

    def kept(spark, folder, key, build):
        plans.append(build()._jdf.queryExecution().executedPlan().toString())
        return index_once(spark, folder, key, build)

    monkeypatch.setattr(gram_index, "index_once", kept)
    quotes, pages = tables
    evidence.quote_pages(spark.createDataFrame(quotes[:20], "quote_id long, quote string"), spark.createDataFrame(pages[:20], "doc_id long, text string"))
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_a_page_is_folded_once_for_its_quotes(tables, monkeypatch):
    quotes, pages = tables
    made, plain = [], documents.Page
    monkeypatch.setattr(documents, "Page", lambda t: made.append(t) or plain(t))
    documents.page_of.cache_clear()
    for _, q in quotes[:50]:
        documents.find_quote(pages[3][1], q)
    assert len(made) == 1
    # a window in a needle: as by trying them all
    for _, t in pages[:30]:
        p = plain(t)
        for _, q in quotes[:60]:
            needle = documents.folded(q) + p.text[:40]
            least = max(documents.LEAST_WINDOW, len(needle) // 2)
            assert p.inside(needle) == next((w for w in p.windows() if least <= len(p.window(*w)) <= len(needle) and p.window(*w) in needle), None)
