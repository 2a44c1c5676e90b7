"""Cross-tokenizer alignment against a plain version that encodes by the libraries and compares all pairs of tokens; both ways to the counts; pieces by words."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracefolio.llm import queries as llm_queries
from tracefolio.llm import token_align
from tracefolio.llm.common import byte_alphabet, tokenizer_path


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def spans(tokens: list) -> list:
    at, out = 0, []
    for k, raw in tokens:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def plain(rows: list, libraries) -> list:
    a_lib, b_lib = libraries
    back = {c: b for b, c in byte_alphabet().items()}
    found, holders = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            enc = a_lib.encode(" " + text, add_special_tokens=False)
            a = [(k, bytes(back[c] for c in t)) for k, t in zip(enc.ids, enc.tokens)]
            ids = b_lib.encode(text)
            b = [(k, bytes([int(p[3:5], 16)]) if b_lib.is_byte(k) else p.replace("▁", " ").encode()) for k, p in ((k, b_lib.id_to_piece(k)) for k in ids)]
            if not b"".join(x[1] for x in a) == b"".join(x[1] for x in b) == (" " + text).encode():
                a = b = []
        a, b = spans(a), spans(b)
        links, first = [], 0
        for k, x, y in a:
            while first < len(b) and b[first][2] <= x:
                first += 1
            j = first
            while j < len(b) and b[j][1] < y:
                links.append((k, b[j][0]))
                j += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for start, end in zip([0, *ends], ends):
            inside = lambda side: ",".join(str(k) for k, x, y in side if start <= x and y <= end)
            groups.append(f"{inside(a)}|{inside(b)}")
        found.append((doc_id, len(a), len(b), groups, links))
        holders.update(set(links))
    highest = defaultdict(int)
    for (k, _), n in holders.items():
        highest[k] = max(highest[k], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(holders[x] == highest[x[0]] for x in links), sum(holders[x] for x in links), sha))
    return sorted(out, key=str)


def got(df):
    assert tuple(df.columns) == token_align.COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


ROWS = [
    (1, "Hello world, it's tokenization of naïve words"), (1, "Hello world, it's tokenization of naïve words"), (None, "no id 12345"), (2, ""), (3, None), (4, "a▁b"),
    (5, "  two  spaces   and at the end   "), (6, " "), (7, "tabs\tand\r\nlines\n\n\n"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"), (9, "中文 é😀 \x00 İ ﬁ ½ ①"), (10, "x" * 3000 + " " * 500), (11, "ÀÉ 　  é"),
]


def test_against_a_plain_version_both_ways(spark, libraries):
    r = random.Random(3)
    words = ["data", "Data", "tokenizers", "l'été", "Straße", "42", "3.14", "don't", "\n", "  ", "ﬁx", "日本", "🙂", "-", "..."]
    rows = ROWS + [(100 + k, " ".join(r.choices(words, k=r.randrange(40)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows, libraries)
    assert got(token_align.align(df)) == want
    assert got(token_align.align(df, count_bytes=-1, shard_pairs=50)) == want
    assert got(token_align.align(df, shard_pairs=7)) == want


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as pair", "2 as row", "'x' as pairs", "null as times", "0 as n_a")
    assert len(got(token_align.align(df))) == len(ROWS)
    for size in (1 << 20, -1):
        assert got(token_align.align(df.where("false"), count_bytes=size)) == []
        assert [r[1:] for r in got(token_align.align(df.where("text is null"), count_bytes=size))] == [(0, 0, 0, 0, 0, 0, "")]


def test_pieces_by_words_are_the_librarys(libraries, spark, sf):
    pieces = token_align.Pieces(tokenizer_path("piece_bpe_32k.model"), most=50)
    texts = [t for _, t in ROWS if t] + ["a\nb", "\n\n a\n  b \n", "\n", " \n ", "x▁\ny"] + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text, (ids, same) in [(t, pieces.ids([t])[0]) for t in texts] + list(zip(texts, pieces.ids(texts))):
        assert ids.tolist() == libraries[1].encode(text) and same == ("▁" not in text)


def test_packed_numbers_and_run_sums():
    numbers = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000))
    assert token_align.unpack(token_align.pack(numbers)).tolist() == numbers.tolist()
    assert token_align.unpack(token_align.pack(numbers[:0])).tolist() == []
    k, n = token_align.run_sums(np.array([1, 1, 4, 9, 9, 9]), np.array([2, 3, 1, 1, 1, 5]))
    assert (k.tolist(), n.tolist()) == ([1, 4, 9], [5, 1, 7])
    assert [x.tolist() for x in token_align.run_sums(k[:0], n[:0])] == [[], []]


def test_a_long_text(spark, libraries):
    rows = [(1, "lorem ipsum dolor " * 30_000), (2, "y" * 400_000)]
    assert [x[0] for x in got(token_align.align(spark.createDataFrame(rows, "doc_id long, text string")))] == [1, 2]


def test_query_against_the_plain_version(spark, sf, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(llm_queries.QUERIES["op13_token_align"](spark, sf)) == plain(rows, libraries)
