import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefolio.llm import bpe_prefix, packing, token_planes
from tracefolio.llm.common import fast_tokenizer, tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.mark.parametrize("name,lower", [(BYTE, False), (WORD, True)])
def test_memo_equals_library(spark, sf, name, lower):
    tok = fast_tokenizer(tokenizer_path(name), lower)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    random.seed(3)
    parts = ["the", " The", "'s", "'S", "é", "É", "_", "a_b", "12", " 12", "3.5", "!?", "  ", "\n", "\t x", "<|endoftext|>", "ñandú", "ÀÉ", "²", "ª", "中", "😀", "İ", "\x1f", "\x85", "́", "œ", "-"]
    texts += ["".join(random.choice(parts) for _ in range(random.randrange(12))) for _ in range(3000)]
    for t in texts:
        assert tok.ids(t).tolist() == tok.whole.encode(t, add_special_tokens=False).ids, repr(t[:80])


@pytest.mark.parametrize("name,lower,ids", [(BYTE, False, [31373, 220, 50256, 995]), (WORD, True, [3306, 49407, 1002])])
def test_added_tokens_are_the_library_s(name, lower, ids):
    from tokenizers import Tokenizer

    tok, fresh = fast_tokenizer(tokenizer_path(name), lower), Tokenizer.from_file(tokenizer_path(name))
    assert tok.ids("hello <|endoftext|> world").tolist() == ids
    random.seed(4)
    parts = ["the", " The", "'s", "é", "12", "!?", " ", "\n", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "中"]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randrange(9)))
        assert tok.ids(t).tolist() == fresh.encode(t, add_special_tokens=False).ids, repr(t)


def test_planes_and_packing_hold_added_tokens(spark):
    from tokenizers import Tokenizer

    texts = [(1, "hello <|endoftext|> world"), (2, "plain text. "), (3, "<|startoftext|>A b. C<|endoftext|>"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for name, key, got in ((BYTE, "n_tokens", token_planes.token_planes(docs)), (WORD, "doc_tokens", packing.pack_documents(docs))):
        fresh = Tokenizer.from_file(tokenizer_path(name))
        want = {d: len(fresh.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts}
        assert {r["doc_id"]: r[key] for r in got.collect()} == want


@pytest.mark.parametrize("bits", [8, 1])
@given(ids=st.lists(st.integers(0, 70_000), max_size=300), block=st.integers(1, 64))
@settings(max_examples=40, deadline=None)
def test_segment_round_trip(bits, ids, block):
    a = np.array(ids, np.int64)
    cut = len(ids) // 2
    s = token_planes.Segment(token_planes.write_segment([7, -3], [cut, len(ids) - cut], a, block=block, bits=bits))
    assert s.read_ids().tolist() == ids and s.doc_ids.tolist() == [7, -3] and s.lengths.tolist() == [cut, len(ids) - cut]
    assert s.read_ids(cut // 2, cut).tolist() == ids[cut // 2 : cut]


@pytest.mark.parametrize("segment_ids,bits", [(2_000_000, 8), (5_000, 1)])
def test_planes_against_the_library(spark, sf, segment_ids, bits):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in token_planes.token_planes(docs, segment_ids=segment_ids, bits=bits).collect()}
    tok, at = fast_tokenizer(tokenizer_path(BYTE), False).whole, 0
    for doc_id, text in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def brute(cuts, pen, size):
    """The cheapest chain, by trying every earlier cut."""
    last, best = cuts[-1], []
    f = {0: 0.0}
    for c, p in zip(cuts, pen):
        f[c] = min(f[i] + size - (c - i) for i in f if c - i <= size and i < c) + p
    ends = [c for c in [0, *cuts] if last - c < size]
    return min(f[c] for c in ends) if ends else best


@given(gaps=st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 2.0, 5.0])), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_programme_is_optimal(gaps):
    cuts, size = np.cumsum([g for g, _ in gaps]), 12
    chain, cost = packing.best_cuts(cuts, np.array([p for _, p in gaps]), size)
    assert cost == pytest.approx(brute(cuts.tolist(), [p for _, p in gaps], size))
    edges = [0, *chain]
    assert all(0 < b - a <= size for a, b in zip(edges, edges[1:])) and cuts[-1] - edges[-1] < size


@pytest.mark.parametrize("size,block", [(2048, 1 << 19), (64, 1000), (100, 300)])
def test_packing_is_whole(spark, sf, size, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack_documents(docs, size=size, block=block).collect()
    tok = fast_tokenizer(tokenizer_path(WORD), True).whole
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at, windows = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0)
        at[r["doc_id"]] = r["start"] + r["length"]
        ids = np.array([*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(at) == set(texts)
    used = 0
    for parts in windows.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= size
        used += place
    assert set(windows) == set(range(len(windows)))
    assert used / (len(windows) * size) > (0.98 if size == 2048 else 0.7)


def test_the_programme_closes_all_windows_but_one_in_any_number_of_tasks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tok, texts = fast_tokenizer(tokenizer_path(WORD), True), {r["doc_id"]: r["text"] for r in docs.collect()}
    ends, ids = packing.sentence_ends(tok.whole), {k: np.append(tok.ids(t), 1).astype(np.int64) for k, t in texts.items()}
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            windows: dict[int, list] = {}
            for r in packing.pack_documents(docs).collect():
                windows.setdefault(r["sequence_id"], []).append(r)
            last = [max(w, key=lambda r: r["offset"]) for w in windows.values()]
            at = [(ids[r["doc_id"]][r["start"] + r["length"] - 1], r["start"] + r["length"] == r["doc_tokens"], r["start"] + r["length"]) for r in last]
            inside = sum(not whole and not ends[i] for i, whole, _ in at)
            padding = sum(packing.SIZE - r["offset"] - r["length"] for r in last)
            found[parts] = len(windows), inside, padding
            # cuts in the order of the stream, apart from windows of tails, which stand behind the tasks that they come from
            assert sorted(windows) == list(range(len(windows)))
            firsts = [min((r["doc_id"], r["start"]) for r in windows[k]) for k in range(len(windows))]
            assert firsts == sorted(firsts) or parts > 1
            assert sum(a > b for a, b in zip(firsts, firsts[1:])) <= parts * (packing.SIZE // 1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n = sum(map(len, ids.values()))
    print(found)
    for windows, inside, padding in found.values():  # blind cuts would lie within sentences nearly always
        assert windows <= n / packing.SIZE * 1.02 + 1 and inside <= found[1][1] + 0.08 * windows and padding < 0.02 * n + packing.SIZE


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return bpe_prefix.encoder(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def oracle():
    import public_tokenizers
    import tiktoken

    ranks = bpe_prefix.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(text=st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_tiktoken(encoder, oracle, text):
    packed = encoder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == oracle.encode_ordinary(text)
    assert encoder.decode(packed) == text.encode()


def test_bpe_documents(spark, sf, encoder, oracle):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe_prefix.encode_decode(docs).collect()}
    for r in docs.collect():
        ids = np.array(oracle.encode_ordinary(r["text"]), "<u4")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


@given(raw=st.binary(max_size=60), more=st.binary(max_size=20), a=st.integers(0, 60), n=st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_append_and_edit(encoder, raw, more, a, n):
    v = encoder.vocabulary
    p = bpe_prefix.Prefix(v, raw)
    p.append(more)
    assert p.ids() == v.merge(raw + more) if raw + more else p.ids() == []
    a = min(a, len(raw))
    b = min(a + n, len(raw))
    q = bpe_prefix.Prefix(v, raw + b" and then a long tail that need not be read again, for it has nothing to do with the edit" * 2)
    whole = q.raw[:a] + more + q.raw[b:]
    q.edit(a, b, more)
    assert q.raw == whole and q.last == bpe_prefix.Prefix(v, whole).last


@pytest.mark.parametrize("doc_id", [None, 7])
def test_one_id_lies_in_many_tasks(spark, doc_id):
    """Rows without an id, or of one id, are cut to ranges by their texts' hashes; ids and starts are right all the same."""
    rows = [(doc_id, f"text {k} of one id") for k in range(400)] + [(9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = token_planes.write_store(docs, tokenizer_path("byte_bpe_50k.json"))
    assert store.select("part").distinct().count() > 2
    got = token_planes.read_store(store).orderBy("start").collect()
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1]) and got[-1]["doc_id"] == 9
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.append(fast_tokenizer(tokenizer_path("byte_bpe_50k.json"), False).ids(t), 0).astype("<u4").tobytes()) for _, t in rows)
    pieces = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in pieces) == sum(len(fast_tokenizer(tokenizer_path("word_bpe_49k.json"), True).ids(t)) + 1 for _, t in rows)
