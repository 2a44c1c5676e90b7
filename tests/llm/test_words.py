"""How texts come to ids: words are looked up once for a slice of texts, pieces that are met again are kept."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefolio.llm import common
from tracefolio.llm.common import FastTokenizer, PieceMemo, tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = ["the", " The", " the", "'s", "'S", "é", "É", "_", "a_b", "12", " 12", "3.5", "!?", ".", ",", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "<|endoftext|>", "×", "÷", "ªb", "中", "😀", "İ", "\x01", "\x7f", "word."]


@pytest.fixture(scope="module", params=[(BYTE, False), (WORD, True)])
def tok(request):
    return FastTokenizer(tokenizer_path(request.param[0]), request.param[1])


@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), max_size=8), kind=st.sampled_from([pa.string(), pa.large_string()]))
@settings(max_examples=600, deadline=None)
def test_columns_equal_library(tok, texts, kind):
    got = [ids.tolist() for ids in tok.all_ids(pa.array(["sliced off", *texts], kind).slice(1))]
    assert got == [tok.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_equal_library(tok, monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 50)
    random.seed(6)
    texts = ["".join(random.choice(PARTS) for _ in range(random.randrange(30))) for _ in range(500)] + ["", " ", "\n", "a", "x " * 400]
    assert [ids.tolist() for ids in tok.all_ids(pa.array(texts))] == [tok.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_looked_up_once_for_a_slice(tok, monkeypatch):
    seen = []
    monkeypatch.setattr(tok, "word", lambda w: seen.append(w) or FastTokenizer.word(tok, w))
    texts = [f"some words, again and again\nnumber {k}." for k in range(100)]
    got = [ids.tolist() for ids in tok.all_ids(pa.array(texts))]
    assert len(seen) == len(set(seen)) < 120 and got == [tok.ids(t).tolist() for t in texts]


class Model:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, piece):
        self.asked.append(piece)
        return self.model.tokenize(piece)


def test_pieces_that_are_met_again_are_kept(tok):
    memo = PieceMemo(Model(tok.whole.model), most=20)
    for k in range(500):
        assert memo["often"] == tok.memo["often"] and memo[f"n{k}"] == tok.memo[f"n{k}"] and len(memo) + len(memo.old) <= 20
    assert memo.model.asked.count("often") == 1
    memo["x" * 65]
    assert "x" * 65 not in memo and "x" * 65 not in memo.old
