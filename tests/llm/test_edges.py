"""Each operator over documents with nulls in every column, empty and long texts, ties, repeated rows, clashing columns, and over an empty table."""

import pytest
from pyspark.sql import functions as F

from tracefolio.llm import bag_minhash, bpe_prefix, mpeg_audio, packing, pii_tagger, quality_forest, secret_ledger, token_planes, tool_calls, toxicity_grammar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, start long, kept string, bands string, at string, row string, d string, k string, keep_d string"
LONG = "the card 4111111111111111 of a long text, you idiot. token = abcdef123456\n" * 3000
ROWS = [
    (1, "one two three four five six", "en", "s", 27, 1, 1, "x", "b", "a", "r", "d", "k", "q"),
    (1, "one two three four five six", "en", "s", 27, 1, 1, "x", "b", "a", "r", "d", "k", "q"),
    (1, "another text with the same id", None, None, None, None, None, None, None, None, None, None, None, None),
    (None, "no id at all but a text", "en", "s", 3, 1, 1, "x", "b", "a", "r", "d", "k", "q"),
    (None,) * 14,
    (2, "", "en", "s", 0, 1, 1, "x", "b", "a", "r", "d", "k", "q"),
    (3, None, "en", "s", None, 1, 1, "x", "b", "a", "r", "d", "k", "q"),
    (4, " \n\t ", "en", "s", 4, 1, 1, "x", "b", "a", "r", "d", "k", "q"),
    (5, LONG, "en", "s", len(LONG), 1, 1, "x", "b", "a", "r", "d", "k", "q"),
    (6, "é中文😀\x00 ÀÉ <|endoftext|> 😀 mail me@example.com, 10.0.0.1 İ", "fr", "s", 9, 1, 1, "x", "b", "a", "r", "d", "k", "q"),
]
#: The tool of the messages below.
TOOLS = {"reply": {"text": "string", "turn": "integer"}}
LABELS = [(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 0), (5, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module", autouse=True)
def tagger(spark):
    global TAGGER
    TAGGER = pii_tagger.train_tagger(spark.createDataFrame([(k, f"me{k}@example.com or +1 (555) 555-010{k % 10} and words of text {k}") for k in range(40)], "doc_id long, text string"))


TAGGER = None
OPERATORS = {
    "quality": lambda d, k: quality_forest.quality_verdicts(d, k),
    "quality_filter": lambda d, k: quality_forest.keep_documents(d, k),
    "planes": lambda d, k: token_planes.token_planes(d),
    "packing": lambda d, k: packing.pack_documents(d),
    "pii": lambda d, k: pii_tagger.find_pii(d, TAGGER),
    "pii_mask": lambda d, k: pii_tagger.mask_documents(d, TAGGER),
    "toxicity": lambda d, k: toxicity_grammar.score_documents(d, toxicity_grammar.train(d, k)),
    "toxicity_filter": lambda d, k: toxicity_grammar.keep_civil(d, toxicity_grammar.train(d, k)),
    "secrets": lambda d, k: secret_ledger.digest(secret_ledger.scan(d)),
    "dedup": lambda d, k: bag_minhash.near_duplicates(d),
    "dedup_filter": lambda d, k: bag_minhash.one_of_each(d),
    "bpe": lambda d, k: bpe_prefix.encode_decode(d),
    "mpeg": lambda d, k: mpeg_audio.media_column(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(name, docs, labels):
    got = OPERATORS[name](docs, labels).collect()
    if name in ("quality", "planes", "pii", "pii_mask", "toxicity", "secrets", "dedup", "bpe", "mpeg"):
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    else:
        assert {r["doc_id"] for r in got} <= {r[0] for r in ROWS}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(name, docs, labels):
    out = OPERATORS[name](docs.limit(0), labels.limit(0))
    assert out.count() == 0 and "doc_id" in out.columns


def test_filters_keep_columns_and_rows(docs, labels):
    for name in ("quality_filter", "toxicity_filter", "dedup_filter", "pii_mask"):
        assert OPERATORS[name](docs, labels).columns == docs.columns
    once = [tuple(r) for r in bag_minhash.one_of_each(docs).collect()]
    assert len(once) == len(set(once)) and sum(r[1] == ROWS[0][1] for r in once) == 1
    # null and empty texts are one class
    assert sum(r[1] in (None, "") for r in once) == 1


def test_mask_keeps_null_and_counts(docs):
    out = {r["doc_id"]: r for r in pii_tagger.mask_documents(docs.where("doc_id in (3, 6)"), None).collect()}
    assert out[3]["text"] is None
    assert "[EMAIL]" in out[6]["text"] and "[IP]" in out[6]["text"] and out[6]["n_chars"] == len(out[6]["text"])


def test_messages_with_nulls(spark):
    rows = [(1, 0, "user", "plain"), (1, None, None, None), (None, 1, "assistant", '{"tool_calls":[{"id":"a","name":"reply","arguments":"{\\"text\\":\\"x\\",\\"turn\\":1}"}]}'), (None, 2, "tool", '{"tool_call_id":"a","content":"r"}'), (2, 0, "user", "{broken"), (2, 0, "user", "{broken")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).withColumn("owner", F.lit(1))
    got = tool_calls.link(tool_calls.messages_to_items(m), TOOLS).collect()
    assert len(got) == len(rows)
    assert [r["linked"] for r in got if r["conv_id"] is None] == [False, False]
    assert sum(r["kind"] == "message" and r["conv_id"] == 2 for r in got) == 2
    assert tool_calls.link(tool_calls.messages_to_items(m.limit(0)), TOOLS).count() == 0
