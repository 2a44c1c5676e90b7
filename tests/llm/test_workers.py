"""How many Python workers an executor needs for the pipeline's stages, and what they keep."""

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracefolio.llm import bag_minhash, common, pii_tagger, quality_forest, toxicity_grammar
from tracefolio.llm.common import fast_tokenizer, local_rows, tokenizer_path


@pytest.fixture
def corpus(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("call 555 or "), F.when(F.col("id") % 2 == 0, "you are scum and vermin ").otherwise("a kind note "), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.xxhash64("id", k).cast("string")))).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"), (1 - F.col("doc_id") % 2).alias("toxic"))
    return docs, labels


def test_local_rows_need_no_python_rdd(spark):
    df = local_rows(spark, [(1, ["a", "b"]), (None, [])], "k long, words array<string>")
    assert [tuple(r) for r in df.collect()] == [(1, ["a", "b"]), (None, [])] and df.dtypes == [("k", "bigint"), ("words", "array<string>")]
    assert local_rows(spark, [], "k long").count() == 0
    assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_training_sends_no_lists(spark, corpus, monkeypatch):
    docs, labels = corpus
    create, sent = type(spark).createDataFrame, []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: sent.append(type(data).__name__) or create(self, data, *a, **b))
    monkeypatch.setattr(pii_tagger.Tagger, "train", lambda self, *a, **b: self)
    toxicity_grammar.train(docs, labels)
    assert pii_tagger.train_tagger(docs) is not None
    assert sent and set(sent) == {"Table"}


def test_trees_are_dealt_by_one_python_step(spark, corpus, monkeypatch):
    docs, labels = corpus
    plans, at = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *a: plans.append(self._jdf.queryExecution().executedPlan().toString()) or at(self, *a))
    assert quality_forest.train(docs, labels).forest is not None
    assert [p.count("MapInArrow") for p in plans] == [1]


def test_words_are_emptied_where_workers_keep_them(spark, monkeypatch):
    starts = []
    monkeypatch.setattr(bag_minhash, "map_rows", lambda rows, schema, start, **b: starts.append(start))
    bag_minhash.sign_documents(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    work = cloudpickle.loads(cloudpickle.dumps(starts[0]))()
    work({"doc_id": [1], "row_key": [1], "text": ["one two three"]})
    assert bag_minhash._WORDS
    common.claim("other")
    assert not bag_minhash._WORDS


def test_tokenizers_go_with_their_memos():
    path = tokenizer_path("word_bpe_49k.json")
    ids = fast_tokenizer(path, True).ids("some words").tolist()
    assert fast_tokenizer(path, True) is fast_tokenizer(path, True)
    common.claim("other")
    assert (path, True) not in common._TOKENIZERS
    assert fast_tokenizer(path, True).ids("some words").tolist() == ids
