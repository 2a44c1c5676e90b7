"""A corpus pipeline: quality rules, toxicity, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet to the shared folder and read again as the
next stage's ``docs``. The first four give the columns of ``documents``, whatever these are.

Defined results: null texts count as empty ones, and the quality rules reject them; a null doc_id stays with its row; of equal rows one
is left by near_dedup; an empty table goes through all stages and gives no rows; labels of unknown documents do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefolio.llm import bag_minhash, packing, pii_tagger, quality_forest, toxicity_grammar
from tracefolio.llm.common import settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_forest.keep_documents(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity_grammar.keep_civil(docs, toxicity_grammar.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays."""
    return bag_minhash.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked."""
    return pii_tagger.mask_documents(docs, pii_tagger.train_tagger(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("packing", pack)]

#: A forest, a trained tagger and a tokenizer's ids can't be written in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
