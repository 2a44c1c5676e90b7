"""Hybrid page retrieval: vectors and BM25 over one corpus of pages, fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.operators import retrieval


@dataclass(frozen=True)
class Config:
    semantic_top_k: int = 5
    bm25_top_k: int = 5
    rrf_k: int = 20
    alpha: float = 0.4
    top_k: int = 6


def search(pages: DataFrame, questions: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, text, embedding, chunk_kind) for (query_id, text, embedding): query_id, doc_id, score, rank_sources, rank. Only page texts take part; an empty corpus gives no rows."""
    corpus = pages.where("chunk_kind = 'page_text'")
    bm25 = retrieval.bm25_search(corpus.select(F.lit("all").alias("corpus"), "doc_id", "text"), questions, top_k=config.bm25_top_k)
    near = retrieval.vector_search(corpus.select(F.col("doc_id").alias("vec_id"), "embedding"), questions, top_k=config.semantic_top_k)
    lists = near.select("query_id", F.col("vec_id").alias("doc_id"), "rank", F.lit("semantic").alias("source")).unionByName(bm25.select("query_id", "doc_id", "rank", F.lit("bm25").alias("source")))
    return retrieval.fuse(lists, {"semantic": config.alpha, "bm25": 1 - config.alpha}, k=config.rrf_k, key=("doc_id",), top_k=config.top_k)
