"""Reranking: only what fusion kept meets the (costly) scorer, whose text is joined on at that point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.config import FINAL_K
from lodestrata.functions import analysis
from lodestrata.operators.search import top
from lodestrata.sources.shared import small

Scorer = Callable[[Column, Column], Column]


def offline_coverage(question: Column, content: Column) -> Column:
    """A stand-in scorer: the share of the question's distinct words that the text has, 0 without words."""
    asked = analysis.terms(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, analysis.terms(content))) / F.size(asked)).otherwise(F.lit(0.0))


def pairs(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with their question and text."""
    texts = chunks.select(F.col("chunk_id").alias("of_chunk"), "content", *[c for c in ("source_path", "heading_path") if c in chunks.columns])
    return hits.join(small(questions.select("qid", "question")), "qid").join(texts, F.col("chunk_id") == F.col("of_chunk")).drop("of_chunk")


def rerank(pairs_: DataFrame, scorer: Scorer = offline_coverage, top_k: int = FINAL_K) -> DataFrame:
    """rerank_score and n (1-based excerpt number), cut to top_k; ties by fused score, then id."""
    scored = pairs_.withColumn("rerank_score", scorer(F.col("question"), F.col("content")))
    return top(scored, ["qid"], [F.desc("rerank_score"), F.desc("rrf_score"), F.asc("chunk_id")], top_k, "n")


def plain(pairs_: DataFrame, top_k: int = FINAL_K) -> DataFrame:
    """Without a reranker: the first by fused rank, rerank_score null."""
    return top(pairs_.withColumn("rerank_score", F.lit(None).cast("double")), ["qid"], [F.asc("rank")], top_k, "n")
