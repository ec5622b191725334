"""Ranks within groups, and the terms that questions ask for: what all searches share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import analysis


def top(rows: DataFrame, within: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k of each group with their rank; Spark cuts each partition to k before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, term, n_terms; a question without terms has no row, so it matches nothing."""
    found = questions.select("qid", analysis.terms(F.col("question")).alias("ts"))
    return found.select("qid", F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))
