"""The corpus pipeline: each stage calls one operator of lodestrata.llm, its rows are written as Parquet and read as the next one's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bayes_jaccard, decontam, line_dedup, pack_pow2, toxicity
from lodestrata.llm.common import removed, shared_folder, table, text_batches


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is trained on the labelled ones among docs."""
    text_batches(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of Jaccard similarity 0.8 join, the one with the least doc_id stays."""
    text_batches(spark)
    return bayes_jaccard.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and parts of sentences that came before are cut from the texts; every document stays, n_chars follows its text."""
    text_batches(spark)
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    text_batches(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of power-of-two lengths."""
    text_batches(spark)
    return pack_pow2.pack(docs)


STAGES = [("toxicity", toxic_out), ("near_copies", near_copies_out), ("substring_dedup", repeats_out), ("decontamination", leaks_out), ("packing", packed)]

#: Models, hashes and token ids have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; what lies between them is written to the shared checkpoint folder.

    A stage's rows go once the next one's are written; the last one's stay, as the caller reads them.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return docs
