"""The registered queries of the llm operators, over whole tables with production parameters, and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bayes_jaccard, decontam, hilbert, html_crf, langid_cnn, line_dedup, pack_pow2, pu_quality, resampling, token_records, topk_mih, toxicity, whitening
from lodestrata.llm.common import shared_folder, table, text_batches
from lodestrata.llm.learning import remainder


def op1_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_mih.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op2_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op3_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid_cnn.predict(docs, langid_cnn.train(docs))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: how much of it was cut, where, and the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup(docs, spans="spans")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans"), (F.size("spans") > 0).alias("repeats"), "text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pu_quality.score(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its class (the least doc_id that links lead to), the documents linked to it, and the copies among them."""
    found = bayes_jaccard.join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", (F.col("n_copies") - 1).alias("n_copies"), (F.col("id") == F.col("class_id")).alias("represents"))


def op8_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_matches", F.to_json("matches").alias("matches"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


def op10_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pow2.pack(table(spark, sf_dir, "documents"))


def op11_crc_ring_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' token ids, written as records and read back; the files stay in the shared folder, as the rows are read from them."""
    folder = f"{shared_folder(spark)}/token-records-{uuid.uuid4().hex}"
    token_records.write(table(spark, sf_dir, "documents"), folder)
    return token_records.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_multi_index_topk, op2_html_tree_model, op3_byte_cnn_langid, op4_line_dedup, op5_decontamination, op6_pu_quality, op7_bayes_jaccard_join, op8_levenshtein_toxicity, op9_hilbert_shards, op10_pow2_packing, op11_crc_ring_resampling, op12_token_records, op13_svd_whitening)
    return {f.__name__: f if f in (op1_multi_index_topk, op13_svd_whitening) else _in_batches(f) for f in found}


def _in_batches(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(text_batches(spark), sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op1_multi_index_topk": topk_mih.ORACLE_SQL, "op5_decontamination": decontam.ORACLE_SQL, "op11_crc_ring_resampling": resampling.ORACLE_SQL}
