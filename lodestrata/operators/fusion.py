"""Reciprocal rank fusion and the retriever."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.config import K_PER_BRANCH, POOL, RRF_K
from lodestrata.operators import acl
from lodestrata.operators.search import SearchBackend, top


def rrf(dense: DataFrame, lexical: DataFrame, top_k: int = POOL, k: int = RRF_K) -> DataFrame:
    """qid, chunk_id, department, dense_score, dense_rank, lexical_rank, rrf_score, rank: what either branch found, best first."""
    d = dense.select("qid", "chunk_id", F.col("department").alias("d_department"), "dense_score", "dense_rank")
    x = lexical.select("qid", "chunk_id", F.col("department").alias("l_department"), "lexical_rank")
    term = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = d.join(x, ["qid", "chunk_id"], "full_outer").withColumn("department", F.coalesce("d_department", "l_department")).withColumn("rrf_score", term("dense_rank") + term("lexical_rank"))
    cut = top(both, ["qid"], [F.desc("rrf_score"), F.asc("chunk_id")], top_k, "rank")
    return cut.select("qid", "chunk_id", "department", "dense_score", "dense_rank", "lexical_rank", "rrf_score", "rank")


class Retriever:
    """retrieve(): questions (qid, question, email, role, vector) to their fused hits; without departments a question has none."""

    def __init__(self, backend: SearchBackend, users: DataFrame, roles: DataFrame):
        self.backend, self.users, self.roles = backend, users, roles

    def retrieve(self, questions: DataFrame, k_per_branch: int = K_PER_BRANCH, top_k: int = POOL) -> DataFrame:
        asked = acl.askers(questions, self.users, self.roles)
        allow = acl.allowed(asked)
        return rrf(self.backend.dense(asked, allow, k_per_branch), self.backend.lexical(asked, allow, k_per_branch), top_k)
