"""Schemas of the persistent tables and of the nested payloads."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


#: One DDL string for each table; parsed when asked for, since that needs a session.
DDL = {
    "users": "id string not null, email string not null, display_name string not null, created_at timestamp",
    "roles": "id string not null, name string not null",
    "user_roles": "user_id string not null, role_id string not null",
    "role_department_access": "role_id string not null, department string not null",
    "documents": "id string not null, source string not null, source_path string not null, title string, department string not null, doc_type string, content_hash string not null, raw_uri string, source_updated_at timestamp, indexed_at timestamp, status string not null",
    "document_keys": "source string not null, source_path string not null, id string not null, content_hash string not null, status string not null, written long not null",
    "chunks": "id string not null, document_id string not null, chunk_index int not null, content string not null, heading_path string, token_count int, department string not null, status string not null, metadata string, created_at timestamp",
    "chunk_terms": "chunk_id string not null, department string not null, term string not null, positions array<int>",
    "embedding_models": "model_name string not null, dimensions int not null, table_name string not null, is_active boolean not null, created_at timestamp",
    "chunk_embeddings": "chunk_id string not null, embedding array<float> not null, department string not null",
    "chunk_blocks": "department string not null, term string not null, span long not null, block_max long not null, n_postings long not null, postings array<struct<chunk_id:string,n:bigint>>",
    "vector_centroids": "department string not null, number int not null, centroid array<float> not null, radius double not null",
    "vector_index": "chunk_id string not null, department string not null, embedding array<float> not null",
    "ingestion_runs": "id string not null, started_at timestamp, finished_at timestamp, git_commit string, status string not null, stats struct<walked:bigint,added:bigint,updated:bigint,unchanged:bigint,skipped_stub:bigint,skipped_empty:bigint,errored:bigint,chunks_written:bigint,tombstoned:bigint,embed_seconds:double,write_seconds:double>",
    "ingestion_errors": "run_id string not null, source_path string, error string, created_at timestamp",
    "conversations": "id string not null, user_id string, title string, running_summary string, created_at timestamp, updated_at timestamp",
    "messages": "id string not null, conversation_id string not null, role string not null, content string not null, created_at timestamp",
    "query_traces": "id string not null, message_id string, user_id string, raw_query string not null, rewritten_query string, needs_retrieval boolean, retrieval array<struct<chunk_id:string,department:string,dense_score:double,dense_rank:bigint,lexical_rank:bigint,rrf_score:double,rerank_score:double,in_prompt:boolean>>, prompt_version string, model string, embedding_model string, input_tokens bigint, output_tokens bigint, latency_ms map<string,double>, cache_status string, stop_reason string, outcome string, created_at timestamp",
    "golden_questions": "id string not null, question string not null, expected_answer string, expected_doc_paths array<string>, ask_as_role string, ask_as_email string, expect_refusal boolean not null, category string, created_at timestamp",
    "eval_runs": "id string not null, started_at timestamp, finished_at timestamp, git_commit string, prompt_version string, config map<string,string>, summary map<string,double>",
    "eval_results": "run_id string not null, question_id string not null, retrieved array<struct<chunk_id:string,source_path:string,rrf_score:double,rerank_score:double>>, answer string, metrics map<string,double>",
}

#: Columns that identify a row, allowed values, and references (column, table, column).
KEYS = {
    "users": ["email"], "roles": ["name"], "user_roles": ["user_id", "role_id"], "role_department_access": ["role_id", "department"], "documents": ["source", "source_path"], "chunks": ["document_id", "chunk_index"],
    "chunk_terms": ["chunk_id", "term"], "embedding_models": ["model_name"], "chunk_embeddings": ["chunk_id"], "golden_questions": ["question", "ask_as_role", "ask_as_email"], "eval_results": ["run_id", "question_id"],
}
#: The column of a key by which rows are dealt to check it. By the whole key a chunk's terms would be scattered, and each would carry its chunk's id.
TOGETHER = {"chunk_terms": "chunk_id"}
CHECKS = {
    "documents": {"status": ["active", "tombstoned"]}, "document_keys": {"status": ["active", "tombstoned"]}, "chunks": {"status": ["active", "tombstoned"]}, "ingestion_runs": {"status": ["running", "succeeded", "failed"]}, "messages": {"role": ["user", "assistant"]},
    "query_traces": {"outcome": ["answered", "refused_by_floor", "refused_by_model"]},
}
REFERENCES = {
    "user_roles": [("user_id", "users", "id"), ("role_id", "roles", "id")], "role_department_access": [("role_id", "roles", "id")], "chunks": [("document_id", "documents", "id")], "chunk_embeddings": [("chunk_id", "chunks", "id")],
    "chunk_terms": [("chunk_id", "chunks", "id")], "ingestion_errors": [("run_id", "ingestion_runs", "id")], "eval_results": [("run_id", "eval_runs", "id")],
}
#: References that deletions follow, but commits don't verify, as what they name may be kept elsewhere.
FOLLOWED = {
    "conversations": [("user_id", "users", "id")], "messages": [("conversation_id", "conversations", "id")], "query_traces": [("message_id", "messages", "id"), ("user_id", "users", "id")], "eval_results": [("question_id", "golden_questions", "id")],
}
#: What the deletion of a referenced row does; where nothing is named it is refused.
ON_DELETE = {
    ("user_roles", "user_id"): "cascade", ("user_roles", "role_id"): "cascade", ("role_department_access", "role_id"): "cascade", ("chunks", "document_id"): "cascade", ("chunk_embeddings", "chunk_id"): "cascade", ("chunk_terms", "chunk_id"): "cascade",
    ("ingestion_errors", "run_id"): "cascade", ("messages", "conversation_id"): "cascade", ("query_traces", "message_id"): "set null", ("eval_results", "run_id"): "cascade",
}
PARTITIONED = {"chunk_embeddings": ["department"], "chunk_terms": ["department"], "chunk_blocks": ["department"], "vector_index": ["department"]}

#: Tables of many rows a chunk, whose chunks were dealt by folder: few folders lie in a task, so rows needn't be sorted by them.
DEALT = {"chunk_terms", "chunk_blocks"}

#: Tables in Spark's buckets of a column, whose rows are added and never replaced: of those with one key (the second list) the one that was written last counts.
CLUSTERED = {"document_keys": ("source_path", ["source", "source_path"], "written")}


def schema(table: str) -> T.StructType:
    return _schema(DDL[table])


def _fields(table: str) -> list[str]:
    depth, out, at = 0, [], 0
    for k, c in enumerate(DDL[table] + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(DDL[table][at:k].strip())
            at = k + 1
    return out


def columns(table: str) -> list[str]:
    """A table's column names, in order; needs no session."""
    return [f.split()[0] for f in _fields(table)]


def required(table: str) -> list[str]:
    """Columns that may not be null."""
    return [f.split()[0] for f in _fields(table) if f.endswith("not null")] if table in DDL else []
