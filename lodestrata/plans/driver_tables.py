"""The driver's tables seen as a corpus: sources are folders, one document is one chunk, and each question is asked with the vector of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import CONTENT_ROOT, FOLDERS, GRANTS, USERS
from lodestrata.operators import acl
from lodestrata.sources import seeds
from lodestrata.sources.shared import small

GUEST = "guest@example.com"
#: qid, email, role, vec_id, question, category, expect_refusal, expected_doc_paths: fixed values, as no text of the tables asks anything.
QUESTIONS = [
    (1, "finance@example.com", None, 0, "from", "single-doc", False, ["content/handbook/finance/"]),
    (2, "hr@example.com", None, 1, "attion", "single-doc", False, ["content/handbook/people-group/", "content/handbook/total-rewards/"]),
    (3, "eng@example.com", None, 2, "this with", "single-doc", False, ["content/handbook/engineering/"]),
    (4, "exec@example.com", None, 3, "that for the", "multi-dept", False, ["content/handbook/sales/", "content/handbook/marketing/"]),
    (5, "finance@example.com", None, 1, "attion", "acl", True, None),
    (6, "exec@example.com", None, 4, "zzzqqq nothing", "no-answer", True, None),
    (7, "nobody@example.com", None, 5, "from", "acl", True, None),
    (8, GUEST, None, 5, "from", "acl", True, None),
    (9, None, "legal_counsel", 6, "on the", "single-doc", False, ["content/handbook/legal/"]),
    (10, None, None, 7, "from", "single-doc", False, None),
    (11, "eng@example.com", None, 8, "from", "single-doc", False, ["content/handbook/security/"]),
]


def folders(spark: SparkSession) -> DataFrame:
    """source, folder, department: src0 to src11 stand for the allowed folders in their order."""
    return seeds.values(spark, [(f"src{k}", f, d) for k, (f, d) in enumerate(FOLDERS.items())], "source, folder, department")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Allowed documents: doc_id, source, folder, department, source_path, content, content_hash."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.col("text").alias("content"))
    both = docs.join(F.broadcast(folders(spark)), "source")  # a constant of a row a folder
    path = F.concat(F.lit(CONTENT_ROOT + "/"), "folder", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return both.select("doc_id", "source", "folder", "department", path.alias("source_path"), "content", F.sha2("content", 256).alias("content_hash"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """chunk_id, department, source_path, heading_path, content of the corpus."""
    docs = documents(spark, sf)
    return docs.select(F.col("doc_id").alias("chunk_id"), "department", "source_path", F.col("source_path").alias("heading_path"), "content")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    own = docs.join(F.broadcast(folders(spark)), "source").select("doc_id", "department")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return vectors.join(own, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("chunk_id"), "department", "embedding")


def users(spark: SparkSession) -> DataFrame:
    """user_id, email, departments of the seeds and of a guest without roles."""
    guest = seeds.values(spark, [(GUEST, "guest")], "email, display_name").select(seeds.stable_id(F.lit("user"), "email").alias("id"), "email", "display_name")
    return acl.by_email(seeds.users(spark).unionByName(guest), seeds.user_roles(spark), seeds.role_department_access(spark))


def roles(spark: SparkSession) -> DataFrame:
    return acl.by_role(seeds.roles(spark), seeds.role_department_access(spark))


def questions(spark: SparkSession, sf: str | None = None) -> DataFrame:
    """The fixed questions, with their vectors if sf is given."""
    rows = seeds.values(spark, [(*q[:7], "|".join(q[7]) if q[7] else None) for q in QUESTIONS], "qid, email, role, vec_id, question, category, expect_refusal, paths")
    rows = rows.withColumn("qid", F.col("qid").cast("long")).withColumn("email", F.col("email").cast("string")).withColumn("role", F.col("role").cast("string")).withColumn("expected_doc_paths", F.split("paths", r"\|")).drop("paths")
    if sf is None:
        return rows.drop("vec_id")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").where(F.col("vec_id").isin(sorted({q[3] for q in QUESTIONS}))).select(F.col("vec_id").cast("long").alias("of_vec"), F.col("embedding").alias("vector"))
    return rows.join(small(vectors), F.col("vec_id") == F.col("of_vec"), "left").drop("vec_id", "of_vec")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return acl.askers(questions(spark, sf), users(spark), roles(spark))


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "[" + ", ".join(map(_sql, v)) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


#: The same in DuckDB's SQL, as common table expressions.
BASE_SQL = f"""
folders(source, folder, department) AS (VALUES {_rows([(f"src{k}", f, d) for k, (f, d) in enumerate(FOLDERS.items())])}),
docs AS (
  SELECT doc_id, source, folder, department, '{CONTENT_ROOT}/' || folder || '/' || doc_id || '.md' AS source_path, text AS content, sha256(text) AS content_hash
  FROM documents JOIN folders USING (source)
),
chunks AS (SELECT doc_id AS chunk_id, department, source_path, source_path AS heading_path, content FROM docs),
emb AS (SELECT vec_id AS chunk_id, department, embedding FROM embeddings JOIN chunks ON vec_id = chunk_id),
grants(role, department) AS (VALUES {_rows([(r, d) for r, ds in GRANTS.items() for d in ds])}),
seed_users(email, role) AS (VALUES {_rows([*USERS.items(), (GUEST, None)])}),
people AS (
  SELECT u.email, sha256('user' || chr(1) || u.email) AS user_id, coalesce(list_sort(list(DISTINCT g.department) FILTER (g.department IS NOT NULL)), []) AS departments
  FROM seed_users u LEFT JOIN grants g USING (role) GROUP BY u.email
),
role_departments AS (SELECT role, list_sort(list(DISTINCT department)) AS departments FROM grants GROUP BY role),
questions(qid, email, role, vec_id, question, category, expect_refusal, expected_doc_paths) AS (
  SELECT col0::BIGINT, col1::VARCHAR, col2::VARCHAR, col3, col4, col5, col6, col7::VARCHAR[] FROM (VALUES {_rows(QUESTIONS)})
),
asked AS (
  SELECT q.*, CASE WHEN q.email IS NOT NULL THEN 'email' WHEN q.role IS NOT NULL THEN 'role' END AS asker, p.user_id,
         coalesce(CASE WHEN q.email IS NOT NULL THEN p.departments ELSE r.departments END, []) AS departments
  FROM questions q LEFT JOIN people p USING (email) LEFT JOIN role_departments r ON r.role = q.role
),
allow AS (SELECT qid, unnest(departments) AS department FROM asked)
"""
