"""What the catalogue's queries compute, as SQL for DuckDB over the driver's tables."""

from __future__ import annotations

from lodestrata.config import GRANTS, MAX_TOKENS, MIN_TOKENS, NOT_FOUND
from lodestrata.plans import chunk_sql, english_sql
from lodestrata.plans.chunk_sql import TOKEN
from lodestrata.plans.driver_tables import BASE_SQL, _rows

_N = NOT_FOUND.replace("'", "''")

STORED = """
stored AS (
  SELECT doc_id::VARCHAR AS id, source_path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 11 = 0 THEN 'tombstoned' ELSE 'active' END AS status, department FROM docs WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'gone-' || doc_id, source_path || '.bak', content_hash, 'active', department FROM docs WHERE doc_id % 3 = 0
)"""
DIFF = """
diff AS (
  SELECT d.*, CASE WHEN s.id IS NULL THEN 'added' WHEN d.content_hash <> s.content_hash THEN 'updated' WHEN s.status = 'tombstoned' THEN 'reactivated' ELSE 'unchanged' END AS change
  FROM docs d LEFT JOIN stored s USING (source_path)
)"""
DENSE = """
scored AS (
  SELECT a.qid, e.chunk_id, e.department, list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS dense_score
  FROM asked a JOIN allow USING (qid) JOIN embeddings v ON v.vec_id = a.vec_id JOIN emb e USING (department)
),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid, department ORDER BY dense_score DESC, chunk_id) AS rank_in_department FROM scored QUALIFY rank_in_department <= 25),
dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM dense)"""
LEXICAL = """
words AS (SELECT chunk_id, department, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM chunks),
postings AS (SELECT chunk_id, department, term, count(*) AS n FROM words GROUP BY ALL),
qterms AS (SELECT qid, question, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: x <> ''))) AS ts FROM questions),
matched AS (
  SELECT q.qid, p.chunk_id, p.department, sum(p.n)::BIGINT AS lexical_score
  FROM (SELECT qid, len(ts) AS n_terms, unnest(ts) AS term FROM qterms) q JOIN allow USING (qid) JOIN postings p USING (term, department)
  GROUP BY q.qid, p.chunk_id, p.department, q.n_terms HAVING count(*) = q.n_terms
),
lexical AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical_score DESC, chunk_id) AS lexical_rank FROM matched QUALIFY lexical_rank <= 25)"""
_FUSED = """
fused AS (
  SELECT coalesce(d.qid, x.qid) AS qid, coalesce(d.chunk_id, x.chunk_id) AS chunk_id, coalesce(d.department, x.department) AS department, d.dense_score, d.dense_rank, x.lexical_rank,
         coalesce(1.0::DOUBLE / (60 + d.dense_rank), 0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + x.lexical_rank), 0::DOUBLE) AS rrf_score
  FROM dense_ranked d FULL OUTER JOIN lexical x ON d.qid = x.qid AND d.chunk_id = x.chunk_id
),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 25)"""
HYBRID = f"{DENSE}, {LEXICAL}, {_FUSED}"
ENGLISH = f"{english_sql.search('chunks', 'questions', 'allow')}, {english_sql.RANKED}"
#: The first two words of each turn as a question to all departments.
ASKED_TALKS = """
talks AS (SELECT conv_id * 1000 + turn AS qid, array_to_string(string_split(text, ' ')[1:2], ' ') AS question FROM conversations),
talk_allow AS (SELECT qid, unnest((SELECT list(DISTINCT department) FROM folders)) AS department FROM talks)"""
RERANK = f"""{HYBRID},
pairs AS (
  SELECT h.*, c.content, c.source_path, c.heading_path, CASE WHEN len(q.ts) > 0 THEN len(list_intersect(q.ts, list_distinct(regexp_split_to_array(lower(c.content), '[^a-z0-9]+'))))::DOUBLE / len(q.ts) ELSE 0.0::DOUBLE END AS rerank_score
  FROM hybrid h JOIN qterms q USING (qid) JOIN chunks c USING (chunk_id)
),
final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rrf_score DESC, chunk_id) AS n FROM pairs QUALIFY n <= 6)"""
BUDGET = 400
DONE = f"""{RERANK},
best AS (SELECT a.*, coalesce(max(f.rerank_score), 0.0) AS best, coalesce(max(f.rerank_score), 0.0) < 0.2 AS refused FROM asked a LEFT JOIN final f USING (qid) GROUP BY ALL),
said AS (
  SELECT qid, coalesce(string_agg(CASE WHEN rerank_score >= 1.0 THEN string_split(content, chr(10))[1] || ' [' || n || ']' END, chr(10) ORDER BY n), '{_N}') AS whole FROM final GROUP BY qid
),
answers AS (SELECT qid, whole[1:{BUDGET}] AS answer, CASE WHEN length(whole) > {BUDGET} THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason FROM said),
done AS (
  SELECT b.*, CASE WHEN NOT refused THEN a.answer END AS answer, CASE WHEN NOT refused THEN a.stop_reason END AS stop_reason,
         CASE WHEN refused THEN 'refused_by_floor' WHEN starts_with(trim(a.answer), '{_N}') THEN 'refused_by_model' ELSE 'answered' END AS outcome
  FROM best b LEFT JOIN answers a USING (qid)
)"""
CLEAN = """
pools AS (SELECT qid, list_sort(list(DISTINCT department)) AS pool FROM hybrid GROUP BY qid),
clean AS (SELECT a.qid, coalesce(pool, []) AS pool, len(list_filter(coalesce(pool, []), lambda x: NOT list_contains(a.departments, x))) = 0 AS acl_clean FROM asked a LEFT JOIN pools USING (qid))"""
METRICS = f"""{DONE}, {CLEAN},
wide_paths AS (SELECT qid, list(DISTINCT c.source_path) AS ps FROM hybrid JOIN chunks c USING (chunk_id) GROUP BY qid),
final_paths AS (SELECT qid, list(DISTINCT source_path) AS ps FROM final GROUP BY qid),
metrics AS (
  SELECT d.qid, d.category, d.outcome, c.acl_clean, (d.outcome <> 'answered') = d.expect_refusal AS refusal_correct,
         CASE WHEN len(coalesce(expected_doc_paths, [])) > 0 THEN len(list_filter(expected_doc_paths, lambda e: len(list_filter(coalesce(w.ps, []), lambda p: starts_with(p, e))) > 0))::DOUBLE / len(expected_doc_paths) END AS recall_wide,
         CASE WHEN len(coalesce(expected_doc_paths, [])) > 0 THEN len(list_filter(expected_doc_paths, lambda e: len(list_filter(coalesce(f.ps, []), lambda p: starts_with(p, e))) > 0))::DOUBLE / len(expected_doc_paths) END AS recall_final
  FROM done d JOIN clean c USING (qid) LEFT JOIN wide_paths w USING (qid) LEFT JOIN final_paths f USING (qid) WHERE d.asker IS NOT NULL
)"""


def _w(*parts: str) -> str:
    return f"WITH {BASE_SQL}" + "".join(f", {p}" for p in parts)


#: Whole turns as lines of at most eight words: conv_id, turn, i (from 0), w.
_LINES = """(SELECT conv_id, turn, i, array_to_string(ws[8 * i + 1 : 8 * i + 8], ' ') AS w FROM (
      SELECT conv_id, turn, ws, unnest(range(greatest(1, (len(ws) + 7) // 8))) AS i FROM (
        SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda x: x <> '') AS ws FROM conversations)))"""
#: Customers as users with roles: held (id, email, role), customers_as_users (id, email, departments).
PEOPLE = f"""
role_names AS (SELECT row_number() OVER (ORDER BY role) - 1 AS k, role FROM (SELECT DISTINCT role FROM grants)),
placed AS (SELECT c_custkey, c_name, (length(c_mktsegment) + ascii(c_mktsegment)) % {len(GRANTS)} AS k FROM customer WHERE c_custkey % 10 <> 0),
held AS (
  SELECT c_custkey::VARCHAR AS id, c_name AS email, role FROM (SELECT * FROM placed UNION ALL SELECT c_custkey, c_name, (k + 1) % {len(GRANTS)} FROM placed WHERE c_custkey % 3 = 0) JOIN role_names USING (k)
),
customers_as_users AS (
  SELECT c_custkey::VARCHAR AS id, c_name AS email, coalesce(ds, []) AS departments FROM customer
  LEFT JOIN (SELECT id, list_sort(list(DISTINCT department)) AS ds FROM held JOIN grants USING (role) GROUP BY id) h ON h.id = c_custkey::VARCHAR
)"""
TURNS = """turns AS (
  SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:3], ' ') AS question, CASE WHEN conv_id % 3 <> 0 THEN role || '@example.com' END AS email FROM conversations
)"""


def _packed(units: str, key: str, most: int, frame: str = "0") -> str:
    """units (key, k, t, n) with g: a new group where n more tokens don't fit; what is over the cap alone is a group alone."""
    full = f"({frame} + r.n > {most} OR {frame} + u.n > {most} OR r.size + u.n > {most})"
    return f"""RECURSIVE u AS ({units}), r AS (
      SELECT {key}, k, t, n, {frame} + n AS size, 0 AS g FROM u WHERE k = 0
      UNION ALL SELECT u.{key}, u.k, u.t, u.n, CASE WHEN {full} THEN {frame} + u.n ELSE r.size + u.n END, r.g + {full}::INT FROM r JOIN u ON u.{key} = r.{key} AND u.k = r.k + 1
    )"""


def _pieces(line: str, head: str, tail: str) -> str:
    frame = f"(len(regexp_extract_all({head}, '{TOKEN}')) + len(regexp_extract_all({tail}, '{TOKEN}')))"
    units = f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS k, {line} AS t, len(regexp_extract_all({line}, '{TOKEN}')) AS n FROM {_LINES}"
    join = "|| chr(10) ||"
    return f"""WITH {_packed(units, 'conv_id', 40, frame)}, p AS (SELECT conv_id, g, string_agg(t, chr(10) ORDER BY k) AS b FROM r GROUP BY conv_id, g), x AS (SELECT conv_id, g, {head} {join} b {f"{join} {tail}" if tail != "''" else ""} AS piece FROM p)
      SELECT conv_id, g::BIGINT AS place, length(piece) AS chars, sha256(piece) AS hash FROM x"""


_PARAGRAPHS = r"SELECT doc_id::VARCHAR AS doc, 0 AS s, [source_path] AS path, 'plain' AS kind, regexp_replace(replace(content, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS body FROM docs WHERE trim(content) <> ''"
_STRIPPED = r"regexp_replace(regexp_replace(content, '\\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
#: Three ingest runs: files (kind: what is in it from the second run on; was: stored by the first), the chunks of either content.
WAVES = f"""
files AS (SELECT doc_id, source_path, department, {_STRIPPED} AS body, doc_id % 7 <> 0 AND body <> '' AS was, doc_id % 17 <> 0 AS second,
  CASE doc_id % 13 WHEN 1 THEN 'bad' WHEN 2 THEN 'empty' WHEN 4 THEN 'stub' WHEN 3 THEN CASE WHEN body = '' THEN 'empty' ELSE 'front' END ELSE CASE WHEN body = '' THEN 'empty' ELSE 'text' END END AS kind FROM docs),
{chunk_sql.chunked("""SELECT doc_id || ':text' AS doc, 1 AS s, [doc_id::VARCHAR] AS path, 'plain' AS kind, body FROM files WHERE body <> ''
  UNION ALL SELECT doc_id || ':front', 1, ['T ' || doc_id, 'One'], 'plain', body FROM files WHERE kind = 'front'
  UNION ALL SELECT doc_id || ':front', 2, ['T ' || doc_id, 'One', 'Two'], 'plain', body FROM files WHERE kind = 'front'""", MIN_TOKENS, MAX_TOKENS)},
n_chunks AS (SELECT doc, count(*) AS n FROM done GROUP BY doc),
outcomes AS (
  SELECT 1 AS run, doc_id, CASE WHEN body = '' THEN 'skipped_empty' ELSE 'added' END AS state, 'text' AS content, false AS gone FROM files WHERE doc_id % 7 <> 0
  UNION ALL SELECT 2, doc_id, CASE kind WHEN 'bad' THEN 'errored' WHEN 'empty' THEN 'skipped_empty' WHEN 'stub' THEN 'skipped_stub' WHEN 'text' THEN CASE WHEN was THEN 'unchanged' ELSE 'added' END ELSE CASE WHEN was THEN 'updated' ELSE 'added' END END,
    kind, was AND kind IN ('empty', 'stub') FROM files WHERE second
  UNION ALL SELECT 2, doc_id, NULL, NULL, was FROM files WHERE NOT second
  UNION ALL SELECT 3, doc_id, CASE kind WHEN 'bad' THEN 'errored' WHEN 'empty' THEN 'skipped_empty' WHEN 'stub' THEN 'skipped_stub' ELSE CASE WHEN second THEN 'unchanged' WHEN NOT was THEN 'added' WHEN kind = 'text' THEN 'reactivated' ELSE 'updated' END END, kind, false FROM files
)"""
_SIZED = f"sized AS (SELECT department, source_path, content, len(regexp_extract_all(content, '{TOKEN}'))::BIGINT AS t FROM docs)"

SQL: dict[str, str] = {
    "allowlist_scan": _w() + " SELECT doc_id, folder, department, source_path FROM docs",
    "department_filter": _w() + " SELECT doc_id, department FROM docs WHERE department IN ('finance', 'legal')",
    "content_hash": _w() + " SELECT doc_id, content_hash FROM docs",
    "hash_diff": _w(STORED, DIFF) + " SELECT doc_id, change FROM diff",
    "keyed_diff": _w(STORED, DIFF) + " SELECT doc_id, change FROM diff",
    "keyed_vanished": _w(STORED) + " SELECT id, source_path FROM stored WHERE status = 'active' AND source_path NOT IN (SELECT source_path FROM docs)",
    "streamed_changes": _w(STORED, DIFF) + """ SELECT source_path, change, content_hash FROM diff
UNION ALL SELECT source_path, 'tombstoned', content_hash FROM stored WHERE source_path NOT IN (SELECT source_path FROM docs)""",
    "cascade_closure": """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS l_suppkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 = 0)""",
    "tombstone_diff": _w(STORED) + " SELECT id, CASE WHEN status = 'active' AND source_path NOT IN (SELECT source_path FROM docs) THEN 'tombstoned' ELSE status END AS status FROM stored",
    "upsert_documents": _w(STORED) + " SELECT id, source_path, content_hash, status FROM stored WHERE source_path NOT IN (SELECT source_path FROM docs) UNION ALL SELECT doc_id::VARCHAR, source_path, content_hash, 'active' FROM docs",
    "stored_snapshot": _w(STORED) + " SELECT id, source_path, content_hash, status FROM stored WHERE source_path NOT IN (SELECT source_path FROM docs) UNION ALL SELECT doc_id::VARCHAR, source_path, content_hash, 'active' FROM docs",
    "stored_version": _w(STORED) + """ SELECT id, source_path, 'kept' AS state, status AS was_status FROM stored WHERE source_path NOT IN (SELECT source_path FROM docs)
UNION ALL SELECT d.doc_id::VARCHAR, d.source_path, CASE WHEN s.id IS NULL THEN 'new' WHEN s.content_hash = d.content_hash AND s.status = 'active' THEN 'kept' ELSE 'replaced' END, s.status
FROM docs d LEFT JOIN stored s USING (source_path)""",
    "ingest_runs": f"WITH RECURSIVE {BASE_SQL}, {WAVES}" + """ SELECT run::BIGINT AS run, 'succeeded' AS status, count(state) AS walked, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state IN ('updated', 'reactivated')) AS updated,
      count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'skipped_stub') AS skipped_stub, count(*) FILTER (state = 'skipped_empty') AS skipped_empty, count(*) FILTER (state = 'errored') AS errored,
      coalesce(sum(n) FILTER (state IN ('added', 'updated')), 0)::BIGINT AS chunks_written, count(*) FILTER (gone) AS tombstoned, count(*) FILTER (state = 'errored') AS n_errors
      FROM outcomes o LEFT JOIN n_chunks c ON c.doc = o.doc_id || ':' || o.content GROUP BY run""",
    "ingested": f"WITH RECURSIVE {BASE_SQL}, {WAVES}" + """ SELECT source_path, CASE kind WHEN 'front' THEN 'T ' || doc_id ELSE doc_id::VARCHAR END AS title, status AS document_status, status, chunk_index, heading_path, token_count, sha256(d.content) AS hash, status = 'active' AS has_vector, status = 'active' AND length(regexp_replace(d.content, '[^A-Za-z0-9]', '', 'g')) > 0 AS has_terms
      FROM (SELECT *, CASE WHEN kind IN ('text', 'front', 'bad') THEN 'active' ELSE 'tombstoned' END AS status FROM files WHERE was OR kind IN ('text', 'front')) f
      JOIN done d ON d.doc = f.doc_id || ':' || CASE kind WHEN 'front' THEN 'front' ELSE 'text' END""",
    "upsert_counts": _w(STORED) + " SELECT count(*) FILTER (s.id IS NULL) AS inserted, count(*) FILTER (s.id IS NOT NULL) AS updated FROM docs d LEFT JOIN stored s USING (source_path)",
    "embedding_cascade": _w(STORED) + " SELECT chunk_id, department FROM emb WHERE chunk_id NOT IN (SELECT id::BIGINT FROM stored WHERE status = 'tombstoned')",
    "reference_set_null": _w(STORED) + " SELECT vec_id, CASE WHEN vec_id NOT IN (SELECT id::BIGINT FROM stored WHERE status = 'tombstoned') THEN vec_id END AS document_id FROM embeddings",
    "english_topk": _w(ENGLISH) + " SELECT qid, chunk_id, lexical_rank, round(score, 6) AS ts_rank FROM lexical",
    "english_hybrid": _w(DENSE, ENGLISH, _FUSED) + " SELECT qid, chunk_id, department, dense_rank, lexical_rank, round(rrf_score, 6) AS rrf_score, rank FROM hybrid",
    "english_talks": _w(ASKED_TALKS, english_sql.search("chunks", "talks", "talk_allow"), english_sql.RANKED) + " SELECT qid, chunk_id, lexical_rank, round(score, 6) AS ts_rank FROM lexical",
    "english_lexemes": f"""WITH d AS (SELECT doc_id AS chunk_id, '' AS department, text AS content FROM documents), q AS (SELECT 0 AS qid, '' AS question), w AS (SELECT 0 AS qid, '' AS department), {english_sql.search("d", "q", "w")},
      t AS (SELECT chunk_id, term, count(*) AS n, string_agg(place::VARCHAR, ',' ORDER BY place) AS places FROM english_terms GROUP BY ALL), v AS (SELECT chunk_id, count(*) AS n, sum(n)::BIGINT AS m, string_agg(term || '=' || places, ' ' ORDER BY term) AS s FROM t GROUP BY chunk_id)
      SELECT doc_id, coalesce(n, 0) AS n_lexemes, coalesce(m, 0) AS n_positions, sha256(coalesce(s, '')) AS hash FROM documents LEFT JOIN v ON chunk_id = doc_id""",
    "retriever_active": _w(f"live AS (SELECT * FROM chunks WHERE chunk_id % 11 <> 0), live_emb AS (SELECT * FROM emb WHERE chunk_id % 11 <> 0), {HYBRID.replace('FROM chunks', 'FROM live').replace('JOIN emb e', 'JOIN live_emb e')}")
    + " SELECT qid, chunk_id, department, dense_rank, lexical_rank, round(rrf_score, 6) AS rrf_score, rank FROM hybrid",
    "not_found_forms": f"WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '  {_N} ' || text WHEN 1 THEN text || ' {_N}' ELSE text END AS t FROM conversations) SELECT conv_id, turn, starts_with(trim(t), '{_N}') AS at_start, contains(t, '{_N}') AS anywhere FROM t",
    "chunk_sections": """WITH t AS (SELECT conv_id, turn, turn % 3 + 1 AS level, role || ' ' || turn AS head, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
      h AS (SELECT t.conv_id, t.place, string_agg(a.head, ' > ' ORDER BY a.turn) AS path FROM t JOIN t a ON a.conv_id = t.conv_id AND a.turn <= t.turn WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.conv_id = t.conv_id AND u.turn > a.turn AND u.turn <= t.turn AND u.level <= a.level) GROUP BY t.conv_id, t.place)
      SELECT t.conv_id, t.place, path, sha256(trim(text)) AS hash FROM t JOIN h USING (conv_id, place)""",
    "packed_paragraphs": f"WITH {_packed(f"SELECT doc_id, k, ls[k + 1] AS t, len(regexp_extract_all(ls[k + 1], '{TOKEN}')) AS n FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))", 'doc_id', 100)} SELECT doc_id, g::BIGINT AS place, min(k) AS first, count(*) AS units, sum(n)::BIGINT AS tokens, bool_and(n <= 100) AS whole FROM r GROUP BY doc_id, g",
    "table_pieces": _pieces("'| ' || turn || ' | ' || w || ' |'", "'| turn | words |' || chr(10) || '|---|---|'", "''"),
    "code_pieces": _pieces("'say(' || turn || ') ' || w", "'```py'", "'```'"),
    "paragraph_packing": f"WITH RECURSIVE {BASE_SQL}, {chunk_sql.chunked(_PARAGRAPHS, MIN_TOKENS, MAX_TOKENS)} SELECT doc::BIGINT AS doc_id, chunk_index, token_count, length(content) AS chars, sha256(content) AS hash FROM done",
    "chunk_markdown": f"WITH RECURSIVE {chunk_sql.TURN_LEVELS}, {chunk_sql.chunked(chunk_sql.TALKS, 20, 60)} SELECT doc::BIGINT AS conv_id, chunk_index, heading_path, token_count, sha256(content) AS hash FROM done",
    "replace_chunks": _w(STORED, DIFF) + " SELECT doc_id, 0::BIGINT AS chunk_index, 'old' AS generation FROM diff WHERE change NOT IN ('added', 'updated') UNION ALL SELECT doc_id, unnest(range(len(string_split(content, chr(10)))))::BIGINT, 'new' FROM diff WHERE change IN ('added', 'updated')",
    "ingest_balance": _w(STORED, DIFF, "st AS (SELECT CASE WHEN length(content) < 40 THEN 'skipped_stub' ELSE change END AS s FROM diff)")
    + " SELECT count(*) AS walked, count(*) FILTER (s = 'added') AS added, count(*) FILTER (s IN ('updated', 'reactivated')) AS updated, count(*) FILTER (s = 'unchanged') AS unchanged, count(*) FILTER (s = 'skipped_stub') AS skipped_stub, 0::BIGINT AS skipped_empty, 0::BIGINT AS errored, count(*) FILTER (s IN ('added', 'updated')) AS chunks_written, true AS balanced FROM st",
    "department_counts": _w() + " SELECT department, count(*) AS n FROM chunks GROUP BY department",
    "chunks_per_department": _w() + r" SELECT department, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT department, unnest(string_split(content, chr(10))) AS line FROM chunks) WHERE regexp_replace(line, '\s', '', 'g') <> '' GROUP BY department",
    "seeded_sample": _w() + " SELECT doc_id, source_path FROM docs ORDER BY sha256('42:' || doc_id), doc_id LIMIT 5",
    "acl_by_user": _w(PEOPLE) + " SELECT email, unnest(CASE WHEN len(departments) > 0 THEN departments ELSE [NULL] END) AS department FROM customers_as_users",
    "acl_by_role": _w(PEOPLE) + " SELECT role, n_users, unnest(departments) AS department FROM role_departments JOIN (SELECT role, count(*) AS n_users FROM held GROUP BY role) USING (role)",
    "acl_unknown_user": _w(PEOPLE) + " SELECT e.email, u.id AS user_id, len(coalesce(u.departments, []))::BIGINT AS n_departments FROM (SELECT DISTINCT 'Customer#' || lpad((user_id * 7)::VARCHAR, 9, '0') AS email FROM events) e LEFT JOIN customers_as_users u USING (email)",
    "role_seed_lateral": _w(PEOPLE) + " SELECT role AS name, count(*) AS n_grants FROM held JOIN grants USING (role) GROUP BY role",
    "identity_seed": _w(PEOPLE) + " SELECT email, role FROM held",
    "golden_seed_antijoin": f"WITH {TURNS} SELECT * FROM turns n WHERE NOT EXISTS (SELECT 1 FROM turns o WHERE o.conv_id % 5 = 0 AND o.question IS NOT DISTINCT FROM n.question AND o.email IS NOT DISTINCT FROM n.email)",
    "seed_twice": f"WITH {TURNS} SELECT DISTINCT question, email FROM turns",
    "allowlist_duplicates": _w() + " SELECT department, count(DISTINCT folder) AS n, count(*) AS n_docs FROM docs GROUP BY department HAVING count(DISTINCT folder) > 1",
    "outcome_migration": "SELECT CASE turn % 3 WHEN 0 THEN 'refused_by_floor' WHEN 1 THEN 'answered' END AS outcome, count(*) AS n FROM conversations GROUP BY 1",
    "dense_topk_one_department": _w() + " SELECT chunk_id, round(s, 6) AS dense_score FROM (SELECT chunk_id, list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS s FROM emb e, embeddings v WHERE v.vec_id = 0 AND department = 'finance') ORDER BY s DESC, chunk_id LIMIT 25",
    "cosine_scores": "SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM embeddings e, embeddings v WHERE v.vec_id = 2",
    "dense_topk_per_department": _w(DENSE) + " SELECT qid, department, chunk_id, round(dense_score, 6) AS dense_score, rank_in_department FROM dense",
    "stored_topk_active": _w(DENSE.replace("JOIN emb e", "JOIN (SELECT * FROM emb WHERE chunk_id % 11 <> 0) e").replace("<= 25", "<= 5"))
    + " SELECT qid, department, chunk_id, round(dense_score, 6) AS dense_score FROM dense WHERE qid IN (SELECT qid FROM asked WHERE asker = 'role')",
    "dense_global_rank": _w(DENSE) + " SELECT qid, chunk_id, department, dense_rank FROM dense_ranked",
    "lexical_match_all_terms": _w(LEXICAL) + " SELECT qid, chunk_id, department, lexical_score FROM matched",
    "lexical_topk": _w(LEXICAL) + " SELECT qid, chunk_id, department, lexical_score, lexical_rank FROM lexical",
    "blockmax_topk": _w(LEXICAL) + " SELECT qid, chunk_id, department, lexical_score, lexical_rank FROM lexical",
    "vector_index_topk": _w(DENSE) + " SELECT qid, department, chunk_id, round(dense_score, 6) AS dense_score, rank_in_department FROM dense",
    "term_statistics": _w(LEXICAL) + " SELECT department, count(DISTINCT term) AS terms, count(*) AS postings, sum(n)::BIGINT AS occurrences FROM postings GROUP BY department",
    "hybrid_rrf": _w(HYBRID) + " SELECT qid, chunk_id, department, round(dense_score, 6) AS dense_score, dense_rank, lexical_rank, round(rrf_score, 6) AS rrf_score, rank FROM hybrid",
    "rerank_topk": _w(RERANK) + " SELECT qid, n, chunk_id, round(rerank_score, 6) AS rerank_score, round(rrf_score, 6) AS rrf_score FROM final",
    "plain_topk": _w(HYBRID) + " SELECT qid, rank AS n, chunk_id FROM hybrid WHERE rank <= 8",
    "acl_clean": _w(HYBRID, CLEAN) + " SELECT qid, array_to_string(pool, ',') AS pool_departments, acl_clean FROM clean",
    "acl_violations": _w(HYBRID) + " SELECT count(*) AS n FROM hybrid h WHERE NOT EXISTS (SELECT 1 FROM allow a WHERE a.qid = h.qid AND a.department = h.department)",
    "refusal_floor": _w(DONE) + " SELECT qid, round(best, 6) AS best, refused FROM best",
    "prompt_evidence": _w(RERANK)
    + """ SELECT f.qid, count(*) AS n_excerpts, sha256('Answer the question using only the evidence below.' || chr(10) || chr(10) || '<question>' || chr(10) || q.question || chr(10) || '</question>' || chr(10) || chr(10) || '<evidence>' || chr(10)
      || string_agg('<excerpt number="' || n || '" source="' || heading_path || '">' || chr(10) || content || chr(10) || '</excerpt>', chr(10) || chr(10) ORDER BY n) || chr(10) || '</evidence>') AS message_hash FROM final f JOIN questions q USING (qid) GROUP BY f.qid, q.question""",
    "streamed_answers": _w(RERANK) + " SELECT qid, sha256(string_agg(string_split(content, chr(10))[1] || ' [' || n || ']', chr(10) ORDER BY n)) AS answer_hash FROM final GROUP BY qid",
    "sunk_messages": "SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS conversation_id, role, sha256(text) AS hash FROM conversations",
    "generated_answers": _w(DONE) + " SELECT qid, answer, stop_reason, stop_reason = 'max_tokens' AS truncated FROM done WHERE NOT refused",
    "citations": _w(DONE) + r" SELECT qid, n, chunk_id, source_path FROM (SELECT qid, unnest(list_distinct(list_transform(regexp_extract_all(answer, '\[([0-9]{1,2})\]', 1), lambda x: x::BIGINT))) AS n FROM answers) JOIN final USING (qid, n)",
    "citation_extract": r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || turn || '][12] [12] [345] [a]', '\[([0-9]{1,2})\]', 1), lambda x: x::INT))), ',') AS numbers FROM conversations",
    "outcome_classify": _w(DONE) + " SELECT qid, outcome FROM done",
    "outcome_histogram": _w(DONE) + " SELECT outcome, count(*) AS n FROM done GROUP BY outcome",
    "trace_rows": _w(DONE)
    + " SELECT d.question AS raw_query, d.user_id, d.outcome, f.n - 1 AS place, f.chunk_id::VARCHAR AS chunk_id, round(f.rrf_score, 6) AS rrf_score, round(f.rerank_score, 6) AS rerank_score, CASE WHEN f.n IS NOT NULL AND d.outcome <> 'refused_by_floor' THEN true END AS in_prompt FROM done d LEFT JOIN final f USING (qid)",
    "trace_payload": _w(DONE)
    + """ SELECT d.question AS raw_query, d.user_id, count(f.n) OVER (PARTITION BY d.qid) AS n, CASE WHEN f.n IS NOT NULL AND d.outcome <> 'refused_by_floor' THEN 'true' END AS marked, f.n - 1 AS place, f.chunk_id::VARCHAR AS chunk_id, f.department,
      round(f.dense_score, 6) AS dense_score, f.dense_rank, f.lexical_rank, round(f.rrf_score, 6) AS rrf_score, round(f.rerank_score, 6) AS rerank_score FROM done d LEFT JOIN final f USING (qid)""",
    "path_recall": _w(METRICS) + " SELECT qid, round(recall_wide, 6) AS recall_wide, round(recall_final, 6) AS recall_final FROM metrics",
    "any_recall": _w(METRICS) + " SELECT qid, recall_wide > 0 AS any_recall_wide, recall_final > 0 AS any_recall_final FROM metrics",
    "eval_summary": _w(METRICS)
    + " SELECT count(*) AS n, count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'refused_by_floor') AS refused_by_floor, count(*) FILTER (outcome = 'refused_by_model') AS refused_by_model, round(avg(refusal_correct::INT), 4) AS refusal_correct, round(avg(acl_clean::INT), 4) AS acl_clean, round(avg(recall_wide), 4) AS recall_wide, round(avg(recall_final), 4) AS recall_final FROM metrics",
    "eval_by_category": _w(METRICS)
    + " SELECT category, count(*) AS n, round(avg((recall_wide > 0)::INT), 3) AS any_recall_wide, round(avg((recall_final > 0)::INT), 3) AS any_recall_final, round(avg(refusal_correct::INT), 3) AS refusal_correct, round(avg(acl_clean::INT), 3) AS acl_clean FROM metrics GROUP BY category",
    "judge_verdicts": """WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
      w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(before), '[^a-z0-9]+'), lambda x: x <> '')) AS r, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS a FROM t WHERE role = 'assistant' AND before IS NOT NULL)
      SELECT conv_id, turn, CASE WHEN len(r) > 0 THEN len(list_intersect(r, a))::DOUBLE / len(r) >= 0.05 END AS judged, starts_with(upper(trim(' correct: ' || text)), 'CORRECT') AS verdict FROM w""",
    "latest_runs": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at, o_orderstatus AS status FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 5",
    "eval_results_upsert": "SELECT conv_id, turn % 3 AS question_id, max(turn) AS turn FROM conversations GROUP BY 1, 2",
    "token_count": f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}'))::BIGINT AS tokens FROM documents",
    "token_percentiles": _w(_SIZED, "o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM sized)") + " SELECT share::DOUBLE AS share, t AS tokens FROM o, (VALUES (0.5), (0.95), (1.0)) s(share) WHERE i = least(floor(n * share), n - 1)",
    "token_outliers": _w(_SIZED) + " SELECT count(*) AS n, count(*) FILTER (t < 50) AS tiny, count(*) FILTER (t > 800) AS huge, max(t) AS most FROM sized",
    "oversize_report": _w(_SIZED) + " SELECT department, source_path, t AS token_count FROM sized WHERE t > 800",
    "force_split": f"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS p FROM documents),
      w AS (SELECT *, ceil(len(p) / ceil(len(p) / 800.0))::BIGINT AS size FROM p),
      u AS (SELECT doc_id, text, p, size, unnest(range(CASE WHEN len(p) <= 800 THEN 1 ELSE ceil(len(p) / size::DOUBLE)::BIGINT END)) AS place FROM w),
      x AS (SELECT doc_id, place, CASE WHEN len(p) <= 800 THEN text ELSE array_to_string(p[place * size + 1 : (place + 1) * size], '') END AS piece FROM u)
      SELECT doc_id, place, length(piece) AS chars, sha256(piece) AS hash FROM x""",
    "line_sections": "WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations), k AS (SELECT conv_id, turn, CASE WHEN ls[-1] = '' THEN ls[1:-2] ELSE ls END AS ls FROM l) SELECT conv_id, turn, place, length(ls[place + 1]) AS chars FROM (SELECT *, unnest(range(len(ls))) AS place FROM k)",
    "sentence_split": r"WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM conversations) SELECT conv_id, turn, len(s) AS n, sha256(array_to_string(s, '|')) AS hash FROM s",
    "stub_filter": r"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), chr(10)), lambda x: trim(x) <> '' AND trim(x)[1] NOT IN ('-', '*', '{')) AS ls FROM documents),
      c AS (SELECT doc_id, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0)::BIGINT AS prose_chars FROM p) SELECT doc_id, prose_chars, prose_chars < 200 AS stub FROM c""",
    "analysed_terms": "WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS ts FROM documents) SELECT doc_id, len(ts) AS n_terms, sha256(array_to_string(ts, ' ')) AS hash FROM t",
    "common_prefix": """WITH p AS (SELECT page_id, string_split(url, '/') AS a FROM pages), pairs AS (SELECT x.page_id, x.a, y.a AS b FROM p x JOIN p y ON x.page_id = y.page_id + 1)
SELECT page_id, array_to_string(a[1:len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))], '/') AS prefix FROM pairs""",
    "shortcode_clean": """WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM conversations)
SELECT conv_id, turn, sha256(CASE turn % 5 WHEN 0 THEN 'a Yes ' || t || ' No [x]' WHEN 1 THEN 'i ' || t || ' n p' WHEN 2 THEN 'x $1 included Yes ' || t || ' [included: none.md]'
  WHEN 3 THEN 'one' || chr(10) || chr(10) || t || '  two' ELSE 'z ' || t || ' z' END) AS hash FROM t""",
    "delink": "SELECT page_id, 'see it and that' AS t FROM pages",
    "resolve_title": _w() + """ SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Given ' || folder WHEN doc_id % 8 = 1 THEN 'Own' WHEN doc_id % 2 = 0 THEN 'On Call ' || doc_id || 'Rd'
  ELSE array_to_string(list_transform(string_split(replace(folder, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS title FROM docs""",
    "walk_filter": _w() + """ SELECT folder || n || doc_id || '.md' AS relative_path, department, 'content/handbook/' || folder || n || doc_id || '.md' AS source_path
FROM (SELECT *, ['/', '/sub/_index', '/.x', NULL, NULL, '/a/b/'][(doc_id % 6 + 1)::INT] AS n FROM docs) WHERE n IS NOT NULL AND doc_id % 19 <> 0""",
    "normalised_vectors": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM e) SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS norm, round(e[1] / n, 6) AS first FROM n",
}
