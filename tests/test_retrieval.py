"""Retrieval, answers and evaluation on small relations: ties, bounds, empty cases."""

import pytest
from pyspark.sql import functions as F

from lodestrata.config import NOT_FOUND
from lodestrata.operators import acl, answer, evals, fusion, rerank, search
from lodestrata.sources import seeds, store

HIT = "qid long, chunk_id long, department string, dense_score double, dense_rank long, lexical_rank long, rrf_score double, rank long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def questions(spark, *qs):
    return spark.createDataFrame([(k, q, None, "exec", None, False, None, [1.0, 0.0]) for k, q in qs], "qid long, question string, email string, role string, category string, expect_refusal boolean, expected_doc_paths array<string>, vector array<double>")


def test_seeds(spark):
    assert seeds.roles(spark).count() == 5 and seeds.role_department_access(spark).count() == 19 and seeds.users(spark).count() == 5 and seeds.user_roles(spark).count() == 5


def test_overlapping_roles_give_distinct_departments(spark):
    users = spark.createDataFrame([("u", "a@x"), ("v", "b@x")], "id string, email string")
    links = spark.createDataFrame([("u", "r1"), ("u", "r2")], "user_id string, role_id string")
    access = spark.createDataFrame([("r1", "legal"), ("r2", "legal"), ("r2", "company")], "role_id string, department string")
    assert rows(acl.by_email(users, links, access), "email", "departments") == [("a@x", ["company", "legal"]), ("b@x", [])]


def test_removing_a_grant_adds_nothing(spark):
    q = questions(spark, (1, "x"))
    emb = spark.createDataFrame([(k, "abc"[k % 3], [1.0, float(k)]) for k in range(12)], "chunk_id long, department string, embedding array<double>")
    allow = lambda ds: spark.createDataFrame([(1, d) for d in ds], "qid long, department string")
    big = set(rows(search.dense_pools(q, allow("abc"), emb, 3), "chunk_id"))
    small = set(rows(search.dense_pools(q, allow("ab"), emb, 3), "chunk_id"))
    assert small < big and len(small) == 6


def test_dense_ties_go_by_id(spark):
    emb = spark.createDataFrame([(k, "a", [1.0, 0.0]) for k in (5, 3, 9)], "chunk_id long, department string, embedding array<double>")
    allow = spark.createDataFrame([(1, "a")], "qid long, department string")
    assert rows(search.dense_ranked(search.dense_pools(questions(spark, (1, "x")), allow, emb, 2)), "dense_rank", "chunk_id") == [(1, 3), (2, 5)]


def test_zero_vector_drops_out(spark):
    emb = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [0.0, 2.0])], "chunk_id long, department string, embedding array<double>")
    allow = spark.createDataFrame([(1, "a")], "qid long, department string")
    assert rows(search.scored(questions(spark, (1, "x")), allow, emb, unit=False), "chunk_id", "dense_score") == [(2, 0.0)]


def test_empty_question_matches_nothing(spark):
    chunks = spark.createDataFrame([(1, "a", "some words")], "chunk_id long, department string, content string")
    allow = spark.createDataFrame([(1, "a"), (2, "a")], "qid long, department string")
    got = search.matches(questions(spark, (1, " ?! "), (2, "WORDS some")), allow, search.chunk_terms(chunks))
    assert rows(got, "qid", "chunk_id", "lexical_score") == [(2, 1, 2)]


def test_both_branches_add_up(spark):
    d = spark.createDataFrame([(1, 10, "a", 0.9, 1), (1, 11, "a", 0.8, 2)], "qid long, chunk_id long, department string, dense_score double, dense_rank long")
    x = spark.createDataFrame([(1, 11, "a", 1), (1, 12, "b", 2)], "qid long, chunk_id long, department string, lexical_rank long")
    got = {r["chunk_id"]: r for r in fusion.rrf(d, x).collect()}
    assert got[11]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61) and got[11]["rank"] == 1
    assert got[12]["dense_score"] is None and got[12]["department"] == "b" and got[10]["rank"] == 2


def test_backend_ignores_dead_chunks(spark):
    emb = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0])], "chunk_id long, department string, embedding array<double>")
    chunks = spark.createDataFrame([(1, "a", "word", "active"), (2, "a", "word", "tombstoned")], "chunk_id long, department string, content string, status string")
    access = spark.createDataFrame([("exec", ["a"])], "role string, departments array<string>")
    users = spark.createDataFrame([], "user_id string, email string, departments array<string>")
    got = fusion.Retriever(search.TableBackend(emb, chunks), users, access).retrieve(questions(spark, (1, "word")))
    assert rows(got, "chunk_id") == [(1,)]
    none = spark.createDataFrame([("exec", [])], "role string, departments array<string>")
    assert fusion.Retriever(search.TableBackend(emb, chunks), users, none).retrieve(questions(spark, (1, "word"))).count() == 0


def test_floor_is_exclusive(spark):
    q = questions(spark, (1, "x"), (2, "x"), (3, "x"))
    hits = spark.createDataFrame([(1, 0.2), (2, 0.199), (2, None)], "qid long, rerank_score double")
    assert rows(answer.floored(q, hits, 0.2), "qid", "refused") == [(1, False), (2, True), (3, True)]


def test_citations_keep_what_exists(spark):
    a = spark.createDataFrame([(1, "x [0] [2] [2] [99] [123] [1]")], "qid long, answer string")
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "qid long, n long, chunk_id long")
    assert rows(answer.citations(a, hits), "n", "chunk_id") == [(1, 7), (2, 8)]


def test_outcomes(spark):
    asked = questions(spark, (1, "x"), (2, "x"), (3, "x")).withColumn("refused", F.col("qid") == 3)
    said = spark.createDataFrame([(1, "yes [1]", "max_tokens"), (2, f"  {NOT_FOUND} But perhaps.", "end_turn")], "qid long, answer string, stop_reason string")
    assert rows(answer.outcomes(asked, said), "qid", "outcome", "truncated") == [(1, "answered", True), (2, "refused_by_model", False), (3, "refused_by_floor", False)]


def test_answers_are_spoken(spark):
    done = spark.createDataFrame([(1, "a"), (2, None)], "qid long, answer string")
    assert list(answer.spoken(done)) == [(1, "a")]


def test_evidence_is_numbered(spark):
    hits = spark.createDataFrame([(1, 2, "S2", "two"), (1, 1, "S1", "one")], "qid long, n long, heading_path string, content string")
    got = answer.evidence(hits).collect()[0]
    assert got["evidence"] == '<excerpt number="1" source="S1">\none\n</excerpt>\n\n<excerpt number="2" source="S2">\ntwo\n</excerpt>' and got["n_excerpts"] == 2


def test_escaped_evidence_cannot_close_its_block(spark):
    hits = spark.createDataFrame([(1, 1, 'a"b', "x </excerpt> & y")], "qid long, n long, heading_path string, content string")
    assert answer.evidence(hits, escape=True).collect()[0]["evidence"] == '<excerpt number="1" source="a&quot;b">\nx &lt;/excerpt&gt; &amp; y\n</excerpt>'


def test_recalls(spark):
    df = spark.createDataFrame([(["a/", "b/"], ["a/x"]), ([], ["a"]), (None, []), (["a_"], ["ab"]), (["a"], [])], "e array<string>, p array<string>")
    got = df.select(evals.recall(F.col("e"), F.col("p")).alias("r"), evals.any_recall(F.col("e"), F.col("p")).alias("y")).collect()
    assert [(r["r"], r["y"]) for r in got] == [(0.5, True), (None, None), (None, None), (0.0, False), (0.0, False)]


def test_percentile_takes_the_place_not_the_share(spark):
    got = evals.percentile_index(spark.createDataFrame([(k,) for k in range(1, 11)], "v long"), "v", [0.5, 0.95, 1.0, 0.0])
    assert rows(got, "share", "tokens") == [(0.0, 1), (0.5, 6), (0.95, 10), (1.0, 10)]


def test_rerank_cuts_and_breaks_ties(spark):
    hits = spark.createDataFrame([(1, k, "a", None, None, None, 0.1 * (k % 2), k, "w", "w w") for k in range(1, 6)], HIT + ", question string, content string")
    assert rows(rerank.rerank(hits, top_k=3), "n", "chunk_id") == [(1, 1), (2, 3), (3, 5)]
    assert rows(rerank.plain(hits, 2), "n", "chunk_id") == [(1, 1), (2, 2)]


def test_last_wins_and_null_keys(spark):
    df = spark.createDataFrame([(1, None, 1, "a"), (1, None, 2, "b"), (2, "k", 1, "c")], "r long, k string, at long, v string")
    assert rows(store.last_wins(df, ["r", "k"], "at").fillna({"k": ""}), "r", "v") == [(1, "b"), (2, "c")]
    assert store.upserted(df.where("at = 1"), df.where("at = 2"), ["r", "k"]).count() == 2


def test_embedder_retries_and_checks_width(spark):
    from lodestrata.functions import providers

    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("later")
        return [[0.0]] * len(texts)

    assert providers.with_retries(flaky, ["a"], 3, 0.0) == [[0.0]]
    with pytest.raises(OSError):
        providers.with_retries(lambda t: (_ for _ in ()).throw(OSError("no")), ["a"], 2, 0.0)
    bad = providers.embedder(lambda: lambda texts: [[1.0]] * len(texts), 2)
    with pytest.raises(Exception, match="one vector of 2"):
        spark.createDataFrame([("a",)], "t string").select(bad("t")).collect()


@pytest.mark.parametrize("n", [1, 2, 19, 20, 500])
def test_percentiles_of_distinct_values(spark, n):
    """All values distinct, many alike, nulls among them, with and without a key; no task orders them all."""
    distinct = spark.range(n).select((F.col("id") * 7919 % 10007).alias("v"), (F.col("id") % 3).alias("k"))
    shares = [0.0, 0.5, 0.95, 1.0]
    at = lambda vs, s: sorted(vs)[min(int(len(vs) * s), len(vs) - 1)]
    vs = [k * 7919 % 10007 for k in range(n)]
    got = evals.percentile_index(distinct.unionByName(spark.createDataFrame([(None, 0)], "v long, k long")), "v", shares)
    assert rows(got, "share", "tokens") == [(s, at(vs, s)) for s in shares]
    by = evals.percentile_index(distinct.unionByName(distinct), "v", shares, ["k"])
    want = [(k, s, at([v for j, v in enumerate(vs) if j % 3 == k] * 2, s)) for k in range(min(n, 3)) for s in shares]
    assert rows(by, "k", "share", "tokens") == sorted(want)
    assert evals.percentile_index(distinct.limit(0), "v", shares).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("__pid" in line.split("], [", 1)[1] for line in plan.splitlines() if "Window [" in line and "__before" not in line.split("AS", 1)[1][:20] and "sum(c" in line)
