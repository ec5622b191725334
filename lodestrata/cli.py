"""Commands: ingest, stats, retrieve, ask, eval load, eval run; ``python -m lodestrata.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import FINAL_K, MAX_TOKENS, MIN_TOKENS, PROMPT_VERSION, Settings, load_allowlist
from lodestrata.functions import chunking, providers
from lodestrata.operators import acl, answer, evals, fusion, ingest, rerank, search
from lodestrata.operators.vector_index import VectorIndex
from lodestrata.session import local_session
from lodestrata.sources import corpus, seeds
from lodestrata.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata")
    p.add_argument("--store", default="./lodestrata-store")
    c = p.add_subparsers(dest="command", required=True)
    i = c.add_parser("ingest", help="bring the store up to date with a corpus folder")
    s = c.add_parser("stats", help="walk and chunk a corpus folder and report, without a store")
    for x in (i, s):
        x.add_argument("root")
        x.add_argument("--department", action="append")
        x.add_argument("--includes")
        x.add_argument("--allowlist")
        x.add_argument("--min-tokens", type=int, default=MIN_TOKENS)
        x.add_argument("--max-tokens", type=int, default=MAX_TOKENS)
    i.add_argument("--force", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    s.add_argument("--sample", type=int, default=5)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--show-skipped", action="store_true")
    s.add_argument("--oversize-report-at", type=int, default=MAX_TOKENS)
    r = c.add_parser("retrieve", help="the hits for one question under roles")
    r.add_argument("question")
    r.add_argument("--role", action="append", required=True)
    r.add_argument("--top-k", type=int, default=8)
    r.add_argument("--no-rerank", action="store_true")
    a = c.add_parser("ask", help="an answer with citations")
    a.add_argument("question")
    who = a.add_mutually_exclusive_group(required=True)
    who.add_argument("--email")
    who.add_argument("--role")
    a.add_argument("--top-k", type=int, default=FINAL_K)
    e = c.add_parser("eval", help="golden questions").add_subparsers(dest="what", required=True)
    load = e.add_parser("load")
    load.add_argument("yaml")
    run = e.add_parser("run")
    run.add_argument("--retrieval-only", action="store_true")
    run.add_argument("--category")
    run.add_argument("--final-k", type=int, default=FINAL_K)
    return p


class Session:
    """A store's tables in the shapes that the operators take, with the offline providers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        docs = self.store.read("documents").select(F.col("id").alias("d_id"), "source_path")
        chunks = self.store.read("chunks").where("status = 'active'")
        self.chunks = chunks.join(docs, F.col("document_id") == F.col("d_id")).select(F.col("id").alias("chunk_id"), "department", "content", "heading_path", "source_path", "status")
        self.embeddings, self.terms, self.cells = self.store.read("chunk_embeddings"), self.store.read("chunk_terms"), VectorIndex(self.store)
        self.users = acl.by_email(seeds.users(spark), seeds.user_roles(spark), seeds.role_department_access(spark))
        self.roles = acl.by_role(seeds.roles(spark), seeds.role_department_access(spark))

    def embedded(self, questions: DataFrame) -> DataFrame:
        return questions.withColumn("vector", providers.offline_embedder()(F.col("question")))

    def hits(self, questions: DataFrame, pool: int = 25) -> DataFrame:
        return fusion.Retriever(search.TableBackend(self.embeddings, self.chunks, english=True, terms=self.terms, cells=self.cells), self.users, self.roles).retrieve(questions, top_k=pool)

    def final(self, hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        return rerank.rerank(rerank.pairs(hits, questions, self.chunks), top_k=k)


QUESTION = "qid string, question string, email string, role string, category string, expect_refusal boolean, expected_doc_paths array<string>, expected_answer string"


def one(spark: SparkSession, text: str, email: str | None, role: str | None) -> DataFrame:
    return spark.createDataFrame([("q", text, email, role, None, False, [], None)], QUESTION)


def stats(spark: SparkSession, args) -> None:
    settings = Settings(min_tokens=args.min_tokens, max_tokens=args.max_tokens)
    files = corpus.walked(corpus.read_tree(spark, args.root), load_allowlist(args.allowlist), args.department)
    made = ingest.transformed(corpus.parsed(files), settings, corpus.includes(spark, args.includes) if args.includes else None).cache()
    print(made.groupBy(F.coalesce("state", F.lit("parsed")).alias("state")).count().orderBy("state").toPandas().to_string(index=False))
    chunks = chunking.exploded(made.where("state is null").select("source_path", "department", "chunks"))
    print(chunks.groupBy("department").count().orderBy(F.desc("count"), "department").toPandas().to_string(index=False))
    print(evals.percentile_index(chunks, "token_count", [0.5, 0.95, 1.0]).toPandas().to_string(index=False))
    print(ingest.token_report(chunks, args.oversize_report_at).toPandas().to_string(index=False))
    ingest.offenders(chunks, args.oversize_report_at).select("token_count", "department", "source_path").show(20, truncate=80)
    ingest.sampled(chunks.withColumn("key", F.concat_ws("#", "source_path", "chunk_index")), "key", args.sample, args.seed).select("source_path", "heading_path", "token_count").show(truncate=80)
    if args.show_skipped:
        made.where("state is not null").select("source_path", "state", "error").show(1000, truncate=120)


def ask(spark: SparkSession, args) -> None:
    s = Session(spark, args.store)
    questions = s.embedded(one(spark, args.question, args.email, args.role))
    asked = acl.askers(questions, s.users, s.roles)
    if args.email and not asked.where("user_id is not null").count():
        raise SystemExit(f"unknown user: {args.email}")
    took: dict[str, float] = {}

    def timed(stage: str, rows: DataFrame) -> DataFrame:
        began = time.perf_counter()
        rows = rows.cache()
        rows.count()
        took[stage] = round(1000 * (time.perf_counter() - began), 1)
        return rows

    wide = timed("retrieve", s.hits(questions))
    hits = timed("rerank", s.final(wide, questions, args.top_k))
    done = timed("llm", answer.answered(asked, hits))
    at = datetime.now(UTC).isoformat(sep=" ")
    s.store.append("query_traces", answer.traces(done, hits, at, latency_ms=took))
    row = done.first()
    print(row["answer"] or "No answer: nothing that may be shown is close enough.")
    if row["answer"]:
        answer.citations(done.select("qid", "answer"), hits).select("n", "heading_path", "source_path").orderBy("n").show(truncate=False)


def eval_load(spark: SparkSession, args) -> None:
    rows = corpus.golden_from_yaml(spark, args.yaml).withColumn("id", seeds.stable_id("question", F.coalesce("ask_as_role", F.lit("")), F.coalesce("ask_as_email", F.lit(""))))
    new, old = Store(spark, args.store).upsert("golden_questions", rows.withColumn("created_at", F.lit(datetime.now(UTC)).cast("timestamp")))
    print(f"{new} inserted, {old} updated")


def eval_run(spark: SparkSession, args) -> None:
    s = Session(spark, args.store)
    golden = s.store.read("golden_questions")
    golden = golden.where(F.col("category") == args.category) if args.category else golden
    questions = s.embedded(golden.select(F.col("id").alias("qid"), "question", F.col("ask_as_email").alias("email"), F.col("ask_as_role").alias("role"), "category", "expect_refusal", "expected_doc_paths", "expected_answer"))
    asked = acl.askers(questions, s.users, s.roles).cache()
    wide = s.hits(questions).cache()
    final = s.final(wide, questions, args.final_k).cache()
    if args.retrieval_only:
        done = answer.floored(asked, final).withColumn("outcome", F.when(F.col("refused"), "refused_by_floor").otherwise("answered"))
    else:
        done = answer.answered(asked, final)
    rows = evals.metrics(done, wide.join(s.chunks.select("chunk_id", "source_path"), "chunk_id"), final, evals.acl_clean(asked, wide)).cache()
    total = evals.summary(rows).first().asDict()
    run_id = uuid.uuid4().hex
    numbers = F.create_map(*[x for k, v in total.items() for x in (F.lit(k), F.lit(None if v is None else float(v)).cast("double"))])
    run = spark.range(1).select(F.lit(run_id).alias("id"), F.lit(datetime.now(UTC)).cast("timestamp").alias("started_at"), F.lit(PROMPT_VERSION).alias("prompt_version"), F.create_map(F.lit("final_k"), F.lit(str(args.final_k))).alias("config"), numbers.alias("summary"))
    s.store.append("eval_runs", run)
    keep = ["refusal_correct", "acl_clean", "recall_wide", "recall_final"]
    results = rows.select(F.lit(run_id).alias("run_id"), F.col("qid").alias("question_id"), F.create_map(*[x for k in keep for x in (F.lit(k), F.col(k).cast("double"))]).alias("metrics"))
    s.store.upsert("eval_results", results)
    print(json.dumps(total | {"skipped": asked.where("asker is null").count()}))
    evals.by_category(rows).orderBy("category").show()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if args.command == "ingest":
        run = ingest.Ingest(spark, Store(spark, args.store), args.root, args.includes, load_allowlist(args.allowlist), Settings(min_tokens=args.min_tokens, max_tokens=args.max_tokens))
        print(json.dumps(run.run(args.department, args.force, args.dry_run).stats))
    elif args.command == "stats":
        stats(spark, args)
    elif args.command == "retrieve":
        s = Session(spark, args.store)
        questions = s.embedded(one(spark, args.question, None, "asked"))
        s.roles = spark.createDataFrame([("asked", sorted({d for r in s.roles.collect() if r["role"] in args.role for d in r["departments"]}))], "role string, departments array<string>")
        hits = s.hits(questions)
        pairs = rerank.pairs(hits, questions, s.chunks)
        shown = rerank.plain(pairs, args.top_k) if args.no_rerank else rerank.rerank(pairs, top_k=args.top_k)
        shown.select("n", "department", "heading_path", "dense_rank", "lexical_rank", "rrf_score", "rerank_score").orderBy("n").show(args.top_k, truncate=60)
    elif args.command == "ask":
        ask(spark, args)
    elif args.what == "load":
        eval_load(spark, args)
    else:
        eval_run(spark, args)


if __name__ == "__main__":
    main()
