"""Evaluation over golden questions: recall, refusals, permissions, judges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import analysis
from lodestrata.sources.shared import kept, small


def covered(expected: Column, paths: Column) -> Column:
    """Those expected prefixes that some path begins with (taken literally)."""
    return F.filter(expected, lambda e: F.exists(paths, lambda p: p.startswith(e)))


def recall(expected: Column, paths: Column) -> Column:
    """The share of expected prefixes that are covered; null where nothing is expected."""
    n = F.size(F.coalesce(expected, F.array().cast("array<string>")))
    return F.when(n > 0, F.size(covered(expected, paths)) / n)


def any_recall(expected: Column, paths: Column) -> Column:
    n = F.size(F.coalesce(expected, F.array().cast("array<string>")))
    return F.when(n > 0, F.size(covered(expected, paths)) > 0)


def retrieved_paths(questions: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """questions with the distinct source paths of their hits (a pool's size at most)."""
    got = hits.groupBy(F.col("qid").alias("p_qid")).agg(F.array_sort(F.collect_set("source_path")).alias(name))
    return questions.join(got, F.col("qid") == F.col("p_qid"), "left").drop("p_qid").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def pool_departments(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid").agg(F.array_sort(F.collect_set("department")).alias("pool_departments"))


def acl_clean(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, pool_departments, acl_clean: whether all departments of the pool are the asker's."""
    got = pool_departments(hits).withColumnRenamed("qid", "h_qid")
    both = asked.select("qid", "departments").join(got, F.col("qid") == F.col("h_qid"), "left")
    pool = F.coalesce("pool_departments", F.array().cast("array<string>"))
    return both.select("qid", pool.alias("pool_departments"), (F.size(F.array_except(pool, F.col("departments"))) == 0).alias("acl_clean"))


def offline_judge(reference: Column, answer: Column, least: float = 0.5) -> Column:
    """A stand-in judge: the share of the reference's words that the answer has reaches least."""
    words = analysis.terms(reference)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, analysis.terms(answer))) / F.size(words) >= least)


def verdict(reply: Column) -> Column:
    """Whether a judge's reply says CORRECT."""
    return F.upper(F.trim(reply)).startswith("CORRECT")


def metrics(done: DataFrame, wide: DataFrame, final: DataFrame, clean: DataFrame) -> DataFrame:
    """A row an evaluated question: refusal_correct, acl_clean, recalls of the wide pool and of the final hits.

    done has outcome, expect_refusal, expected_doc_paths, category, asker; questions without an asker are skipped.
    """
    rows = retrieved_paths(retrieved_paths(done.where("asker is not null"), wide, "wide_paths"), final, "final_paths")
    rows = rows.join(clean.select(F.col("qid").alias("c_qid"), "acl_clean"), F.col("qid") == F.col("c_qid"), "left").drop("c_qid")
    want = F.col("expected_doc_paths")
    return rows.withColumn("refusal_correct", (F.col("outcome") != "answered") == F.col("expect_refusal")).withColumn("recall_wide", recall(want, F.col("wide_paths"))).withColumn("recall_final", recall(want, F.col("final_paths"))).withColumn(
        "any_recall_wide", any_recall(want, F.col("wide_paths"))
    ).withColumn("any_recall_final", any_recall(want, F.col("final_paths")))


def _mean(c: str, places: int) -> Column:
    return F.round(F.avg(F.col(c).cast("double")), places).alias(c)


def summary(rows: DataFrame) -> DataFrame:
    """n, outcomes, and means over questions where a metric is defined; null without any."""
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "answered").alias("answered"), F.count_if(F.col("outcome") == "refused_by_floor").alias("refused_by_floor"), F.count_if(F.col("outcome") == "refused_by_model").alias("refused_by_model"),
        _mean("refusal_correct", 4), _mean("acl_clean", 4), _mean("recall_wide", 4), _mean("recall_final", 4),
    )


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"), *[_mean(c, 3) for c in ("any_recall_wide", "any_recall_final", "refusal_correct", "acl_clean")])


def outcome_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


def passed(refusal_correct: Column, clean: Column) -> Column:
    return refusal_correct & clean


def latest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def percentile_index(values: DataFrame, value: str, shares: list[float], key: list[str] | None = None) -> DataFrame:
    """The value at 0-based place floor(n * share) of the sorted values, the last at most; a row a share (and key).

    Values are counted, dealt by ranges and sorted; one sum a range tells which range holds a place, and only those ranges are looked into,
    so no task orders all values, however many are distinct. Nulls have no place.
    """
    key = key or []
    pid, before, n = "__pid", "__before", "__n"
    counts = values.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("c"))
    held = kept(counts.repartitionByRange(*key, value).sortWithinPartitions(*key, value).withColumn(pid, F.spark_partition_id()))
    sums = held.groupBy(*key, pid).agg(F.sum("c").alias("s"))  # a row a range (and key)
    by = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1))
    starts = sums.withColumn(before, F.sum("s").over(by.orderBy(pid)) - F.col("s")).withColumn(n, F.sum("s").over(by))
    asked = starts.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("place", F.least(F.floor(F.col(n) * F.col("share")), F.col(n) - 1))
    wanted = asked.where((F.col("place") >= F.col(before)) & (F.col("place") < F.col(before) + F.col("s"))).select(*[F.col(k).alias(f"__{k}") for k in key], F.col(pid).alias("__of"), before, "share", "place")
    on = F.col(pid) == F.col("__of")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = held.join(small(wanted), on)
    running = own.withColumn("upto", F.col(before) + F.sum("c").over(Window.partitionBy(*key, pid, "share").orderBy(value)))
    return running.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place"))).select(*key, "share", F.col(value).cast("long").alias("tokens"))
