"""Who may see which departments, resolved before anything is ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.shared import small


def by_email(users: DataFrame, user_roles: DataFrame, access: DataFrame) -> DataFrame:
    """user_id, email, departments (sorted, distinct) of every user; users without roles have none."""
    grants = user_roles.join(access, "role_id").select("user_id", "department").distinct()
    got = grants.groupBy("user_id").agg(F.array_sort(F.collect_set("department")).alias("departments"))
    return users.select(F.col("id").alias("user_id"), "email").join(got, "user_id", "left").withColumn("departments", F.coalesce("departments", F.array().cast("array<string>")))


def by_role(roles: DataFrame, access: DataFrame) -> DataFrame:
    """role, departments."""
    both = roles.join(access, F.col("id") == F.col("role_id"), "left")
    return both.groupBy(F.col("name").alias("role")).agg(F.array_sort(F.collect_set("department")).alias("departments"))


def resolved(emails: DataFrame, known: DataFrame) -> DataFrame:
    """For each email its user_id and departments; an unknown one has a null id and no departments."""
    return emails.join(known, "email", "left").select("email", "user_id", F.coalesce("departments", F.array().cast("array<string>")).alias("departments"))


def askers(questions: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """questions with asker ("email", "role" or null: to be skipped), user_id and departments; the email counts before the role."""
    u = users.select(F.col("email").alias("u_email"), "user_id", F.col("departments").alias("u_departments"))
    r = roles.select(F.col("role").alias("r_role"), F.col("departments").alias("r_departments"))
    both = questions.join(u, F.col("email") == F.col("u_email"), "left").join(r, F.col("role") == F.col("r_role"), "left")
    none = F.array().cast("array<string>")
    asker = F.when(F.col("email").isNotNull(), "email").when(F.col("role").isNotNull(), "role")
    own = F.when(F.col("email").isNotNull(), F.col("u_departments")).otherwise(F.col("r_departments"))
    return both.withColumn("asker", asker).withColumn("departments", F.coalesce(own, none)).withColumn("user_id", F.when(F.col("email").isNotNull(), F.col("user_id"))).drop("u_email", "u_departments", "r_role", "r_departments")


def allowed(asked: DataFrame) -> DataFrame:
    """qid, department: what the filter joins with."""
    return asked.select("qid", F.explode("departments").alias("department"))


def violations(hits: DataFrame, allow: DataFrame) -> DataFrame:
    """Hits from departments that their question's asker may not see; there should be none."""
    return hits.join(small(allow), ["qid", "department"], "left_anti")
