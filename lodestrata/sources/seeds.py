"""Identity and entitlement relations from the configuration, and idempotent seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import FOLDERS, GRANTS, USERS


def stable_id(*parts) -> Column:
    """An id that a retry makes again: a hash of the business key."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """An inline relation of constants."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def folder_map(spark: SparkSession, folders: dict[str, str] | None = None) -> DataFrame:
    return values(spark, list((folders or FOLDERS).items()), "folder, department")


def roles(spark: SparkSession) -> DataFrame:
    return values(spark, [(r,) for r in GRANTS], "name").select(stable_id(F.lit("role"), "name").alias("id"), "name")


def role_department_access(spark: SparkSession) -> DataFrame:
    """Grants by role name joined with the roles that exist; the constants don't depend on the role row, so it is a plain join."""
    grants = values(spark, [(r, d) for r, ds in GRANTS.items() for d in ds], "role_name, department")
    return roles(spark).join(F.broadcast(grants), F.col("name") == F.col("role_name")).select(F.col("id").alias("role_id"), "department")


def users(spark: SparkSession) -> DataFrame:
    found = values(spark, [(e, e.split("@")[0]) for e in USERS], "email, display_name")
    return found.select(stable_id(F.lit("user"), "email").alias("id"), "email", "display_name")


def user_roles(spark: SparkSession) -> DataFrame:
    pairs = values(spark, list(USERS.items()), "of_email, role_name")
    both = pairs.join(users(spark), F.col("of_email") == F.col("email")).select(F.col("id").alias("user_id"), "role_name")
    return both.join(roles(spark), F.col("role_name") == F.col("name")).select("user_id", F.col("id").alias("role_id"))


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key, nulls equal to nulls, old doesn't have."""
    a, b = new.alias("n"), old.select(*keys).alias("o")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    return a.join(b, on, "left_anti")


def seeded(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and what it lacks of new: seeding twice changes nothing."""
    return old.unionByName(absent(new.dropDuplicates(keys), old, keys), allowMissingColumns=True)


def migrated_outcomes(traces: DataFrame) -> DataFrame:
    """The older value of outcome renamed."""
    return traces.withColumn("outcome", F.when(F.col("outcome") == "not_found", "refused_by_floor").otherwise(F.col("outcome")))


def with_column_if_missing(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
