"""Tenant and project scope, entitlements and column allow-lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.functions.text import is_blank


def scope_tenant(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows of one tenant; without a tenant there are no rows.

    On a table partitioned by ``tenant_id`` the predicate prunes partitions.
    """
    if tenant_id is None or not tenant_id.strip():
        return df.filter(F.lit(False))
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))


def scope_projects(df: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows whose (tenant, project) is granted; an empty scope gives no rows.

    A semi join keeps the scope free to grow: Spark broadcasts it while it is
    below the session threshold and shuffles both sides beyond it.
    """
    return df.join(scope.select("tenant_id", "project_id"), ["tenant_id", "project_id"], "left_semi")


def active_users(users: DataFrame, issuer: str) -> DataFrame:
    return users.filter((F.col("status") == "ACTIVE") & (F.col("issuer") == issuer)).select(
        F.col("id").alias("user_identity_id"), "subject"
    )


def _active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "ACTIVE")


def effective_roles(
    memberships: DataFrame, users: DataFrame, tenants: DataFrame, issuer: str = "issuer"
) -> DataFrame:
    """Distinct (tenant, subject, role) where membership, user and tenant are all active."""
    return (
        _active(memberships)
        .select("tenant_id", "user_identity_id", "role")
        .join(active_users(users, issuer), "user_identity_id")
        .join(_active(tenants).select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi")
        .select("tenant_id", "subject", "role")
        .distinct()
    )


def effective_projects(
    grants: DataFrame, users: DataFrame, tenants: DataFrame, projects: DataFrame, issuer: str = "issuer"
) -> DataFrame:
    """Distinct (tenant, subject, project) where grant, user, tenant and project are all active."""
    return (
        _active(grants)
        .select("tenant_id", "user_identity_id", "project_id")
        .join(active_users(users, issuer), "user_identity_id")
        .join(_active(tenants).select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi")
        .join(_active(projects).select("tenant_id", F.col("id").alias("project_id")), ["tenant_id", "project_id"], "left_semi")
        .select("tenant_id", "subject", "project_id")
        .distinct()
    )


def effective_context(
    claims: DataFrame, users: DataFrame, roles: DataFrame, projects: DataFrame, issuer: str = "issuer"
) -> DataFrame:
    """Claims cut down to what is granted now.

    ``claims`` has (subject, tenant_id, roles, project_ids) with arrays. A claim
    whose subject has not exactly one active identity is rejected. The result
    arrays are sorted and never longer than the arrays of the token.
    """
    identity = (
        active_users(users, issuer)
        .groupBy("subject")
        .agg(F.count("*").alias("identities"), F.min("user_identity_id").alias("user_id"))
        .filter("identities = 1")
        .drop("identities")
    )
    claimed = claims.select("tenant_id", "subject", "roles", "project_ids").withColumn(
        "claim_id", F.xxhash64("tenant_id", "subject", F.to_json(F.struct("roles", "project_ids")))
    )

    def granted(values: str, grants: DataFrame, name: str) -> DataFrame:
        kept = (
            claimed.select("claim_id", "tenant_id", "subject", F.explode(F.array_distinct(values)).alias(name))
            .join(grants, ["tenant_id", "subject", name], "left_semi")
            .groupBy("claim_id", "tenant_id", "subject")
            .agg(F.sort_array(F.collect_set(name)).alias(values))
        )
        return kept

    empty = F.array().cast("array<string>")
    keys = ["claim_id", "tenant_id", "subject"]
    return (
        claimed.select(*keys)
        .join(identity, "subject", "left")
        .join(granted("roles", roles, "role"), keys, "left")
        .join(granted("project_ids", projects, "project_id"), keys, "left")
        .select(
            "tenant_id",
            "subject",
            "user_id",
            F.when(is_blank(F.col("subject")) | F.col("user_id").isNull(), "REJECTED").otherwise("ACCEPTED").alias("outcome"),
            F.when(F.col("user_id").isNotNull(), F.coalesce("roles", empty)).otherwise(empty).alias("roles"),
            F.when(F.col("user_id").isNotNull(), F.coalesce("project_ids", empty)).otherwise(empty).alias("project_ids"),
        )
    )
