"""Inspection jobs and queues: intake, claims, leases, retries, outbox and inbox."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.scalars import plus_minutes
from wrenchbook.functions.text import uuid5
from wrenchbook.operators.quality import JOB_NAMESPACE
from wrenchbook.operators.views import moment

COMPLETED_EVENT = "WORK_ORDER_COMPLETED"
LEASE_EXPIRED = "QUALITY_WORKER_LEASE_EXPIRED"


def job_business_key() -> Column:
    return F.concat_ws(
        ":", "tenant_id", "work_order_id", F.col("work_order_version").cast("string"), F.col("inspection_round").cast("string")
    )


def intake(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One PENDING job per (tenant, order, version, round); the earliest event stands for repeats.

    ``existing`` (business_key) makes a repeated run a no-op.
    """
    first = events.groupBy("tenant_id", "work_order_id", "work_order_version", "inspection_round").agg(
        F.min_by(F.struct("event_id", "occurred_at"), F.struct("occurred_at", "event_id")).alias("_first")
    )
    jobs = first.withColumn("business_key", job_business_key()).select(
        uuid5(JOB_NAMESPACE, F.col("business_key")).alias("id"),
        "tenant_id", "work_order_id", "work_order_version", "inspection_round", "business_key",
        F.col("_first.event_id").alias("event_id"),
        F.col("_first.occurred_at").alias("created_at"),
        F.lit("PENDING").alias("status"),
    )
    return jobs if existing is None else jobs.join(existing.select("business_key"), "business_key", "left_anti")


def _first_per_tenant(df: DataFrame, order: Sequence[str | Column], count: int, most: int) -> DataFrame:
    if not 1 <= count <= most:
        raise ValueError(f"count must be between 1 and {most}")
    queue = Window.partitionBy("tenant_id").orderBy(*order)
    return df.withColumn("position", F.row_number().over(queue)).filter(F.col("position") <= count)


def due(as_of: str | datetime) -> Column:
    status = F.col("status")
    return (status == "PENDING") | ((status == "RETRY_WAIT") & (F.col("next_retry_at") <= moment(as_of)))


def claimable(jobs: DataFrame, as_of: str | datetime, per_tenant: int = 20) -> DataFrame:
    """The next inspection jobs of each tenant, by priority, age and id."""
    ready = jobs.filter(due(as_of) & (F.col("retry_count") < F.col("max_retry_count")))
    return _first_per_tenant(ready, ["priority", "created_at", "id"], per_tenant, 20)


def claimable_embeddings(jobs: DataFrame, as_of: str | datetime, per_tenant: int = 100) -> DataFrame:
    """The next embedding jobs of each tenant, by due time, age and id."""
    order = [F.coalesce("next_retry_at", "created_at"), "created_at", "id"]
    return _first_per_tenant(jobs.filter(due(as_of)), order, per_tenant, 100)


def claimable_events(outbox: DataFrame, as_of: str | datetime, per_tenant: int = 50) -> DataFrame:
    """The next completed-order events of each tenant, by availability, occurrence and id."""
    ready = outbox.filter(
        (F.col("aggregate_type") == "WORK_ORDER")
        & (F.col("event_type") == COMPLETED_EVENT)
        & (F.col("status") == "PENDING")
        & (F.col("available_at") <= moment(as_of))
    )
    return _first_per_tenant(ready, ["available_at", "occurred_at", "event_id"], per_tenant, 50)


def recover_leases(jobs: DataFrame, as_of: str | datetime, lease_minutes: int = schemas.LEASE_MINUTES) -> DataFrame:
    """Jobs after lease recovery: a RUNNING job whose lease ended fails or waits for a retry.

    Other jobs keep their ``error_code``, which is NULL if ``jobs`` has no such column.
    """
    now = moment(as_of)
    error = F.col("error_code") if "error_code" in jobs.columns else F.lit(None).cast("string")
    ended = (F.col("status") == "RUNNING") & (F.col("started_at") <= plus_minutes(now, F.lit(-lease_minutes)))
    spent = F.col("retry_count") >= F.col("max_retry_count")
    marked = jobs.withColumn("_ended", F.coalesce(ended, F.lit(False)))
    return (
        marked.withColumn("next_retry_at", F.when(F.col("_ended"), F.when(~spent, now)).otherwise(F.col("next_retry_at")))
        .withColumn("error_code", F.when(F.col("_ended"), LEASE_EXPIRED).otherwise(error))
        .withColumn("started_at", F.when(~F.col("_ended"), F.col("started_at")))
        .withColumn("status", F.when(F.col("_ended"), F.when(spent, "FAILED").otherwise("RETRY_WAIT")).otherwise(F.col("status")))
        .drop("_ended")
    )


def retry_delay(attempt: Column) -> Column:
    """Minutes before the next attempt: 5, 10, 20, 40, then 60."""
    doubled = F.lit(schemas.RETRY_BASE_MINUTES) * F.pow(F.lit(2), F.least(attempt, F.lit(10)) - 1)
    return F.when(attempt >= 1, F.least(doubled, F.lit(schemas.RETRY_CAP_MINUTES)).cast("int"))


def next_status(outcome: Column, attempt: Column, verdict: Column, max_attempts: int = schemas.MAX_ATTEMPTS) -> Column:
    """State after one attempt; an unknown fault keeps the job RUNNING until its lease ends."""
    return (
        F.when((outcome == "OK") & (verdict == "SKIP"), "SKIPPED")
        .when(outcome == "OK", "SUCCEEDED")
        .when((outcome == "RETRYABLE") & (attempt < max_attempts), "RETRY_WAIT")
        .when(outcome.isin("RETRYABLE", "FATAL", "OUTPUT_INVALID", "INPUT_INVALID"), "FAILED")
        .otherwise("RUNNING")
    )


def next_job_state(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after their attempts' outcomes (tenant_id, job_id, attempt, outcome, verdict, finished_at).

    An outcome counts only for the running attempt it belongs to, and of several
    outcomes of one attempt the first one.
    """
    first = F.min(F.struct("finished_at", "outcome", "verdict")).alias("_first")
    reported = (
        outcomes.where(F.col("outcome").isNotNull())
        .groupBy("tenant_id", F.col("job_id").alias("id"), F.col("attempt").alias("retry_count"))
        .agg(first)
        .select("tenant_id", "id", "retry_count", "_first.outcome", "_first.verdict", "_first.finished_at")
    )
    joined = jobs.join(reported, ["tenant_id", "id", "retry_count"], "left")
    applies = (F.col("status") == "RUNNING") & F.col("outcome").isNotNull()
    status = F.when(applies, next_status(F.col("outcome"), F.col("retry_count"), F.col("verdict"))).otherwise(F.col("status"))
    retry_at = plus_minutes(F.col("finished_at"), retry_delay(F.col("retry_count")))
    return (
        joined.withColumn("_next", status)
        .withColumn(
            "next_retry_at",
            F.when(applies & (F.col("_next") == "RETRY_WAIT"), retry_at).when(~applies, F.col("next_retry_at")),
        )
        .withColumn("status", F.col("_next"))
        .drop("_next", "outcome", "verdict", "finished_at")
    )


def pending_outbox(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    """Pending completed-order events that are not acknowledged; only a claimed event can be."""
    open_events = outbox.filter((F.col("status") == "PENDING") & (F.col("event_type") == COMPLETED_EVENT))
    acknowledged = acks.select("tenant_id", "event_id", F.lit(True).alias("_acked")).distinct()
    return (
        open_events.join(acknowledged, ["tenant_id", "event_id"], "left")
        .filter(~(F.coalesce("_acked", F.lit(False)) & (F.col("attempts") > 0)))
        .drop("_acked")
    )


def dedupe_inbox(messages: DataFrame) -> DataFrame:
    """The first message per (tenant, provider, external id)."""
    key = ["tenant_id", "provider", "external_message_id"]
    first = messages.groupBy(*key).agg(
        F.min_by(F.struct("message_id", "received_at"), F.struct("received_at", "message_id")).alias("_first"),
        F.count("*").alias("copies"),
    )
    return first.select(*key, "_first.message_id", "_first.received_at", "copies")
