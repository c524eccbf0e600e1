"""Claims: which due rows a worker run takes, and what the tables are after it.

A queue is ordered by range partitions and prefix counts, so a tenant with nearly all rows is no single task. Quotas
are per tenant; a capacity of the whole run is shared fairly: everyone's first row comes before anyone's second.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.functions.ordering import with_positions
from wrenchbook.functions.scalars import plus_minutes
from wrenchbook.operators.jobs import COMPLETED_EVENT, due
from wrenchbook.operators.views import moment

# Fixed value: minutes until an event that was handed out is available again.
EVENT_LEASE_MINUTES = 5


def queue_positions(ready: DataFrame, order: Sequence[Column], key: str) -> DataFrame:
    """``tenant_id``, ``key`` and ``position`` of every ready row in its tenant's queue; ``key`` ends ties."""
    names = [f"_o{at}" for at in range(len(order))]
    rows = ready.select("tenant_id", *[column.alias(name) for column, name in zip(order, names)], key)
    return with_positions(rows, ["tenant_id"], [*names, key]).select("tenant_id", key, "position")


def within_quota(queue: DataFrame, quota: int | DataFrame, capacity: int | None = None) -> DataFrame:
    """The rows of a queue that are taken.

    ``quota`` is a number of rows per tenant or a table (tenant_id, quota); a tenant that it lacks gets none. Of
    more rows than ``capacity``, those with the lowest positions are taken, in a shared position by tenant.
    """
    if isinstance(quota, int):
        taken = queue.where(F.col("position") <= quota)
    else:
        taken = queue.join(quota.select("tenant_id", "quota"), "tenant_id").where(F.col("position") <= F.col("quota")).drop("quota")
    if capacity is None:
        return taken
    # Rounds have one row per tenant: how many rows earlier rounds take is a sum over positions.
    rounds = taken.groupBy("position").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    # One row per position, which quotas bound; only rounds that begin inside the capacity go on.
    begun = rounds.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).where(F.col("before") < capacity)
    seat = F.row_number().over(Window.partitionBy("position").orderBy("tenant_id"))
    last = taken.join(begun.where(F.col("before") + F.col("rows") > capacity), "position").withColumn("seat", seat).where(F.col("before") + F.col("seat") <= capacity)
    whole = taken.join(begun.where(F.col("before") + F.col("rows") <= capacity).select("position"), "position", "left_semi")
    return whole.select(*queue.columns).unionByName(last.select(*queue.columns))


def _claimed(table: DataFrame, taken: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """The table after the claim: ``claimed``, the ``position`` of claimed rows, and the changed columns."""
    marked = table.join(taken.select("tenant_id", key, "position"), ["tenant_id", key], "left").withColumn("claimed", F.col("position").isNotNull())
    kept = [F.when(F.col("claimed"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns]
    new = [F.when(F.col("claimed"), value).alias(c) for c, value in changes.items() if c not in table.columns]
    return marked.select(*kept, *new, "claimed", F.col("position").cast("long").alias("position"))


def claim_jobs(jobs: DataFrame, as_of: str | datetime, quota: int | DataFrame, capacity: int | None = None) -> DataFrame:
    """Inspection jobs after a claim: running, one attempt more, started now, no retry time, end or error."""
    ready = jobs.where(due(as_of) & (F.col("retry_count") < F.col("max_retry_count")))
    queue = queue_positions(ready, [F.col("priority"), F.col("created_at")], "id")
    return _claimed(jobs, within_quota(queue, quota, capacity), "id", {
        "status": F.lit("RUNNING"), "retry_count": F.col("retry_count") + 1, "next_retry_at": F.lit(None).cast("timestamp_ntz"),
        "started_at": moment(as_of), "finished_at": F.lit(None).cast("timestamp_ntz"), "error_code": F.lit(None).cast("string"),
    })


def claim_embeddings(jobs: DataFrame, as_of: str | datetime, quota: int | DataFrame, capacity: int | None = None) -> DataFrame:
    """Embedding jobs after a claim: running, started now; a claim is no attempt."""
    queue = queue_positions(jobs.where(due(as_of)), [F.coalesce("next_retry_at", "created_at"), F.col("created_at")], "id")
    return _claimed(jobs, within_quota(queue, quota, capacity), "id", {
        "status": F.lit("RUNNING"), "next_retry_at": F.lit(None).cast("timestamp_ntz"), "started_at": moment(as_of),
        "finished_at": F.lit(None).cast("timestamp_ntz"), "error_code": F.lit(None).cast("string"),
    })


def claim_events(outbox: DataFrame, as_of: str | datetime, quota: int | DataFrame, capacity: int | None = None) -> DataFrame:
    """Outbox events after a claim: one attempt more, and out of sight for the minutes of a lease."""
    ready = outbox.where(
        (F.col("aggregate_type") == "WORK_ORDER") & (F.col("event_type") == COMPLETED_EVENT) & (F.col("status") == "PENDING") & (F.col("available_at") <= moment(as_of))
    )
    queue = queue_positions(ready, [F.col("available_at"), F.col("occurred_at")], "event_id")
    lease = plus_minutes(moment(as_of), F.lit(EVENT_LEASE_MINUTES))
    return _claimed(outbox, within_quota(queue, quota, capacity), "event_id", {"attempts": F.col("attempts") + 1, "available_at": lease})
