"""Semantic views over orders, inspections and rectification cases."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.scalars import hours_between


def moment(value: str | datetime) -> Column:
    """A naive timestamp literal."""
    return F.lit(value if isinstance(value, str) else value.isoformat(sep=" ")).cast("timestamp_ntz")


def completion_hours() -> Column:
    return F.when(F.col("status").isin(*schemas.DONE_STATUSES), hours_between(F.col("created_at"), F.col("completed_at")))


def is_overdue(as_of: str | datetime) -> Column:
    """Never NULL: a missing due time is not overdue."""
    late = (F.col("due_at") < moment(as_of)) & ~F.col("status").isin(*schemas.FINAL_STATUSES)
    return F.coalesce(late, F.lit(False))


def work_order_v(orders: DataFrame, as_of: str | datetime) -> DataFrame:
    """Orders without free text, location or reasons, plus duration and overdue flag."""
    return orders.select(
        "id", "tenant_id", "project_id", "work_order_no", "title", "project_name", "order_type", "priority",
        "status", "source", "assignee_name", "root_work_order_no", "created_at", "due_at", "accepted_at",
        "completed_at", "cancelled_at",
        completion_hours().alias("completion_hours"),
        is_overdue(as_of).alias("is_overdue"),
    )


# Columns of the quality view that come from the optional joins.
_CALL_COLUMNS = ("model_provider", "model_name", "prompt_version", "model_latency_ms")
_COUNT_COLUMNS = ("finding_count", "high_severity_count", "medium_severity_count", "low_severity_count")
_QUALITY_COLUMNS = (
    "id", "tenant_id", "project_id", "work_order_id", "work_order_no", "work_order_title", "project_name",
    "verdict", "confidence", "inspection_round", "generated_at", *_CALL_COLUMNS, *_COUNT_COLUMNS,
)
_RECTIFICATION_COLUMNS = (
    "id", "tenant_id", "project_id", "original_work_order_id", "original_work_order_no",
    "original_work_order_title", "project_name", "rectification_work_order_id",
    "rectification_work_order_no", "current_verdict", "inspection_round", "status", "created_at", "closed_at",
    "resolution_hours",
)


def _wanted(columns: Iterable[str] | None, known: tuple[str, ...]) -> list[str]:
    return [c for c in known if columns is None or c in set(columns)]


def quality_v(
    results: DataFrame,
    orders: DataFrame,
    calls: DataFrame,
    findings: DataFrame,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Inspection results with order, model call and finding counts.

    A result without findings has NULL counts, not zeros: the counts come from
    a pre-aggregated left join. Spark prunes columns but not left joins, so a
    caller that names its ``columns`` also saves the joins behind the others.
    """
    chosen = _wanted(columns, _QUALITY_COLUMNS)
    order = orders.select(
        "tenant_id", F.col("id").alias("work_order_id"), "project_id", "work_order_no",
        F.col("title").alias("work_order_title"), "project_name",
    )
    view = results.join(order, ["tenant_id", "work_order_id"])
    if set(chosen) & set(_CALL_COLUMNS):
        call = calls.select(
            "tenant_id", F.col("id").alias("model_call_id"), F.col("provider").alias("model_provider"),
            "model_name", "prompt_version", F.col("latency_ms").alias("model_latency_ms"),
        )
        view = view.join(call, ["tenant_id", "model_call_id"], "left")
    if set(chosen) & set(_COUNT_COLUMNS):
        counts = findings.groupBy("tenant_id", F.col("quality_result_id").alias("id")).agg(
            F.count("*").alias("finding_count"),
            F.count_if(F.col("severity") == "HIGH").alias("high_severity_count"),
            F.count_if(F.col("severity") == "MEDIUM").alias("medium_severity_count"),
            F.count_if(F.col("severity") == "LOW").alias("low_severity_count"),
        )
        view = view.join(counts, ["tenant_id", "id"], "left")
    return view.select(*chosen)


def rectification_v(cases: DataFrame, orders: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Cases with the original order and, where it exists and is wanted, the rework order."""
    chosen = _wanted(columns, _RECTIFICATION_COLUMNS)
    original = orders.select(
        "tenant_id", F.col("id").alias("original_work_order_id"), "project_id",
        F.col("work_order_no").alias("original_work_order_no"),
        F.col("title").alias("original_work_order_title"), "project_name",
    )
    view = cases.join(original, ["tenant_id", "original_work_order_id"])
    if "rectification_work_order_no" in chosen:
        rework = orders.select(
            "tenant_id", F.col("id").alias("rectification_work_order_id"),
            F.col("work_order_no").alias("rectification_work_order_no"),
        )
        view = view.join(rework, ["tenant_id", "rectification_work_order_id"], "left")
    if "resolution_hours" in chosen:
        view = view.withColumn("resolution_hours", hours_between(F.col("created_at"), F.col("closed_at")))
    return view.select(*chosen)
