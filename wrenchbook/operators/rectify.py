"""Rectification: cases from inspection results, rework orders, reviews and callbacks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.functions.scalars import plus_days
from wrenchbook.functions.text import is_blank, strip
from wrenchbook.operators.views import moment

# Texts and limits of a derived rework order.
TITLE_PREFIX = "Rectification: "
MAX_TITLE = 200
MAX_REASON = 300
NUMBER_PREFIX = "RW-"
NUMBER_CHARS = 20
DEFAULT_REASON = "Review and rectify quality result "
DUE_DAYS = 2
REVIEW_REASON = "AI quality result received"


def case_action(verdict: Column) -> Column:
    return F.when(verdict == "SKIP", "SKIP").when(verdict == "PASS", "CLOSE").otherwise("CREATE_RECTIFICATION")


def open_cases(results: DataFrame, orders: DataFrame, cases: DataFrame) -> DataFrame:
    """Outcome of each delivered result: CREATED, EXISTING, SKIPPED, CONFLICT, INVALID or NOT_FOUND.

    The order must still have the inspected version and be COMPLETED. A stored
    case of the same result answers with itself; another result in the same
    (order, round) conflicts, also within the batch, where the earliest result wins.
    Of a result delivered several times the earliest delivery opens the case and the others meet it.
    """
    target = orders.select(
        "tenant_id", F.col("id").alias("work_order_id"), F.col("version").alias("_version"), F.col("status").alias("_status")
    )
    round_key = ["tenant_id", "work_order_id", "inspection_round"]
    same_result = cases.select("tenant_id", F.col("current_quality_result_id").alias("id"), F.lit(True).alias("_same_result")).distinct()
    same_round = cases.select(
        "tenant_id", F.col("original_work_order_id").alias("work_order_id"), "inspection_round", F.lit(True).alias("_same_round")
    ).distinct()
    checked = (
        results.join(target, ["tenant_id", "work_order_id"], "left")
        .join(same_result, ["tenant_id", "id"], "left")
        .join(same_round, round_key, "left")
        .withColumn(
            "outcome",
            F.when(F.col("_status").isNull(), "NOT_FOUND")
            .when((F.col("_version") != F.col("work_order_version")) | (F.col("_status") != "COMPLETED"), "INVALID")
            .when(F.col("_same_result"), "EXISTING")
            .when(F.col("_same_round"), "CONFLICT"),
        )
    )
    arrival = F.struct("generated_at", "id")
    winners = (
        checked.filter(F.col("outcome").isNull() & (F.col("verdict") != "SKIP"))
        .groupBy(*round_key)
        .agg(F.min(arrival).alias("_winner"))
    )
    in_batch = (
        F.when((F.col("_winner") < arrival) & (F.col("_winner.id") != F.col("id")), "CONFLICT")
        .when(F.col("verdict") == "SKIP", "SKIPPED")
        .when(F.col("_delivery") > 1, "EXISTING")
        .otherwise("CREATED")
    )
    deliveries = Window.partitionBy("tenant_id", "id").orderBy("generated_at")
    return (
        checked.join(winners, round_key, "left")
        .withColumn("_delivery", F.row_number().over(deliveries))
        .withColumn("outcome", F.coalesce("outcome", in_batch))
        .withColumn("action", case_action(F.col("verdict")))
        .drop("_version", "_status", "_same_result", "_same_round", "_winner", "_delivery")
    )


def _limited(text: Column, maximum: int) -> Column:
    return F.substring(strip(text), 1, maximum)


def rework_reasons(findings: DataFrame) -> DataFrame:
    """The first recommendation of a failed or uncertain finding per result."""
    blamed = findings.filter(F.col("label").isin("FAIL", "UNCERTAIN") & F.col("recommendation").isNotNull())
    return blamed.groupBy("tenant_id", "quality_result_id").agg(
        _limited(F.min_by("recommendation", F.struct("ordinal", "id")), MAX_REASON).alias("rework_reason")
    )


def rework_orders(cases: DataFrame, orders: DataFrame, findings: DataFrame, as_of: str | datetime) -> DataFrame:
    """Derived rework orders of cases whose verdict is FAIL or UNCERTAIN."""
    original = orders.select(
        "tenant_id", F.col("id").alias("original_work_order_id"), F.col("title").alias("_title"), "project_id",
        "project_name", "space_path", F.col("work_order_no").alias("_no"), "root_work_order_id", "root_work_order_no",
    )
    result = F.col("current_quality_result_id")
    return (
        cases.filter(F.col("current_verdict").isin("FAIL", "UNCERTAIN"))
        .join(original, ["tenant_id", "original_work_order_id"])
        .join(
            rework_reasons(findings).withColumnRenamed("quality_result_id", "current_quality_result_id"),
            ["tenant_id", "current_quality_result_id"],
            "left",
        )
        .select(
            "tenant_id",
            F.col("id").alias("case_id"),
            F.concat(F.lit(NUMBER_PREFIX), F.substring(F.replace(result, F.lit("-"), F.lit("")), 1, NUMBER_CHARS)).alias("work_order_no"),
            _limited(F.concat(F.lit(TITLE_PREFIX), "_title"), MAX_TITLE).alias("title"),
            F.concat(F.lit("Quality rectification for result "), result).alias("description"),
            "project_id",
            "project_name",
            "space_path",
            F.lit("REWORK").alias("order_type"),
            F.lit("HIGH").alias("priority"),
            F.lit("PENDING_DISPATCH").alias("status"),
            F.lit("AI_QUALITY").alias("source"),
            F.coalesce("root_work_order_id", "original_work_order_id").alias("root_work_order_id"),
            F.coalesce("root_work_order_no", "_no").alias("root_work_order_no"),
            F.coalesce("rework_reason", F.concat(F.lit(DEFAULT_REASON), result)).alias("rework_reason"),
            F.lit(0).cast("long").alias("version"),
            moment(as_of).alias("created_at"),
            plus_days(moment(as_of), F.lit(DUE_DAYS)).alias("due_at"),
        )
    )


def advance_cases(cases: DataFrame, executions: DataFrame) -> DataFrame:
    """Case states after proposals ran (tenant_id, case_id, action, work_order_id, executed_at).

    A proposed FAIL or UNCERTAIN case starts rectifying, a proposed PASS case
    closes; anything else stays. The first execution of each action counts, so one
    that does not fit the verdict hides none that does. ``valid`` states that only
    closed cases have a closing time.
    """
    first_key =F.struct("executed_at", "work_order_id")
    ran = executions.groupBy("tenant_id", F.col("case_id").alias("id")).agg(
        *[
            F.min(F.when(F.col("action") == action, first_key)).alias(name)
            for action, name in (("CREATE_RECTIFICATION", "_start"), ("CLOSE", "_close"))
        ]
    )
    proposed = F.col("status") == "PROPOSED"
    starts = proposed & F.col("_start").isNotNull() & F.col("current_verdict").isin("FAIL", "UNCERTAIN")
    closes = proposed & F.col("_close").isNotNull() & (F.col("current_verdict") == "PASS")
    joined = cases.join(ran, ["tenant_id", "id"], "left")
    status = F.when(starts, "RECTIFYING").when(closes, "CLOSED").otherwise(F.col("status"))
    closed_at = F.when(closes, F.col("_close.executed_at")).otherwise(F.col("closed_at"))
    rework = F.when(starts, F.col("_start.work_order_id")).otherwise(F.col("rectification_work_order_id"))
    return (
        joined.withColumn("_status", status)
        .withColumn("closed_at", closed_at)
        .withColumn("rectification_work_order_id", rework)
        .withColumn("status", F.col("_status"))
        .withColumn("valid", (F.col("status") == "CLOSED") == F.col("closed_at").isNotNull())
        .drop("_start", "_close", "_status")
    )


def review_events(cases: DataFrame, actor_id: str, as_of: str | datetime) -> DataFrame:
    """One review event per new case."""
    return cases.select(
        "tenant_id",
        F.col("id").alias("case_id"),
        F.col("current_quality_result_id").alias("quality_result_id"),
        F.when(F.col("current_verdict") == "PASS", "CLOSE").otherwise("REQUEST_REWORK").alias("decision"),
        F.col("current_verdict").alias("previous_verdict"),
        F.col("current_verdict").alias("reviewed_verdict"),
        F.lit(REVIEW_REASON).alias("reason"),
        F.lit(actor_id).alias("actor_id"),
        moment(as_of).alias("created_at"),
    ).filter(~is_blank(F.col("reason")))


def pending_callbacks(results: DataFrame, delivered: DataFrame, per_tenant: int) -> DataFrame:
    """The oldest undelivered results of each tenant; a delivery counts once."""
    if not 1 <= per_tenant <= 20:
        raise ValueError("per_tenant must be between 1 and 20")
    waiting = results.join(delivered.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti")
    oldest = Window.partitionBy("tenant_id").orderBy("generated_at", "id")
    return waiting.withColumn("position", F.row_number().over(oldest)).filter(F.col("position") <= per_tenant)
