"""Audit records of governed questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.functions.text import uuid5
from wrenchbook.operators.catalog import CATALOG_VERSION
from wrenchbook.schemas import AUDIT_NAMESPACE

SUMMARY_CHARS = 500
#: Milliseconds of a bin of durations as a power of two.
DURATION_BITS = 12


def audit_rows(
    asked: DataFrame,
    stage: Column,
    reason: Column,
    rows: Column,
    truncated: Column,
    execution_ms: Column,
) -> DataFrame:
    """Records for a table of asked questions (tenant_id, user_id, request_id, question).

    The question summary keeps 500 characters; the id derives from the request,
    so a repeated run writes the same record.
    """
    return asked.select(
        uuid5(AUDIT_NAMESPACE, F.concat_ws(":", "tenant_id", "request_id")).alias("id"),
        "tenant_id",
        "user_id",
        "request_id",
        F.substring("question", 1, SUMMARY_CHARS).alias("question_summary"),
        F.lit(CATALOG_VERSION).alias("catalog_version"),
        stage.alias("validation_stage"),
        reason.alias("rejection_reason"),
        reason.isNull().alias("executed"),
        rows.cast("int").alias("row_count"),
        F.coalesce(truncated, F.lit(False)).alias("truncated"),
        execution_ms.cast("int").alias("execution_ms"),
    )


def _same(keys: list[str]) -> list[Column]:
    """Equal keys of tables ``s`` and ``m``, null ones too."""
    return [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per tenant and stage: questions, executed ones, truncated ones, and duration figures.

    The median is exact: rows are counted per duration first, and the least duration that half of the
    rows do not exceed is found by running sums, over whole bins of durations and inside one of them.
    """
    keys = ["tenant_id", "validation_stage"]
    bin_, inside = F.shiftright("execution_ms", DURATION_BITS).alias("_bin"), [*keys, "_bin"]
    per_value = audit.groupBy(*keys, "execution_ms").agg(
        F.count("*").alias("questions"),
        F.count_if("executed").alias("executed"),
        F.count_if("truncated").alias("truncated"),
        F.sum("row_count").alias("rows_returned"),
    )
    summary = per_value.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("questions", "executed", "truncated", "rows_returned")],
        F.max("execution_ms").alias("max_ms"),
    )
    timed = per_value.where("execution_ms IS NOT NULL").select(*keys, bin_, "execution_ms", "questions")
    bins = timed.groupBy(*inside).agg(F.sum("questions").alias("_rows"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("_rows").over(whole.orderBy("_bin"))
    # The number of the middle row, and how many rows stand before the bin that holds it.
    placed = bins.select(*inside, "_rows", (upto - F.col("_rows")).alias("_before"), F.expr("(sum(_rows) OVER (PARTITION BY tenant_id, validation_stage) + 1) div 2").alias("_middle"))
    middle = placed.where((F.col("_before") < F.col("_middle")) & (F.col("_middle") <= F.col("_before") + F.col("_rows"))).drop("_rows")
    running = F.col("_before") + F.sum("questions").over(Window.partitionBy(*inside).orderBy("execution_ms"))
    found = timed.alias("s").join(middle.alias("m"), _same(inside)).select("s.*", "_before", "_middle").withColumn("_upto", running)
    medians = found.where("_upto >= _middle").groupBy(*keys).agg(F.min("execution_ms").alias("median_ms"))
    return summary.alias("s").join(medians.alias("m"), _same(keys), "left").select("s.*", "median_ms")
