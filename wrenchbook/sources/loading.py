"""Loading of legacy work-order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.scalars import lookup, plus_minutes

#: Digits of a number that an id has place for.
ID_DIGITS = 12
_ID_PREFIX = "00000000-0000-0000-0000-"


def in_ranges(values: DataFrame, ranges: DataFrame, value: str, first: str = "first_no", last: str = "last_no") -> DataFrame:
    """Every value with the columns of the ranges that hold it (``first <= value <= last`` as strings); values in none stay.

    A range lies in the bin of the longest start that its two ends share, and
    every string in between has that start too. So a value is looked up by
    equality under its own starts, one for each length that some range has,
    and compared with the ends only there. Ranges that do not overlap and share
    a bin part at the next character, so a bin holds fewer of them than there
    are characters. Distinct values are looked up, hence a frequent one costs no more than a
    rare one until it is joined back, which adaptive execution can split.
    A null bound makes no range, and a null value lies in none.
    """
    at = F.sequence(F.lit(0), F.least(F.length(first), F.length(last)))
    shared = F.array_max(F.filter(at, lambda n: F.substring(F.col(first), F.lit(1), n) == F.substring(F.col(last), F.lit(1), n)))
    bins = ranges.where(F.col(first) <= F.col(last)).withColumn("_length", shared).withColumn("_start", F.substring(F.col(first), F.lit(1), F.col("_length")))
    lengths = bins.agg(F.collect_set("_length")).scalar()
    starts = (
        values.select(value).where(F.col(value).isNotNull()).distinct()
        .withColumn("_lengths", lengths)
        .select(value, F.explode("_lengths").alias("_length"))
        .where(F.col("_length") <= F.length(value))
        .withColumn("_start", F.substring(F.col(value), F.lit(1), F.col("_length")))
    )
    found = starts.join(bins, ["_length", "_start"]).where(F.col(value).between(F.col(first), F.col(last))).drop("_length", "_start", first, last)
    return values.join(found, value, "left")


def split_tenants(legacy: DataFrame, projects: DataFrame, ranges: DataFrame) -> DataFrame:
    """Re-key legacy rows, give each the tenant of its number range, and resolve root ids.

    ``ranges`` has one row per tenant (tenant_id, first_no, last_no), not
    overlapping; the project is found by name within the tenant. Every row comes
    out: one that cannot be loaded has a ``rejected`` reason (BAD_NUMBER: no
    digits at the end or too many for an id, which is null then; NO_RANGE;
    NO_PROJECT) and is no root of another one.
    """
    project = projects.select("tenant_id", F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    digits = F.regexp_extract("work_order_no", "[0-9]+$", 0)
    fits = F.length(digits).between(1, ID_DIGITS)
    rekeyed = (
        in_ranges(legacy, ranges.select("tenant_id", "first_no", "last_no"), "work_order_no")
        .withColumn("id", F.when(fits, F.concat(F.lit(_ID_PREFIX), F.lpad(digits, ID_DIGITS, "0"))))
        .join(project, ["tenant_id", "project_name"], "left")
        .withColumn(
            "rejected",
            F.when(F.col("id").isNull(), "BAD_NUMBER").when(F.col("tenant_id").isNull(), "NO_RANGE").when(F.col("project_id").isNull(), "NO_PROJECT"),
        )
    )
    roots = rekeyed.where("rejected IS NULL").select(
        "tenant_id", F.col("work_order_no").alias("root_work_order_no"), F.col("id").alias("root_work_order_id")
    )
    return rekeyed.join(roots, ["tenant_id", "root_work_order_no"], "left")


def with_sla(df: DataFrame, sla_hours: dict[str, int] | None = None) -> DataFrame:
    """Due time by priority, and the seeded completion time for finished orders."""
    hours = F.coalesce(
        lookup(sla_hours or schemas.SLA_HOURS, F.col("priority")), F.lit(schemas.SLA_OTHER_HOURS)
    )
    done = F.col("status").isin(*schemas.DONE_STATUSES)
    return df.withColumn("due_at", plus_minutes(F.col("created_at"), hours * 60)).withColumn(
        "completed_at", F.when(done, plus_minutes(F.col("created_at"), F.lit(schemas.SEEDED_WORK_MINUTES)))
    )
