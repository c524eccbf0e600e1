"""Outbox as a stream or as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchbook.operators.jobs import COMPLETED_EVENT
from wrenchbook.operators.views import moment
from wrenchbook.schemas import OUTBOX


def completed_events(outbox: DataFrame, as_of: str | None = None) -> DataFrame:
    """Pending completed-order events that are available; without ``as_of`` the current time counts."""
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else moment(as_of)
    return outbox.filter(
        (F.col("aggregate_type") == "WORK_ORDER")
        & (F.col("event_type") == COMPLETED_EVENT)
        & (F.col("status") == "PENDING")
        & (F.col("available_at") <= now)
    )


def read_outbox(spark: SparkSession, path: str, as_of: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming reader over a folder of outbox files; the filters reach the scan."""
    reader = spark.readStream.schema(OUTBOX)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return completed_events(reader.parquet(path), as_of)
