"""Running streams: intake from the outbox and bounded runs into parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wrenchbook.operators.commands import classify_requests
from wrenchbook.operators.jobs import intake
from wrenchbook.operators.quality import check_events
from wrenchbook.sources.sinks import append_batch, earlier_batches, insert_only_writer

# Fixed value: how long an idempotency key is remembered.
IDEMPOTENCY_DAYS = 1
JOB_KEY = ["tenant_id", "work_order_id", "work_order_version", "inspection_round"]


def accepted_events(outbox: DataFrame) -> DataFrame:
    """Outbox rows that pass the boundary checks, as intake events."""
    checked = check_events(outbox)
    return checked.filter(F.size("reasons") == 0).select(
        "tenant_id", F.col("aggregate_id").alias("work_order_id"), "work_order_version", "inspection_round", "event_id", "occurred_at"
    )


def rejected_events(outbox: DataFrame) -> DataFrame:
    """Outbox rows that fail the boundary checks, with their reasons."""
    return check_events(outbox).filter(F.size("reasons") > 0).select("tenant_id", "event_id", "reasons", "occurred_at")


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops repeats of a job key that arrive within the watermark delay; later ones meet the job table."""
    return (
        events.withColumn("_at", F.col("occurred_at").cast("timestamp"))
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(JOB_KEY)
        .drop("_at")
    )


def start_intake(events: DataFrame, jobs_path: str, checkpoint: str) -> StreamingQuery:
    """Stores one job per key, once: within the stream, against earlier batches, and after a restart."""
    writer = insert_only_writer(jobs_path, ["business_key"], intake)
    return (
        events.writeStream.foreachBatch(writer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_classification(
    requests: DataFrame, outcomes_path: str, checkpoint: str, days_kept: int = IDEMPOTENCY_DAYS
) -> StreamingQuery:
    """EXECUTE, REPLAY or CONFLICT per request, across micro-batches.

    The outcome table is the state: its EXECUTE rows, a partition of their own,
    name the first request of each key. A key is forgotten ``days_kept`` days
    after that request, so a batch reads no rows older than that.
    """
    key = ["tenant_id", "operation", "key"]
    kept = F.expr(f"INTERVAL '{days_kept}' DAY")

    def write(rows: DataFrame, batch: int) -> None:
        known = earlier_batches(rows.withColumn("outcome", F.lit("")), outcomes_path, batch).filter("outcome = 'EXECUTE'")
        oldest = rows.agg(F.min("arrived_at")).first()[0]
        if oldest is not None:
            known = known.filter(F.col("arrived_at") >= F.lit(oldest).cast("timestamp_ntz") - kept)
        first = known.groupBy(*key).agg(
            F.max_by(F.struct("request_hash", "arrived_at"), F.struct("arrived_at", "request_id")).alias("_first")
        )
        met = rows.join(first, key, "left")
        remembered = F.coalesce(F.col("arrived_at") <= F.col("_first.arrived_at") + kept, F.lit(False))
        repeat = F.when(F.col("request_hash").eqNullSafe(F.col("_first.request_hash")), "REPLAY").otherwise("CONFLICT")
        repeats = met.filter(remembered).withColumn("outcome", repeat).drop("_first")
        fresh = classify_requests(met.filter(~remembered).drop("_first"))
        append_batch(repeats.unionByName(fresh), outcomes_path, batch, partition_by=("outcome",))

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes all that is available, then returns what the stream wrote.

    Every batch owns a folder, so a batch that is run again after a lost
    executor or driver leaves its rows once.
    """
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, path, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)
