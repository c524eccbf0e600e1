"""Queries that run as streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.plans.bindings import AS_OF, BINDINGS, Tables
from wrenchbook.plans.commands import _REPLAYED
from wrenchbook.plans.registry import query
from wrenchbook.session import scratch_path
from wrenchbook.sources.outbox import read_outbox
from wrenchbook.streaming import runs, state


def _event_stream(t: Tables, binding: str) -> DataFrame:
    """A binding over ``events`` with the file read as a stream."""
    raw = t.spark.readStream.schema(t["events"].schema).option("pathGlobFilter", "events.parquet").parquet(t.directory)
    return t.spark.sql(BINDINGS[binding], events=raw)


def _run(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    folder = scratch_path(t.spark, name)
    return runs.run_to_table(stream, f"{folder}/rows", f"{folder}/checkpoint")


@query(
    "outbox_intake_stream", "A5 A6 I13 J1",
    """SELECT DISTINCT tenant_id, aggregate_id AS work_order_id, CAST(payload ->> 'version' AS BIGINT) AS work_order_version,
              CAST(payload ->> 'inspection_round' AS INT) AS inspection_round
       FROM {outbox} WHERE event_type = 'WORK_ORDER_COMPLETED' AND status = 'PENDING' AND available_at <= TIMESTAMP '1998-06-15 00:00:00'
         AND payload ->> 'tenant_id' = tenant_id AND CAST(payload ->> 'version' AS BIGINT) >= 0 AND payload ->> 'status' = 'COMPLETED'
         AND CAST(payload ->> 'inspection_round' AS INT) >= 1 AND NOT contains(payload, '"Photo_URL":') AND NOT contains(payload, '" token ":')""",
)
def outbox_intake_stream(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "outbox")
    t["outbox"].write.parquet(f"{folder}/outbox")
    source = read_outbox(t.spark, f"{folder}/outbox", AS_OF, files_per_trigger=4)
    runs.start_intake(runs.accepted_events(source), f"{folder}/jobs", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/jobs").select("tenant_id", "work_order_id", "work_order_version", "inspection_round")


@query(
    "event_intake_stream", "J1",
    "SELECT DISTINCT tenant_id, work_order_id, work_order_version, inspection_round FROM {completed_event}",
)
def event_intake_stream(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "intake")
    events = runs.deduplicated(_event_stream(t, "completed_event"))
    runs.start_intake(events, f"{folder}/jobs", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/jobs").select("tenant_id", "work_order_id", "work_order_version", "inspection_round")


@query(
    "replay_stream", "J7",
    "SELECT tenant_id, work_order_id, event_id, occurred_at, action, legal, false AS late, status_before, status_after FROM {replayed}",
    _REPLAYED,
)
def replay_stream(t: Tables) -> DataFrame:
    return _run(t, state.replay_stream(_event_stream(t, "order_event")), "replay")


@query(
    "request_stream", "J12",
    """SELECT tenant_id, operation, key, request_id, CASE WHEN request_id = first_value(request_id) OVER w THEN 'EXECUTE'
              WHEN request_hash = first_value(request_hash) OVER w THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome
       FROM {request} WINDOW w AS (PARTITION BY tenant_id, operation, key ORDER BY arrived_at, request_id)""",
)
def request_stream(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "requests")
    runs.start_classification(
        _event_stream(t, "request"), f"{folder}/outcomes", f"{folder}/checkpoint", days_kept=60
    ).awaitTermination()
    return t.spark.read.parquet(f"{folder}/outcomes").select(
        "tenant_id", "operation", "key", "request_id", F.col("outcome").cast("string").alias("outcome")
    )


# The fold of one job, row after row: what a lease that ended and thirty days without a row change, then the row itself.
_JOB_FOLD = """
WITH RECURSIVE given AS (
  SELECT 't' || (user_id % 5) AS tenant_id, 'j' || user_id AS job_id, event_id AS seq, ts AS moment,
         CASE event_type WHEN 'click' THEN 'CLAIM' WHEN 'purchase' THEN 'OK' WHEN 'error' THEN 'RETRYABLE'
              WHEN 'view' THEN 'UNKNOWN' ELSE 'FATAL' END AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM {events}),
fold AS (
  SELECT tenant_id, job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS moment, CAST(NULL AS VARCHAR) AS kind,
         CAST(NULL AS TIMESTAMP) AS lease_end, CAST(NULL AS VARCHAR) AS ended_status, 0 AS ended_attempts, false AS changed,
         'PENDING' AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS TIMESTAMP) AS retry_at
  FROM given WHERE n = 1
  UNION ALL
  SELECT tenant_id, job_id, n, seq, moment, kind, lease_end, ended_status, ended_attempts, claims OR reports AS changed,
         CASE WHEN claims THEN 'RUNNING' WHEN NOT reports THEN status WHEN kind = 'OK' THEN 'SUCCEEDED'
              WHEN kind = 'RETRYABLE' AND attempts < 3 THEN 'RETRY_WAIT' ELSE 'FAILED' END,
         attempts + CAST(claims AS INT),
         CASE WHEN claims THEN moment WHEN reports THEN NULL ELSE started END,
         CASE WHEN claims THEN NULL WHEN reports AND kind = 'RETRYABLE' AND attempts < 3 THEN moment + INTERVAL 5 MINUTE ELSE retry_at END
  FROM (
    SELECT *, kind = 'CLAIM' AND attempts < 3 AND (status = 'PENDING' OR (status = 'RETRY_WAIT' AND coalesce(retry_at <= moment, false))) AS claims,
           kind NOT IN ('CLAIM', 'UNKNOWN') AND status = 'RUNNING' AND attempts = 1 AS reports
    FROM (
      SELECT tenant_id, job_id, n, seq, moment, kind, lease_end, ended_status, attempts AS ended_attempts,
             CASE WHEN old THEN 'PENDING' ELSE coalesce(ended_status, status) END AS status, CASE WHEN old THEN 0 ELSE attempts END AS attempts,
             CASE WHEN lease_end IS NULL THEN started END AS started,
             CASE WHEN ended_status = 'RETRY_WAIT' THEN lease_end WHEN old THEN NULL ELSE retry_at END AS retry_at
      FROM (
        SELECT *, coalesce(ended_status, status) IN ('SUCCEEDED', 'FAILED') AND before + INTERVAL 30 DAY < moment AS old
        FROM (
          SELECT *, CASE WHEN lease_end IS NULL THEN NULL WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY_WAIT' END AS ended_status
          FROM (
            SELECT g.tenant_id, g.job_id, g.n, g.seq, g.moment, g.kind, f.moment AS before, f.status, f.attempts, f.started, f.retry_at,
                   CASE WHEN f.status = 'RUNNING' AND f.started + INTERVAL 15 MINUTE <= g.moment THEN f.started + INTERVAL 15 MINUTE END AS lease_end
            FROM fold f JOIN given g ON g.job_id = f.job_id AND g.n = f.n + 1))))))
SELECT tenant_id, job_id, seq, moment AS "at", kind AS cause, changed, status, attempts, retry_at AS next_retry_at FROM fold WHERE n > 0
UNION ALL
SELECT tenant_id, job_id, NULL, lease_end, 'LEASE_END', true, ended_status, ended_attempts, CASE WHEN ended_status = 'RETRY_WAIT' THEN lease_end END
FROM fold WHERE lease_end IS NOT NULL
UNION ALL
SELECT tenant_id, job_id, NULL, started + INTERVAL 15 MINUTE, 'LEASE_END', true, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY_WAIT' END,
       attempts, CASE WHEN attempts < 3 THEN started + INTERVAL 15 MINUTE END
FROM fold f WHERE status = 'RUNNING' AND n = (SELECT max(g.n) FROM given g WHERE g.job_id = f.job_id)
 AND epoch_us(started + INTERVAL 15 MINUTE) < (SELECT epoch_ms(max(moment)) - 3600000 FROM given) * 1000
"""


@query("job_stream", "J6", _JOB_FOLD)
def job_stream(t: Tables) -> DataFrame:
    raw = t.spark.readStream.schema(t["events"].schema).option("pathGlobFilter", "events.parquet").parquet(t.directory)
    # A click claims the user's job; the other events report how the first attempt went.
    attempts = raw.select(
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "click", "CLAIM")
        .when(F.col("event_type") == "purchase", "OK")
        .when(F.col("event_type") == "error", "RETRYABLE")
        .when(F.col("event_type") == "view", "UNKNOWN")
        .otherwise("FATAL")
        .alias("kind"),
        F.lit(1).alias("attempt"),
        F.lit("PASS").alias("verdict"),
    ).withWatermark("at", "1 hour")
    return _run(t, state.job_stream(attempts), "jobs")
