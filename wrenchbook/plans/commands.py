"""Queries over jobs, order events, commands and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.operators import claims, commands, events, jobs, scope
from wrenchbook.plans.bindings import AS_OF, EVENTS_AS_OF, Tables
from wrenchbook.plans.registry import query

ANY_ID = r".+"


@query(
    "event_intake", "J1",
    """SELECT tenant_id, work_order_id, work_order_version, inspection_round, arg_min(event_id, row(occurred_at, event_id)) AS event_id,
              min(occurred_at) AS created_at, 'PENDING' AS status,
              tenant_id || ':' || work_order_id || ':' || work_order_version || ':' || inspection_round AS business_key
       FROM {completed_event} e
       WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.business_key = e.tenant_id || ':' || e.work_order_id || ':' || e.work_order_version || ':' || e.inspection_round)
       GROUP BY 1, 2, 3, 4""",
    {"known": "SELECT DISTINCT 't' || (user_id % 5) || ':w' || user_id || ':0:1' AS business_key FROM {events}"},
)
def event_intake(t: Tables) -> DataFrame:
    known = t.sql("SELECT DISTINCT 't' || (user_id % 5) || ':w' || user_id || ':0:1' AS business_key FROM {events}")
    return jobs.intake(t["completed_event"], known).select(
        "tenant_id", "work_order_id", "work_order_version", "inspection_round", "event_id", "created_at", "status", "business_key"
    )


@query(
    "claimable_jobs", "J2",
    """SELECT tenant_id, id, CAST(position AS INT) AS position FROM (
         SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY priority, created_at, id) AS position FROM {quality_job}
         WHERE retry_count < max_retry_count AND (status = 'PENDING' OR (status = 'RETRY_WAIT' AND next_retry_at <= TIMESTAMP '1998-06-15 00:00:00'))) q
       WHERE position <= 20""",
)
def claimable_jobs(t: Tables) -> DataFrame:
    return jobs.claimable(t["quality_job"], AS_OF, 20).select("tenant_id", "id", "position")


@query(
    "claimable_embeddings", "J2",
    """SELECT tenant_id, id, CAST(position AS INT) AS position FROM (
         SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY coalesce(next_retry_at, created_at), created_at, id) AS position FROM {quality_job}
         WHERE status = 'PENDING' OR (status = 'RETRY_WAIT' AND next_retry_at <= TIMESTAMP '1998-06-15 00:00:00')) q
       WHERE position <= 100""",
)
def claimable_embeddings(t: Tables) -> DataFrame:
    return jobs.claimable_embeddings(t["quality_job"], AS_OF, 100).select("tenant_id", "id", "position")


@query(
    "claimable_events", "J2 A5",
    """SELECT tenant_id, event_id, CAST(position AS INT) AS position FROM (
         SELECT tenant_id, event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY available_at, occurred_at, event_id) AS position FROM {outbox}
         WHERE event_type = 'WORK_ORDER_COMPLETED' AND status = 'PENDING' AND available_at <= TIMESTAMP '1998-06-15 00:00:00') q
       WHERE position <= 50""",
)
def claimable_events(t: Tables) -> DataFrame:
    return jobs.claimable_events(t["outbox"], AS_OF, 50).select("tenant_id", "event_id", "position")


# Quotas by tenant: thousands for the first one, a few for the others, none for the last.
_QUOTA = """
SELECT 't0' AS tenant_id, 5000 AS quota UNION ALL SELECT 't1' AS tenant_id, 40 AS quota UNION ALL SELECT 't2' AS tenant_id, 7 AS quota UNION ALL SELECT 't3' AS tenant_id, 200 AS quota
"""


def _quota(t: Tables) -> DataFrame:
    return t.sql(_QUOTA)


@query(
    "claimed_jobs", "J2",
    """SELECT tenant_id, id, CASE WHEN claimed THEN 'RUNNING' ELSE status END AS status, CAST(retry_count + CASE WHEN claimed THEN 1 ELSE 0 END AS INT) AS retry_count,
              CASE WHEN NOT claimed THEN next_retry_at END AS next_retry_at, CASE WHEN claimed THEN TIMESTAMP '1998-06-15 00:00:00' ELSE started_at END AS started_at, claimed, CASE WHEN claimed THEN place ELSE 0 END AS position
       FROM (SELECT j.*, coalesce(ready AND place <= quota, false) AS claimed
             FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, ready ORDER BY priority, created_at, id) AS place
                   FROM (SELECT *, coalesce(retry_count < max_retry_count AND (status = 'PENDING' OR (status = 'RETRY_WAIT' AND next_retry_at <= TIMESTAMP '1998-06-15 00:00:00')), false) AS ready
                         FROM {quality_job}) r) j
             LEFT JOIN {quota} q ON q.tenant_id = j.tenant_id) c""",
    {"quota": _QUOTA},
)
def claimed_jobs(t: Tables) -> DataFrame:
    after = claims.claim_jobs(t["quality_job"], AS_OF, _quota(t))
    return after.select("tenant_id", "id", "status", "retry_count", "next_retry_at", "started_at", "claimed", F.coalesce("position", F.lit(0)).alias("position"))


@query(
    "claimed_embeddings", "J2 G4",
    """SELECT tenant_id, id, CASE WHEN claimed THEN 'RUNNING' ELSE status END AS status, retry_count,
              CASE WHEN NOT claimed THEN next_retry_at END AS next_retry_at, CASE WHEN claimed THEN TIMESTAMP '1998-06-15 00:00:00' ELSE started_at END AS started_at, claimed
       FROM (SELECT *, ready AND place <= 300 AND row_number() OVER (PARTITION BY ready AND place <= 300 ORDER BY place, tenant_id) <= 1001 AS claimed
             FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, ready ORDER BY coalesce(next_retry_at, created_at), created_at, id) AS place
                   FROM (SELECT *, coalesce(status = 'PENDING' OR (status = 'RETRY_WAIT' AND next_retry_at <= TIMESTAMP '1998-06-15 00:00:00'), false) AS ready FROM {quality_job}) r) j) c""",
)
def claimed_embeddings(t: Tables) -> DataFrame:
    """Three hundred jobs of a tenant at most, and a thousand and one in all."""
    after = claims.claim_embeddings(t["quality_job"], AS_OF, 300, capacity=1001)
    return after.select("tenant_id", "id", "status", "retry_count", "next_retry_at", "started_at", "claimed")


@query(
    "claimed_events", "J2 A5",
    """SELECT tenant_id, event_id, status, CAST(attempts + CASE WHEN claimed THEN 1 ELSE 0 END AS INT) AS attempts,
              CASE WHEN claimed THEN TIMESTAMP '1998-06-15 00:05:00' ELSE available_at END AS available_at, claimed
       FROM (SELECT *, ready AND row_number() OVER (PARTITION BY tenant_id, ready ORDER BY available_at, occurred_at, event_id) <= 50 AS claimed
             FROM (SELECT *, coalesce(event_type = 'WORK_ORDER_COMPLETED' AND status = 'PENDING' AND available_at <= TIMESTAMP '1998-06-15 00:00:00', false) AS ready FROM {outbox}) r) c""",
)
def claimed_events(t: Tables) -> DataFrame:
    return claims.claim_events(t["outbox"], AS_OF, 50).select("tenant_id", "event_id", "status", "attempts", "available_at", "claimed")


@query(
    "recovered_leases", "J3",
    """SELECT tenant_id, id, CASE WHEN ended THEN CASE WHEN retry_count >= max_retry_count THEN 'FAILED' ELSE 'RETRY_WAIT' END ELSE status END AS status,
              CASE WHEN ended THEN CASE WHEN retry_count < max_retry_count THEN TIMESTAMP '1998-06-15 00:00:00' END ELSE next_retry_at END AS next_retry_at,
              CASE WHEN ended THEN 'QUALITY_WORKER_LEASE_EXPIRED' ELSE before END AS error_code
       FROM (SELECT *, CASE WHEN retry_count > 1 THEN 'MODEL_TIMEOUT' END AS before, coalesce(status = 'RUNNING' AND started_at <= TIMESTAMP '1998-06-14 23:45:00', false) AS ended FROM {quality_job}) j""",
)
def recovered_leases(t: Tables) -> DataFrame:
    before = t["quality_job"].withColumn("error_code", F.when(F.col("retry_count") > 1, "MODEL_TIMEOUT"))
    return jobs.recover_leases(before, AS_OF).select("tenant_id", "id", "status", "next_retry_at", "error_code")


@query(
    "retry_delays", "J4",
    """SELECT event_id, CASE WHEN event_id % 12 >= 1 THEN CAST(least(5 * pow(2, event_id % 12 - 1), 60) AS INT) END AS minutes FROM {events}""",
)
def retry_delays(t: Tables) -> DataFrame:
    return t["events"].select("event_id", jobs.retry_delay(F.col("event_id") % 12).alias("minutes"))


@query(
    "next_job_states", "J5",
    """SELECT tenant_id, id, retry_count, next AS status,
              CASE WHEN applies AND next = 'RETRY_WAIT' THEN finished_at + INTERVAL 1 MINUTE * CAST(least(5 * pow(2, retry_count - 1), 60) AS INT)
                   WHEN NOT applies THEN next_retry_at END AS next_retry_at
       FROM (SELECT j.*, o.finished_at, j.status = 'RUNNING' AND o.outcome IS NOT NULL AS applies,
               CASE WHEN j.status <> 'RUNNING' OR o.outcome IS NULL THEN j.status
                    WHEN o.outcome = 'OK' THEN CASE o.verdict WHEN 'SKIP' THEN 'SKIPPED' ELSE 'SUCCEEDED' END
                    WHEN o.outcome = 'RETRYABLE' AND j.retry_count < 3 THEN 'RETRY_WAIT'
                    WHEN o.outcome = 'UNKNOWN' THEN 'RUNNING' ELSE 'FAILED' END AS next
             FROM {quality_job} j LEFT JOIN {job_outcome} o ON o.tenant_id = j.tenant_id AND o.job_id = j.id AND o.attempt = j.retry_count) s""",
)
def next_job_states(t: Tables) -> DataFrame:
    return jobs.next_job_state(t["quality_job"], t["job_outcome"]).select(
        "tenant_id", "id", "retry_count", "status", "next_retry_at"
    )


_REPLAY = """
SELECT tenant_id, work_order_id, event_id, occurred_at, action, n, state AS status_after,
       lag(state, 1, 'PENDING_DISPATCH') OVER (PARTITION BY tenant_id, work_order_id ORDER BY n) AS status_before,
       moved AS legal
FROM {steps}
"""
_STEPS = """
WITH RECURSIVE numbered AS (
  SELECT tenant_id, work_order_id, event_id, occurred_at, action, trim(coalesce(reason, '')) <> '' AS has_reason,
         row_number() OVER (PARTITION BY tenant_id, work_order_id ORDER BY occurred_at, event_id) AS n
  FROM {order_event}),
walk AS (
  SELECT tenant_id, work_order_id, event_id, occurred_at, action, n,
         CASE WHEN action = 'ASSIGN' THEN 'PENDING_ACCEPTANCE' WHEN action = 'CANCEL' AND has_reason THEN 'CANCELLED' ELSE 'PENDING_DISPATCH' END AS state,
         false AS accepted, action = 'ASSIGN' OR (action = 'CANCEL' AND has_reason) AS moved
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT tenant_id, work_order_id, event_id, occurred_at, action, n,
         CASE WHEN NOT moved THEN before ELSE CASE action WHEN 'ASSIGN' THEN 'PENDING_ACCEPTANCE' WHEN 'ACCEPT' THEN 'PENDING_ACCEPTANCE'
              WHEN 'START' THEN 'PROCESSING' WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'CLOSE' THEN 'CLOSED' ELSE 'CANCELLED' END END AS state,
         accepted OR (moved AND action = 'ACCEPT') AS accepted, moved
  FROM (SELECT e.*, w.state AS before, w.accepted,
               (w.state = 'PENDING_DISPATCH' AND e.action = 'ASSIGN') OR (w.state = 'PENDING_ACCEPTANCE' AND e.action = 'ACCEPT' AND NOT w.accepted)
               OR (w.state = 'PENDING_ACCEPTANCE' AND e.action = 'START' AND w.accepted) OR (w.state = 'PROCESSING' AND e.action = 'COMPLETE')
               OR (w.state = 'COMPLETED' AND e.action = 'CLOSE')
               OR (e.action = 'CANCEL' AND e.has_reason AND w.state NOT IN ('CLOSED', 'CANCELLED')) AS moved
        FROM walk w JOIN numbered e ON e.tenant_id = w.tenant_id AND e.work_order_id = w.work_order_id AND e.n = w.n + 1) judged)
SELECT * FROM walk
"""
_REPLAYED = {"steps": _STEPS, "replayed": _REPLAY}


@query(
    "replayed_events", "J7",
    """SELECT tenant_id, work_order_id, event_id, occurred_at, action, legal, status_before, status_after,
              CASE WHEN legal THEN NULL WHEN status_before IN ('CLOSED', 'CANCELLED') THEN 'final' WHEN action = 'CANCEL' THEN 'cancel_reason'
                   WHEN action = 'START' AND status_before = 'PENDING_ACCEPTANCE' THEN 'not_accepted'
                   WHEN action = 'ACCEPT' AND status_before = 'PENDING_ACCEPTANCE' THEN 'accepted_before' ELSE 'not_allowed' END AS reason
       FROM {replayed}""",
    _REPLAYED,
)
def replayed_events(t: Tables) -> DataFrame:
    return events.replay(t["order_event"])[0]


@query(
    "replayed_states", "J7",
    """SELECT tenant_id, work_order_id, arg_max(status_after, n) AS status, min(occurred_at) FILTER (WHERE legal AND action = 'ACCEPT') AS accepted_at
       FROM {replayed} GROUP BY 1, 2""",
    _REPLAYED,
)
def replayed_states(t: Tables) -> DataFrame:
    return events.replay(t["order_event"])[1]


@query(
    "log_checks", "J8",
    """SELECT event_id, (before_status, after_status) IN (('PENDING_DISPATCH', 'PENDING_ACCEPTANCE'), ('PENDING_DISPATCH', 'CANCELLED'),
              ('PENDING_ACCEPTANCE', 'PENDING_ACCEPTANCE'), ('PENDING_ACCEPTANCE', 'PROCESSING'), ('PENDING_ACCEPTANCE', 'CANCELLED'),
              ('PROCESSING', 'COMPLETED'), ('PROCESSING', 'CANCELLED'), ('COMPLETED', 'CLOSED'), ('COMPLETED', 'CANCELLED')) AS legal_pair,
              after_version = before_version + 1 AS version_step,
              coalesce(before_status = lag(after_status) OVER w AND before_version = lag(after_version) OVER w, true) AS chained
       FROM {snapshot_event} WINDOW w AS (PARTITION BY tenant_id, work_order_id ORDER BY created_at, event_id)""",
)
def log_checks(t: Tables) -> DataFrame:
    return events.audit_events(t["snapshot_event"]).select("event_id", "legal_pair", "version_step", "chained")


@query(
    "current_states", "J9",
    """SELECT tenant_id, work_order_id, arg_max(after_status, row(created_at, event_id)) AS after_status,
              arg_max(after_version, row(created_at, event_id)) AS after_version FROM {snapshot_event} GROUP BY 1, 2""",
)
def current_states(t: Tables) -> DataFrame:
    return events.current_state(t["snapshot_event"])


@query(
    "assignment_intervals", "J10",
    """SELECT tenant_id, work_order_id, event_id, assignee_id, assigned_at,
              lead(assigned_at) OVER (PARTITION BY tenant_id, work_order_id ORDER BY assigned_at, event_id) AS unassigned_at
       FROM (SELECT *, lag(assignee_id) OVER (PARTITION BY tenant_id, work_order_id ORDER BY assigned_at, event_id) AS before FROM {assignment_event}) seen
       WHERE before IS NULL OR before <> assignee_id""",
)
def assignment_intervals(t: Tables) -> DataFrame:
    return events.assignment_intervals(t["assignment_event"])


_APPLIED = """
WITH RECURSIVE numbered AS (
  SELECT c.tenant_id, c.target_id, c.command_id, c.arrived_at, c.expected_version, g.version,
         row_number() OVER (PARTITION BY c.tenant_id, c.target_id ORDER BY c.arrived_at, c.command_id) AS n
  FROM {command} c JOIN {command_target} g ON g.tenant_id = c.tenant_id AND g.id = c.target_id),
walk AS (
  SELECT tenant_id, target_id, command_id, arrived_at, expected_version, n, expected_version = version AS applied,
         version + CASE WHEN expected_version = version THEN 1 ELSE 0 END AS version FROM numbered WHERE n = 1
  UNION ALL
  SELECT e.tenant_id, e.target_id, e.command_id, e.arrived_at, e.expected_version, e.n, e.expected_version = w.version,
         w.version + CASE WHEN e.expected_version = w.version THEN 1 ELSE 0 END
  FROM walk w JOIN numbered e ON e.tenant_id = w.tenant_id AND e.target_id = w.target_id AND e.n = w.n + 1)
SELECT * FROM walk
"""


@query(
    "applied_commands", "J11",
    """SELECT tenant_id, target_id, command_id, arrived_at, expected_version, applied AND known AS applied,
              CASE WHEN NOT known THEN 'NOT_FOUND' WHEN applied THEN 'APPLIED' ELSE 'CONFLICT' END AS outcome
       FROM (SELECT *, CAST(substring(target_id, 2) AS BIGINT) % 11 <> 0 AS known FROM {applied}) a""",
    {"applied": _APPLIED},
)
def applied_commands(t: Tables) -> DataFrame:
    # Every eleventh target is unknown.
    known = t["command_target"].where("CAST(substring(id, 2) AS BIGINT) % 11 <> 0")
    return commands.apply_commands(known, t["command"])[0]


@query(
    "applied_versions", "J11",
    "SELECT tenant_id, target_id, max(version) AS version FROM {applied} GROUP BY 1, 2",
    {"applied": _APPLIED},
)
def applied_versions(t: Tables) -> DataFrame:
    return commands.apply_commands(t["command_target"], t["command"])[1]


@query(
    "request_classes", "J12",
    """SELECT request_id, CASE WHEN request_id = first_value(request_id) OVER w THEN 'EXECUTE'
              WHEN request_hash = first_value(request_hash) OVER w THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome
       FROM {request} WINDOW w AS (PARTITION BY tenant_id, operation, key ORDER BY arrived_at, request_id)""",
)
def request_classes(t: Tables) -> DataFrame:
    return commands.classify_requests(t["request"]).select("request_id", "outcome")


_TIMED = """
SELECT *, created_at + CASE WHEN action_type = 'CREATE_RECTIFICATION' THEN INTERVAL 24 HOUR ELSE INTERVAL 15 MINUTE END AS expires_at FROM {proposal}
"""


@query(
    "proposal_states", "J13",
    """SELECT id, expires_at,
              CASE action_type WHEN 'ASSIGN' THEN 'MEDIUM' WHEN 'ACCEPT' THEN 'LOW' WHEN 'UPDATE' THEN 'LOW' WHEN 'CLOSE' THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
              CASE action_type WHEN 'ASSIGN' THEN 'DISPATCHER' WHEN 'UPDATE' THEN 'DISPATCHER' WHEN 'ACCEPT' THEN 'OPERATOR' ELSE 'QUALITY_REVIEWER' END AS required_role,
              CASE WHEN status IN ('PENDING_CONFIRMATION', 'CONFIRMED') AND expires_at <= TIMESTAMP '2024-01-16 12:00:00' THEN 'EXPIRED' ELSE status END AS status
       FROM {timed}""",
    {"timed": _TIMED},
)
def proposal_states(t: Tables) -> DataFrame:
    return commands.proposal_status(t["proposal"], EVENTS_AS_OF).select("id", "expires_at", "risk_level", "required_role", "status")


_ROLE = """CASE action_type WHEN 'ASSIGN' THEN 'DISPATCHER' WHEN 'UPDATE' THEN 'DISPATCHER' WHEN 'ACCEPT' THEN 'OPERATOR' ELSE 'QUALITY_REVIEWER' END"""


@query(
    "proposal_rights", "J13",
    f"""SELECT id, service OR (has_role AND own) AS may_propose, NOT service AND has_role AND own AS may_confirm
        FROM (SELECT p.id, p.action_type <> 'ACCEPT' OR p.assignee_id = p.requested_by AS own,
                     EXISTS (SELECT 1 FROM {{actor_role}} r WHERE r.tenant_id = p.tenant_id AND r.actor_id = p.requested_by AND r.role = 'AI_SERVICE') AS service,
                     EXISTS (SELECT 1 FROM {{actor_role}} r WHERE r.tenant_id = p.tenant_id AND r.actor_id = p.requested_by AND r.role = {_ROLE.replace('action_type', 'p.action_type')}) AS has_role
              FROM {{proposal}} p) rights""",
)
def proposal_rights(t: Tables) -> DataFrame:
    asked = t["proposal"].withColumn("actor_id", F.col("requested_by"))
    return commands.authorize(asked, t["actor_role"]).select("id", "may_propose", "may_confirm")


@query(
    "queue_leftover", "J19",
    """SELECT event_id, tenant_id, attempts FROM {outbox} o WHERE status = 'PENDING' AND event_type = 'WORK_ORDER_COMPLETED'
       AND NOT (attempts > 0 AND EXISTS (SELECT 1 FROM {outbox_ack} a WHERE a.tenant_id = o.tenant_id AND a.event_id = o.event_id))""",
)
def queue_leftover(t: Tables) -> DataFrame:
    return jobs.pending_outbox(t["outbox"], t["outbox_ack"]).select("event_id", "tenant_id", "attempts")


@query(
    "inbox_messages", "J19",
    """SELECT tenant_id, provider, external_message_id, arg_min(message_id, row(received_at, message_id)) AS message_id,
              min(received_at) AS received_at, count(*) AS copies FROM {inbox_message} GROUP BY 1, 2, 3""",
)
def inbox_messages(t: Tables) -> DataFrame:
    return jobs.dedupe_inbox(t["inbox_message"])


_COMMAND_CHECKS = """
SELECT *, array_to_string(list_filter([
    CASE WHEN action_type = 'CREATE' AND target_work_order_no IS NOT NULL THEN 'target'
         WHEN action_type <> 'CREATE' AND trim(coalesce(target_work_order_no, '')) = '' THEN 'target' END,
    CASE WHEN contains(parameters, '"extra"') OR contains(parameters, '"force"') THEN 'unknown_field' END,
    CASE WHEN contains(parameters, '"assignee_name":" "') OR contains(parameters, '"reason":""') THEN 'text' END,
    CASE WHEN action_type = 'CREATE' AND NOT contains(parameters, '"due_at"') THEN 'missing_field' END,
    CASE WHEN contains(parameters, '"soon"') THEN 'time' END,
    CASE WHEN action_type = 'UPDATE' AND parameters = '{{}}' THEN 'no_change' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM {submitted_command}
"""


@query("command_checks", "J20", "SELECT command_id, reasons FROM {command_checks}", {"command_checks": _COMMAND_CHECKS})
def command_checks(t: Tables) -> DataFrame:
    return commands.validate_commands(t["submitted_command"], ANY_ID).select(
        "command_id", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "command_previews", "J21",
    """SELECT command_id, outcome, CASE WHEN outcome = 'PREVIEW' THEN CASE WHEN creates THEN 0 ELSE version END END AS expected_version,
              CASE WHEN outcome = 'PREVIEW' THEN CASE WHEN creates THEN 0 ELSE version + 1 END END AS after_version,
              CASE WHEN outcome = 'PREVIEW' THEN CASE action_type WHEN 'CREATE' THEN 'PENDING_DISPATCH' WHEN 'UPDATE' THEN status WHEN 'ASSIGN' THEN 'PENDING_ACCEPTANCE'
                   WHEN 'ACCEPT' THEN 'PENDING_ACCEPTANCE' WHEN 'START' THEN 'PROCESSING' WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'CLOSE' THEN 'CLOSED' ELSE 'CANCELLED' END END AS after_status,
              CASE WHEN outcome = 'PREVIEW' THEN CASE WHEN creates THEN 'T' WHEN contains(parameters, 'New title') THEN 'New title' ELSE title END END AS after_title,
              CASE WHEN outcome = 'PREVIEW' THEN CASE WHEN creates THEN 'HIGH' WHEN contains(parameters, '"LOW"') THEN 'LOW' ELSE priority END END AS after_priority,
              CASE WHEN outcome = 'PREVIEW' THEN CASE WHEN creates THEN TIMESTAMP '2026-07-20 08:00:00' WHEN contains(parameters, '10:30') THEN TIMESTAMP '2026-07-21 10:30:00' ELSE due_at END END AS after_due_at,
              CASE WHEN outcome = 'PREVIEW' THEN CASE WHEN action_type = 'ASSIGN' THEN 'Worker 1' WHEN creates THEN NULL ELSE assignee_name END END AS after_assignee,
              CASE WHEN outcome = 'PREVIEW' AND action_type = 'CANCEL' THEN 'changed plans' WHEN outcome = 'PREVIEW' AND NOT creates THEN cancel_reason END AS after_reason
       FROM (SELECT c.command_id, c.action_type, c.parameters, w.*, c.action_type = 'CREATE' AS creates,
               CASE WHEN c.reasons <> '' THEN 'INVALID'
                    WHEN CASE WHEN c.action_type = 'CREATE' THEN p.id IS NULL ELSE w.id IS NULL END THEN 'NOT_FOUND'
                    WHEN c.action_type = 'CREATE' THEN 'PREVIEW'
                    WHEN c.action_type = 'UPDATE' THEN CASE WHEN w.status IN ('CLOSED', 'CANCELLED') THEN 'ILLEGAL' ELSE 'PREVIEW' END
                    WHEN (c.action_type = 'ASSIGN' AND w.status = 'PENDING_DISPATCH') OR (c.action_type = 'ACCEPT' AND w.status = 'PENDING_ACCEPTANCE' AND w.accepted_at IS NULL)
                      OR (c.action_type = 'START' AND w.status = 'PENDING_ACCEPTANCE' AND w.accepted_at IS NOT NULL) OR (c.action_type = 'COMPLETE' AND w.status = 'PROCESSING')
                      OR (c.action_type = 'CLOSE' AND w.status = 'COMPLETED') OR (c.action_type = 'CANCEL' AND w.status NOT IN ('CLOSED', 'CANCELLED')) THEN 'PREVIEW'
                    ELSE 'ILLEGAL' END AS outcome
             FROM {command_checks} c
             LEFT JOIN (SELECT f.* FROM {order_fact} f WHERE EXISTS (SELECT 1 FROM {scope} s WHERE s.tenant_id = f.tenant_id AND s.project_id = f.project_id)) w
               ON w.tenant_id = c.tenant_id AND w.work_order_no = c.target_work_order_no
             LEFT JOIN {project} p ON p.tenant_id = c.tenant_id AND p.status = 'ACTIVE' AND p.id = regexp_extract(c.parameters, '"project_id":"([^"]*)"', 1)) previewed""",
    {"command_checks": _COMMAND_CHECKS},
)
def command_previews(t: Tables) -> DataFrame:
    visible = scope.scope_projects(t["order_fact"], t["scope"])
    shown = commands.preview(t["submitted_command"], visible, t["project"], AS_OF, ANY_ID)
    return shown.select(
        "command_id", "outcome", "expected_version", F.col("after.version").alias("after_version"),
        F.col("after.status").alias("after_status"), F.col("after.title").alias("after_title"),
        F.col("after.priority").alias("after_priority"), F.col("after.due_at").alias("after_due_at"),
        F.col("after.assignee_name").alias("after_assignee"), F.col("after.cancel_reason").alias("after_reason"),
    )


@query(
    "proposal_decisions", "J22",
    f"""SELECT decision_id, coalesce(outcome, CASE WHEN row_number() OVER (PARTITION BY proposal_id, outcome IS NULL ORDER BY decided_at, decision_id) > 1 THEN 'LATE'
                                         WHEN decision = 'REJECT' THEN 'REJECTED' ELSE 'CLAIMED' END) AS outcome
        FROM (SELECT d.decision_id, d.proposal_id, d.decision, d.decided_at,
                CASE WHEN d.decision NOT IN ('CONFIRM', 'REJECT') THEN 'INVALID'
                     WHEN d.decision = 'REJECT' AND NOT may THEN 'FORBIDDEN'
                     WHEN d.status IN ('PENDING_CONFIRMATION', 'CONFIRMED') AND d.expires_at <= d.decided_at THEN 'EXPIRED'
                     WHEN NOT may THEN 'FORBIDDEN'
                     WHEN d.decision = 'REJECT' AND d.status <> 'PENDING_CONFIRMATION' THEN 'INELIGIBLE'
                     WHEN d.decision = 'CONFIRM' AND NOT (d.status = 'PENDING_CONFIRMATION' OR (d.status = 'CONFIRMED' AND d.confirmed_by = d.actor_id)) THEN 'INELIGIBLE' END AS outcome
              FROM (SELECT x.*, p.status, p.expires_at, p.confirmed_by,
                      NOT EXISTS (SELECT 1 FROM {{actor_role}} r WHERE r.tenant_id = x.tenant_id AND r.actor_id = x.actor_id AND r.role = 'AI_SERVICE')
                      AND EXISTS (SELECT 1 FROM {{actor_role}} r WHERE r.tenant_id = x.tenant_id AND r.actor_id = x.actor_id AND r.role = {_ROLE.replace('action_type', 'p.action_type')})
                      AND (p.action_type <> 'ACCEPT' OR p.assignee_id = x.actor_id) AS may
                    FROM {{decision}} x JOIN {{timed}} p ON p.tenant_id = x.tenant_id AND p.id = x.proposal_id) d) checked""",
    {"timed": _TIMED},
)
def proposal_decisions(t: Tables) -> DataFrame:
    return commands.decide(t["proposal"], t["decision"], t["actor_role"]).select("decision_id", "outcome")
