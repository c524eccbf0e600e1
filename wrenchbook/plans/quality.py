"""Queries over inspections and rectification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.scalars import utc_timestamp
from wrenchbook.operators import quality, rectify
from wrenchbook.plans.bindings import AS_OF, Tables
from wrenchbook.plans.registry import query


def inputs(t: Tables) -> DataFrame:
    return quality.with_attachment_counts(t["inspection_input"], t["attachment"])


_INPUTS = """
SELECT i.*, coalesce(a.total, 0) AS attachment_count, coalesce(a.present, 0) AS present_count
FROM {inspection_input} i LEFT JOIN (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE present) AS present FROM {attachment} GROUP BY 1) a
  ON a.job_id = i.job_id
"""
_RULES = """
SELECT job_id, 0 AS ordinal, 'REQUIRED_COMPLETION_SUMMARY' AS rule_code, 'HIGH' AS severity,
       CASE WHEN length(trim(coalesce(completion_summary, ''))) > 0 THEN 'PASS' ELSE 'FAIL' END AS label,
       '{{"present":' || CASE WHEN length(trim(coalesce(completion_summary, ''))) > 0 THEN 'true' ELSE 'false' END
         || ',"length":' || length(trim(coalesce(completion_summary, ''))) || '}}' AS evidence,
       CASE WHEN length(trim(coalesce(completion_summary, ''))) > 0 THEN 'Completion summary is present.'
            ELSE 'Add a verifiable completion summary before review.' END AS recommendation
FROM {inputs}
UNION ALL
SELECT job_id, 1, 'COMPLETED_AT_RANGE', 'HIGH', CASE WHEN completed_at >= created_at THEN 'PASS' ELSE 'FAIL' END,
       '{{"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","completed_at":"' || strftime(completed_at, '%Y-%m-%dT%H:%M:%S')
         || '+00:00","completed_not_before_created":' || CASE WHEN completed_at >= created_at THEN 'true' ELSE 'false' END || '}}',
       CASE WHEN completed_at >= created_at THEN 'Completion timestamp is within the work-order lifetime.'
            ELSE 'Correct the completion timestamp so it is not before creation.' END
FROM {inputs}
UNION ALL
SELECT job_id, 2, 'SLA_COMPLETION', 'MEDIUM', CASE WHEN completed_at <= due_at THEN 'PASS' ELSE 'FAIL' END,
       '{{"completed_at":"' || strftime(completed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","due_at":"' || strftime(due_at, '%Y-%m-%dT%H:%M:%S')
         || '+00:00","overdue_seconds":' || CAST(greatest(date_diff('microsecond', due_at, completed_at), 0) / 1e6 AS DOUBLE) || '}}',
       CASE WHEN completed_at <= due_at THEN 'Completion met the due-time boundary.'
            ELSE 'Record and review the reason for completion after the due time.' END
FROM {inputs}
UNION ALL
SELECT job_id, 3, 'REQUIRED_ATTACHMENT', 'HIGH', CASE WHEN present_count > 0 THEN 'PASS' ELSE 'FAIL' END,
       '{{"attachment_count":' || attachment_count || ',"present_count":' || present_count || '}}',
       CASE WHEN present_count > 0 THEN 'At least one completion attachment is present.'
            ELSE 'Attach at least one completion artifact before review.' END
FROM {inputs}
"""
_GROUNDED = """
SELECT f.job_id, f.ordinal, f.finding_id, f.severity,
       CASE WHEN h.chunk_id IS NULL THEN 'UNCERTAIN' ELSE f.label END AS label, h.chunk_id AS policy_chunk_id, h.chunk_id IS NULL AS ungrounded
FROM {model_finding} f
LEFT JOIN (SELECT DISTINCT job_id, chunk_id FROM {policy_hit}) h ON h.job_id = f.job_id AND h.chunk_id = f.policy_chunk_id
"""
_MODEL = """
SELECT o.job_id, o.confidence,
       CASE WHEN NOT coalesce(g.changed, false) THEN o.verdict WHEN g.fails THEN 'FAIL' WHEN o.verdict = 'SKIP' THEN 'SKIP' ELSE 'UNCERTAIN' END AS verdict
FROM {model_output} o
LEFT JOIN (SELECT job_id, bool_or(ungrounded) AS changed, bool_or(label = 'FAIL') AS fails FROM {grounded} GROUP BY 1) g ON g.job_id = o.job_id
"""
_RESULTS = """
SELECT i.job_id,
       CASE WHEN i.present_count = 0 THEN 'SKIP'
            WHEN r.fails OR m.verdict = 'FAIL' OR g.fails THEN 'FAIL'
            WHEN m.verdict = 'UNCERTAIN' OR g.doubts THEN 'UNCERTAIN'
            WHEN m.verdict = 'SKIP' THEN 'SKIP' ELSE 'PASS' END AS verdict,
       round(CASE WHEN i.present_count = 0 OR r.fails THEN 1.0 ELSE m.confidence END, 4) AS confidence
FROM {inputs} i
LEFT JOIN (SELECT job_id, bool_or(label = 'FAIL') AS fails FROM {rules} GROUP BY 1) r ON r.job_id = i.job_id
LEFT JOIN {model} m ON m.job_id = i.job_id
LEFT JOIN (SELECT job_id, bool_or(label = 'FAIL') AS fails, bool_or(label = 'UNCERTAIN') AS doubts FROM {grounded} GROUP BY 1) g ON g.job_id = i.job_id
WHERE i.present_count = 0 OR m.job_id IS NOT NULL
"""
_ALL = {"inputs": _INPUTS, "rules": _RULES, "grounded": _GROUNDED, "model": _MODEL, "results": _RESULTS}


@query("rule_findings", "I1 I2 I3 I4 I5", "SELECT job_id, ordinal, rule_code, severity, label, evidence, recommendation FROM {rules}", _ALL)
def rule_findings(t: Tables) -> DataFrame:
    return quality.evaluate_rules(inputs(t)).select(
        "job_id", "ordinal", "rule_code", "severity", "label", "evidence", "recommendation"
    )


@query(
    "model_output_checks", "I6",
    """SELECT job_id, CASE WHEN s % 41 = 0 OR s % 43 = 0 OR s % 47 = 0 OR s % 29 = 0 OR s % 31 = 0 OR s % 37 = 0 OR s % 23 = 0 OR s % 19 = 0 OR s % 17 = 0 OR s % 13 = 0 OR s % 11 = 0 OR s % 7 = 0
              THEN 'QUALITY_OUTPUT_INVALID' END AS error_code
       FROM (SELECT job_id, CAST(regexp_extract(job_id, '[0-9]+$') AS BIGINT) AS s FROM {model_payload}) parsed""",
)
def model_output_checks(t: Tables) -> DataFrame:
    payloads = t["model_payload"]
    allowed = payloads.select("job_id", F.lit("POLICY_A").alias("rule_code"))
    return quality.validate_outputs(payloads, allowed).select("job_id", "error_code")


@query("policy_rule_codes", "I6 F6",
    """SELECT DISTINCT chunk_id, 'POLICY_' || upper(substr(h, 1, 12) || '5' || substr(h, 14, 3)
              || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 15)) AS rule_code
       FROM (SELECT chunk_id, sha1(unhex('05533578037752bba97ec4c6f2460004') || encode(chunk_id)) AS h FROM {model_payload}) hashed""")
def policy_rule_codes(t: Tables) -> DataFrame:
    return t["model_payload"].select("chunk_id", quality.policy_rule_code(F.col("chunk_id")).alias("rule_code")).distinct()


@query("grounded_findings", "I7", "SELECT job_id, ordinal, finding_id, label, policy_chunk_id, ungrounded FROM {grounded}", _ALL)
def grounded_findings(t: Tables) -> DataFrame:
    return quality.ground_findings(t["model_finding"], t["policy_hit"]).select(
        "job_id", "ordinal", "finding_id", "label", "policy_chunk_id", "ungrounded"
    )


@query("grounded_verdicts", "I7", "SELECT job_id, verdict, confidence FROM {model}", _ALL)
def grounded_verdicts(t: Tables) -> DataFrame:
    return quality.ground_verdicts(t["model_output"], quality.ground_findings(t["model_finding"], t["policy_hit"]))


@query(
    "policy_versions", "I8",
    """SELECT job_id, string_agg(document_key || '=' || version, ',' ORDER BY document_key) AS versions
       FROM (SELECT job_id, document_key, max(document_version) AS version FROM {policy_hit} GROUP BY 1, 2) newest GROUP BY 1""",
)
def policy_versions(t: Tables) -> DataFrame:
    entries = F.transform(
        F.map_entries("policy_versions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return quality.policy_versions(t["policy_hit"]).select("job_id", F.array_join(entries, ",").alias("versions"))


@query(
    "label_verdicts", "I9",
    """SELECT job_id, CASE max(CASE label WHEN 'FAIL' THEN 4 WHEN 'UNCERTAIN' THEN 3 WHEN 'SKIP' THEN 2 ELSE 1 END)
              WHEN 4 THEN 'FAIL' WHEN 3 THEN 'UNCERTAIN' WHEN 2 THEN 'SKIP' ELSE 'PASS' END AS verdict
       FROM (SELECT job_id, label FROM {model_finding} UNION ALL SELECT job_id, verdict FROM {model_output}) labels GROUP BY 1""",
)
def label_verdicts(t: Tables) -> DataFrame:
    labels = t["model_finding"].select("job_id", "label").unionByName(
        t["model_output"].select("job_id", F.col("verdict").alias("label"))
    )
    return quality.verdicts(labels)


def inspected(t: Tables) -> quality.Inspection:
    return quality.inspect(inputs(t), t["model_output"], t["model_finding"], t["policy_hit"])


@query("inspection_results", "I10", "SELECT job_id, verdict, confidence FROM {results}", _ALL)
def inspection_results(t: Tables) -> DataFrame:
    return inspected(t).results


@query(
    "assembled_results", "I11",
    """SELECT r.job_id, r.verdict, count(*) AS findings, string_agg(f.label, '' ORDER BY f.ordinal, f.label) AS labels, max(o.latency_ms) AS latency_ms
       FROM {results} r
       JOIN (SELECT job_id, ordinal, label FROM {rules}
             UNION ALL
             SELECT g.job_id, g.ordinal + 4, g.label FROM {grounded} g JOIN {inputs} i ON i.job_id = g.job_id AND i.present_count > 0) f ON f.job_id = r.job_id
       LEFT JOIN {calls} o ON o.job_id = r.job_id
       GROUP BY 1, 2""",
    {**_ALL, "calls": "SELECT 'j' || substring(id, 3) AS job_id, latency_ms FROM {model_call}"},
)
def assembled_results(t: Tables) -> DataFrame:
    done = inspected(t)
    calls = t["model_call"].select(F.concat(F.lit("j"), F.substring("id", 3, 20)).alias("job_id"), "latency_ms")
    nested = quality.assemble(done.results, done.findings, calls)
    labels = F.transform(
        F.array_sort(F.transform("findings", lambda f: F.struct(f["ordinal"].alias("ordinal"), f["label"].alias("label")))),
        lambda f: f["label"],
    )
    return nested.select(
        "job_id", "verdict", F.size("findings").cast("bigint").alias("findings"), F.array_join(labels, "").alias("labels"),
        F.col("model_call.latency_ms").alias("latency_ms"),
    )


@query(
    "safe_snapshots", "I12",
    """SELECT event_id, payload ->> 'id' AS id, payload ->> 'tenant_id' AS tenant_id, CAST(payload ->> 'version' AS BIGINT) AS version,
              payload ->> 'status' AS status, payload ->> 'title' AS title, false AS leaks,
              '{{"id":"' || (payload ->> 'id') || '","tenant_id":"' || (payload ->> 'tenant_id') || '","version":' || (payload ->> 'version')
                || ',"status":"' || (payload ->> 'status') || '"}}' AS callback_snapshot
       FROM {outbox}""",
)
def safe_snapshots(t: Tables) -> DataFrame:
    kept = t["outbox"].select(
        "event_id",
        quality.safe_snapshot(F.col("payload"), schemas.INSPECTION_FIELDS).alias("s"),
        quality.safe_snapshot(F.col("payload"), schemas.CALLBACK_FIELDS).alias("callback_snapshot"),
    )
    fields = F.from_json("s", quality.snapshot_schema(schemas.INSPECTION_FIELDS))
    return kept.select(
        "event_id", fields["id"].alias("id"), fields["tenant_id"].alias("tenant_id"), fields["version"].alias("version"),
        fields["status"].alias("status"), fields["title"].alias("title"), F.contains("s", F.lit("extra")).alias("leaks"),
        "callback_snapshot",
    )


@query(
    "event_checks", "I13",
    """SELECT event_id, array_to_string(list_filter([
         CASE WHEN payload ->> 'id' <> aggregate_id THEN 'identity' END,
         CASE WHEN payload ->> 'tenant_id' <> tenant_id THEN 'tenant' END,
         CASE WHEN CAST(payload ->> 'version' AS BIGINT) < 0 THEN 'version' END,
         CASE WHEN payload ->> 'status' <> 'COMPLETED' THEN 'status' END,
         CASE WHEN CAST(payload ->> 'inspection_round' AS INT) < 1 THEN 'round' END,
         CASE WHEN contains(payload, '"Photo_URL":') OR contains(payload, '" token ":') THEN 'forbidden_key' END], lambda r: r IS NOT NULL), ',') AS reasons
       FROM {outbox}""",
)
def event_checks(t: Tables) -> DataFrame:
    return quality.check_events(t["outbox"]).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "parsed_times", "I14",
    "SELECT event_id, ts AS naive, ts AS zulu, ts - INTERVAL 2 HOUR AS shifted, CAST(NULL AS TIMESTAMP) AS broken FROM {events}",
)
def parsed_times(t: Tables) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return t["events"].select(
        "event_id",
        utc_timestamp(F.concat(F.lit(" "), text)).alias("naive"),
        utc_timestamp(F.concat(text, F.lit("Z"))).alias("zulu"),
        utc_timestamp(F.concat(text, F.lit("+02:00"))).alias("shifted"),
        utc_timestamp(F.concat(F.lit("on "), text)).alias("broken"),
    )


@query(
    "inspection_queries", "I15",
    """SELECT job_id, concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(description), ''), nullif(trim(order_type), ''), nullif(trim(space_path), ''),
              nullif(trim(completion_summary), '')) AS query FROM {inspection_input}""",
)
def inspection_queries(t: Tables) -> DataFrame:
    return t["inspection_input"].select("job_id", quality.inspection_query().alias("query"))


@query(
    "call_summaries", "I16",
    """SELECT job_id, request_hash, response_hash, length(raw_response) AS kept_chars, right(raw_response, 1) AS last_char FROM (
         SELECT doc_id AS job_id, sha256(source) AS request_hash, sha256(text) AS response_hash,
                CASE WHEN strlen(text) <= 8192 THEN text
                     ELSE left(text, list_max(list_filter(range(2048, 8193), lambda n: strlen(left(text, n)) <= 8192))) END AS raw_response
         FROM {documents}) cut""",
)
def call_summaries(t: Tables) -> DataFrame:
    calls = t["documents"].select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("request"), F.col("text").alias("response"),
        F.lit("PASS").alias("verdict"), F.lit(0).alias("finding_count"),
    )
    return quality.call_summary(calls).select(
        "job_id", "request_hash", "response_hash", F.length("raw_response").cast("bigint").alias("kept_chars"),
        F.right("raw_response", F.lit(1)).alias("last_char"),
    )


# Some results come twice, and some orders get a second result for the same round an hour later.
_RESULT = "tenant_id, work_order_id, work_order_version, inspection_round, verdict"
_DELIVERED = f"""
SELECT id, {_RESULT}, generated_at FROM {{quality_result}}
UNION ALL SELECT id, {_RESULT}, generated_at FROM {{quality_result}} WHERE confidence > 0.9
UNION ALL SELECT 'x' || id AS id, {_RESULT}, generated_at + INTERVAL 1 HOUR AS generated_at FROM {{quality_result}} WHERE confidence BETWEEN 0.7 AND 0.95
"""


@query(
    "opened_cases", "J14 J17",
    """SELECT id, tenant_id, work_order_id, inspection_round, verdict, action,
         coalesce(known, CASE WHEN first_id <> id AND (first_at < generated_at OR first_at = generated_at AND first_id < id) THEN 'CONFLICT'
                              WHEN verdict = 'SKIP' THEN 'SKIPPED' WHEN delivery > 1 THEN 'EXISTING' ELSE 'CREATED' END) AS outcome
       FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, id ORDER BY generated_at) AS delivery,
                    arg_min(id, row(generated_at, id)) FILTER (WHERE known IS NULL AND verdict <> 'SKIP') OVER (PARTITION BY tenant_id, work_order_id, inspection_round) AS first_id,
                    min(generated_at) FILTER (WHERE known IS NULL AND verdict <> 'SKIP') OVER (PARTITION BY tenant_id, work_order_id, inspection_round) AS first_at
       FROM (SELECT *, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN version <> work_order_version OR status <> 'COMPLETED' THEN 'INVALID'
                            WHEN stored THEN 'EXISTING' WHEN taken THEN 'CONFLICT' END AS known
       FROM (SELECT q.*, w.status, w.version, CASE q.verdict WHEN 'SKIP' THEN 'SKIP' WHEN 'PASS' THEN 'CLOSE' ELSE 'CREATE_RECTIFICATION' END AS action,
                    EXISTS (SELECT 1 FROM {rectification_case} c WHERE c.tenant_id = q.tenant_id AND c.current_quality_result_id = q.id AND c.status = 'CLOSED') AS stored,
                    EXISTS (SELECT 1 FROM {rectification_case} c WHERE c.tenant_id = q.tenant_id AND c.original_work_order_id = q.work_order_id
                                                                   AND c.inspection_round = q.inspection_round AND c.status = 'CLOSED') AS taken
             FROM {delivered} q LEFT JOIN {order_fact} w ON w.tenant_id = q.tenant_id AND w.id = q.work_order_id) checked) judged) ranked""",
    {"delivered": _DELIVERED},
)
def opened_cases(t: Tables) -> DataFrame:
    stored = t["rectification_case"].filter(F.col("status") == "CLOSED")
    return rectify.open_cases(t.sql(_DELIVERED), t["order_fact"], stored).select(
        "id", "tenant_id", "work_order_id", "inspection_round", "verdict", "action", "outcome"
    )


@query(
    "rework_orders", "J15",
    """SELECT c.tenant_id, c.id AS case_id, 'RW-' || left(replace(c.current_quality_result_id, '-', ''), 20) AS work_order_no,
              left('Rectification: ' || w.title, 200) AS title, w.project_id, w.project_name, w.space_path, 'HIGH' AS priority,
              coalesce(w.root_work_order_id, w.id) AS root_work_order_id, coalesce(w.root_work_order_no, w.work_order_no) AS root_work_order_no,
              coalesce(f.recommendation, 'Review and rectify quality result ' || c.current_quality_result_id) AS rework_reason,
              TIMESTAMP '1998-06-17 00:00:00' AS due_at
       FROM {rectification_case} c JOIN {work_order} w ON w.tenant_id = c.tenant_id AND w.id = c.original_work_order_id
       LEFT JOIN (SELECT tenant_id, quality_result_id, left(arg_min(recommendation, row(ordinal, id)), 300) AS recommendation
                  FROM {quality_finding} WHERE label IN ('FAIL', 'UNCERTAIN') GROUP BY 1, 2) f
         ON f.tenant_id = c.tenant_id AND f.quality_result_id = c.current_quality_result_id
       WHERE c.current_verdict IN ('FAIL', 'UNCERTAIN')""",
)
def rework_orders(t: Tables) -> DataFrame:
    return rectify.rework_orders(t["rectification_case"], t["work_order"], t["quality_finding"], AS_OF).select(
        "tenant_id", "case_id", "work_order_no", "title", "project_id", "project_name", "space_path", "priority",
        "root_work_order_id", "root_work_order_no", "rework_reason", "due_at",
    )


_PROPOSED = """SELECT id, tenant_id, current_verdict, current_quality_result_id, original_work_order_id, CAST(NULL AS STRING) AS rectification_work_order_id,
       CASE WHEN status = 'CLOSED' THEN status ELSE 'PROPOSED' END AS status, closed_at FROM {rectification_case}"""


@query(
    "advanced_cases", "J16",
    """SELECT c.id, c.tenant_id,
         CASE WHEN c.status = 'PROPOSED' AND e.action = 'CREATE_RECTIFICATION' AND c.current_verdict IN ('FAIL', 'UNCERTAIN') THEN 'RECTIFYING'
              WHEN c.status = 'PROPOSED' AND e.action = 'CLOSE' AND c.current_verdict = 'PASS' THEN 'CLOSED' ELSE c.status END AS status,
         CASE WHEN c.status = 'PROPOSED' AND e.action = 'CLOSE' AND c.current_verdict = 'PASS' THEN e.executed_at ELSE c.closed_at END AS closed_at,
         CASE WHEN c.status = 'PROPOSED' AND e.action = 'CREATE_RECTIFICATION' AND c.current_verdict IN ('FAIL', 'UNCERTAIN') THEN e.work_order_id END AS rectification_work_order_id,
         true AS valid
       FROM {proposed} c LEFT JOIN {execution} e ON e.tenant_id = c.tenant_id AND e.case_id = c.id""",
    {
        "proposed": _PROPOSED,
        "execution": """SELECT tenant_id, 'rc' || substring(id, 3) AS case_id, CASE verdict WHEN 'PASS' THEN 'CLOSE' WHEN 'UNCERTAIN' THEN 'CLOSE' ELSE 'CREATE_RECTIFICATION' END AS action,
                               'rw' || id AS work_order_id, generated_at AS executed_at FROM {quality_result} WHERE confidence > 0.6""",
    },
)
def advanced_cases(t: Tables) -> DataFrame:
    executions = t["quality_result"].filter("confidence > 0.6").select(
        "tenant_id",
        F.concat(F.lit("rc"), F.substring("id", 3, 20)).alias("case_id"),
        F.when(F.col("verdict").isin("PASS", "UNCERTAIN"), "CLOSE").otherwise("CREATE_RECTIFICATION").alias("action"),
        F.concat(F.lit("rw"), "id").alias("work_order_id"),
        F.col("generated_at").alias("executed_at"),
    )
    return rectify.advance_cases(t.sql(_PROPOSED), executions).select(
        "id", "tenant_id", "status", "closed_at", "rectification_work_order_id", "valid"
    )


@query(
    "review_events", "J17",
    """SELECT tenant_id, id AS case_id, current_quality_result_id AS quality_result_id,
              CASE WHEN current_verdict = 'PASS' THEN 'CLOSE' ELSE 'REQUEST_REWORK' END AS decision, current_verdict AS reviewed_verdict,
              'AI quality result received' AS reason FROM {rectification_case}""",
)
def review_events(t: Tables) -> DataFrame:
    return rectify.review_events(t["rectification_case"], "service", AS_OF).select(
        "tenant_id", "case_id", "quality_result_id", "decision", "reviewed_verdict", "reason"
    )


@query(
    "pending_callbacks", "J18",
    """SELECT tenant_id, id, generated_at, CAST(position AS INT) AS position FROM (
         SELECT tenant_id, id, generated_at, row_number() OVER (PARTITION BY tenant_id ORDER BY generated_at, id) AS position FROM {quality_result} q
         WHERE NOT EXISTS (SELECT 1 FROM {rectification_case} c WHERE c.tenant_id = q.tenant_id AND c.current_quality_result_id = q.id AND c.status = 'CLOSED')) ranked
       WHERE position <= 20""",
)
def pending_callbacks(t: Tables) -> DataFrame:
    delivered = t["rectification_case"].filter(F.col("status") == "CLOSED").select(
        "tenant_id", F.col("current_quality_result_id").alias("id")
    )
    return rectify.pending_callbacks(t["quality_result"], delivered, 20).select("tenant_id", "id", "generated_at", "position")
