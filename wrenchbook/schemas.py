"""Domain vocabulary: fixed values and explicit schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# They must equal the source system's for right results.
STATUSES = ("PENDING_DISPATCH", "PENDING_ACCEPTANCE", "PROCESSING", "COMPLETED", "CLOSED", "CANCELLED")
DONE_STATUSES = ("COMPLETED", "CLOSED")
FINAL_STATUSES = ("COMPLETED", "CLOSED", "CANCELLED")
ROLES = ("TENANT_ADMIN", "DISPATCHER", "OPERATOR", "QUALITY_REVIEWER", "AI_SERVICE")
VERDICTS = ("PASS", "FAIL", "UNCERTAIN", "SKIP")
SEVERITIES = ("LOW", "MEDIUM", "HIGH")
SLA_HOURS = {"URGENT": 2, "HIGH": 8, "MEDIUM": 24}
SLA_OTHER_HOURS = 48
SEEDED_WORK_MINUTES = 90
TRANSITIONS = {
    ("PENDING_DISPATCH", "ASSIGN"): "PENDING_ACCEPTANCE",
    ("PENDING_DISPATCH", "CANCEL"): "CANCELLED",
    ("PENDING_ACCEPTANCE", "ACCEPT"): "PENDING_ACCEPTANCE",
    ("PENDING_ACCEPTANCE", "START"): "PROCESSING",
    ("PENDING_ACCEPTANCE", "CANCEL"): "CANCELLED",
    ("PROCESSING", "COMPLETE"): "COMPLETED",
    ("PROCESSING", "CANCEL"): "CANCELLED",
    ("COMPLETED", "CLOSE"): "CLOSED",
    ("COMPLETED", "CANCEL"): "CANCELLED",
}
EVENT_TYPES = {
    "CREATE": "WORK_ORDER_CREATED",
    "ASSIGN": "WORK_ORDER_ASSIGNED",
    "UPDATE": "WORK_ORDER_UPDATED",
    "ACCEPT": "WORK_ORDER_ACCEPTED",
    "START": "WORK_ORDER_STARTED",
    "COMPLETE": "WORK_ORDER_COMPLETED",
    "CLOSE": "WORK_ORDER_CLOSED",
    "CREATE_RECTIFICATION": "WORK_ORDER_CREATED",
    "CANCEL": "WORK_ORDER_CANCELLED",
}
RISK_LEVELS = {
    "UPDATE": "LOW",
    "ACCEPT": "LOW",
    "CREATE": "MEDIUM",
    "ASSIGN": "MEDIUM",
    "START": "MEDIUM",
    "COMPLETE": "HIGH",
    "CLOSE": "HIGH",
    "CANCEL": "HIGH",
    "CREATE_RECTIFICATION": "CRITICAL",
}
REQUIRED_ROLES = {
    "CREATE": "DISPATCHER",
    "ASSIGN": "DISPATCHER",
    "UPDATE": "DISPATCHER",
    "CANCEL": "DISPATCHER",
    "ACCEPT": "OPERATOR",
    "START": "OPERATOR",
    "COMPLETE": "OPERATOR",
    "CLOSE": "QUALITY_REVIEWER",
    "CREATE_RECTIFICATION": "QUALITY_REVIEWER",
}
SELF_ASSIGNED_ACTIONS = ("ACCEPT", "START", "COMPLETE")
SERVICE_ROLE = "AI_SERVICE"
COMMAND_FIELDS = {
    "CREATE": (
        "work_order_no", "title", "description", "project_id", "space_path",
        "order_type", "priority", "source", "due_at",
    ),
    "ASSIGN": ("assignee_id", "assignee_name", "reason"),
    "UPDATE": ("title", "description", "priority", "due_at"),
    "CANCEL": ("reason",),
    "ACCEPT": (),
    "START": (),
    "COMPLETE": (),
    "CLOSE": (),
}
PROPOSAL_MINUTES = 15
QUALITY_PROPOSAL_MINUTES = 24 * 60
LEASE_MINUTES = 15
OUTBOX_LEASE_MINUTES = 5
RETRY_BASE_MINUTES = 5
RETRY_CAP_MINUTES = 60
MAX_ATTEMPTS = 3
FORBIDDEN_KEYS = (
    "attachment_url", "attachment_uri", "database_url", "password", "secret", "token", "credential",
)
SNAPSHOT_FIELDS = (
    "id", "tenant_id", "work_order_no", "title", "description", "project_id",
    "project_name", "space_path", "order_type", "priority", "status", "assignee_id",
    "assignee_name", "source", "root_work_order_id", "root_work_order_no",
    "rework_reason", "version", "accepted_at", "created_by", "updated_by",
    "created_at", "due_at", "completed_at", "cancelled_at", "cancel_reason",
)
INSPECTION_FIELDS = (
    "id", "tenant_id", "version", "status", "title", "description", "order_type",
    "priority", "space_path", "completion_summary", "created_at", "due_at", "completed_at",
)
CALLBACK_FIELDS = ("id", "tenant_id", "version", "status", "completed_at")
ID_NAMESPACE = "2869d879-62b7-51ac-8ff5-e21ee6cae454"
RESULT_NAMESPACE = "05533578-0377-52bb-a97e-c4c6f2460001"
AUDIT_NAMESPACE = "05533578-0377-52bb-a97e-c4c6f2460002"
REQUEST_NAMESPACE = "05533578-0377-52bb-a97e-c4c6f2460003"
POLICY_CHUNK_NAMESPACE = "05533578-0377-52bb-a97e-c4c6f2460004"
RULE_TEXTS = {
    "REQUIRED_COMPLETION_SUMMARY": (
        "HIGH",
        "Completion summary is present.",
        "Add a verifiable completion summary before review.",
    ),
    "COMPLETED_AT_RANGE": (
        "HIGH",
        "Completion timestamp is within the work-order lifetime.",
        "Correct the completion timestamp so it is not before creation.",
    ),
    "SLA_COMPLETION": (
        "MEDIUM",
        "Completion met the due-time boundary.",
        "Record and review the reason for completion after the due time.",
    ),
    "REQUIRED_ATTACHMENT": (
        "HIGH",
        "At least one completion attachment is present.",
        "Attach at least one completion artifact before review.",
    ),
}

ATTACHMENT = T.StructType(
    [
        T.StructField("attachment_id", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("present", T.BooleanType()),
    ]
)

MODEL_FINDING = T.StructType(
    [
        T.StructField("rule_code", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("policy_chunk_id", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

MODEL_OUTPUT = T.StructType(
    [
        T.StructField("verdict", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("findings", T.ArrayType(MODEL_FINDING)),
    ]
)

WORK_ORDER = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("work_order_no", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("space_path", T.StringType()),
        T.StructField("order_type", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("assignee_id", T.StringType()),
        T.StructField("assignee_name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("root_work_order_id", T.StringType()),
        T.StructField("root_work_order_no", T.StringType()),
        T.StructField("rework_reason", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("accepted_at", T.TimestampNTZType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("due_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
        T.StructField("cancelled_at", T.TimestampNTZType()),
        T.StructField("cancel_reason", T.StringType()),
    ]
)

OUTBOX = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("aggregate_type", T.StringType()),
        T.StructField("aggregate_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("occurred_at", T.TimestampNTZType()),
        T.StructField("available_at", T.TimestampNTZType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)

EVALUATION_CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("expected_document_ids", T.ArrayType(T.StringType())),
        T.StructField("expected_tools", T.ArrayType(T.StringType())),
        T.StructField("required_facts", T.ArrayType(T.StringType())),
        T.StructField("forbidden_facts", T.ArrayType(T.StringType())),
    ]
)

RETRIEVAL_CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("challenge", T.StringType()),
        T.StructField("expected_document_ids", T.ArrayType(T.StringType())),
    ]
)
