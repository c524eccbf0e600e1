"""Commands and proposals: validation, preview, concurrency, idempotency, decisions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.ordering import SEGMENT, by_time
from wrenchbook.functions.scalars import lookup, plus_minutes
from wrenchbook.functions.text import is_blank, strip
from wrenchbook.operators.events import action_code, next_state, state_code, status_of
from wrenchbook.operators.quality import UUID_TEXT
from wrenchbook.operators.views import moment

LOCAL_DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def version_moves(expected: Iterable[int]) -> dict[int, int]:
    """For each version that a run of commands can start from, the version it ends at.

    Versions that no command expects stay as they are. Read backwards, so that
    one pass serves all start versions.
    """
    ends: dict[int, int] = {}
    for version in reversed(list(expected)):
        ends[version] = ends.get(version + 1, version + 1)
    return ends


def applied_flags(start: int, expected: Iterable[int]) -> list[bool]:
    flags, version = [], start
    for wanted in expected:
        flags.append(wanted == version)
        version += wanted == version
    return flags


def apply_commands(targets: DataFrame, commands: DataFrame, grain: str = "day") -> tuple[DataFrame, DataFrame]:
    """Optimistic concurrency: a command applies only if it expects the current version.

    Returns the commands with ``applied`` and the version they met, and the
    final version per target. Like the event replay, each (target, interval) is
    summarised as a map from start to end version, the maps are chained per
    target, and every interval is judged from its true start version. A command
    on an unknown target stays, is not applied and has the outcome ``NOT_FOUND``;
    such targets have no final version.
    """
    keys = ["tenant_id", "target_id"]
    item = F.struct("arrived_at", "command_id", "expected_version")
    segments = (
        commands.withColumn(SEGMENT, by_time("arrived_at", grain))
        .groupBy(*keys, SEGMENT)
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .withColumn("_expected", F.transform("_items", lambda i: i["expected_version"]))
    )

    @F.pandas_udf("map<bigint,bigint>")
    def moves(expected: pd.Series) -> pd.Series:
        return expected.map(lambda versions: version_moves(int(v) for v in versions))

    @F.pandas_udf("array<boolean>")
    def flags(start: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([applied_flags(int(s), (int(v) for v in e)) for s, e in zip(start, expected)])

    current = targets.select("tenant_id", F.col("id").alias("target_id"), F.col("version").alias("_version"))
    chains = (
        segments.select(*keys, SEGMENT, moves(F.col("_expected")).alias("_moves"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(SEGMENT), F.map_entries("_moves").alias("_moves")))).alias("_chain"))
        .join(current, keys, "left")
    )
    walk = F.aggregate(
        "_chain",
        F.struct(F.col("_version").alias("version"), F.expr("CAST(array() AS array<bigint>)").alias("starts")),
        lambda acc, part: F.struct(
            F.coalesce(F.try_element_at(F.map_from_entries(part["_moves"]), acc["version"]), acc["version"]).alias("version"),
            F.concat(acc["starts"], F.array(acc["version"])).alias("starts"),
        ),
    )
    walked = chains.withColumn("_walk", walk)
    starts = walked.select(
        *keys, F.posexplode("_chain").alias("_at", "_part"), F.col("_walk.starts").alias("_starts")
    ).select(*keys, F.col(f"_part.{SEGMENT}").alias(SEGMENT), F.element_at("_starts", F.col("_at") + 1).alias("_start"))
    judged = (
        segments.join(starts, [*keys, SEGMENT])
        .withColumn("_applied", flags(F.coalesce("_start", F.lit(0)), F.col("_expected")))
        .select(*keys, "_start", F.explode(F.arrays_zip("_items", "_applied")).alias("_r"))
        .select(
            *keys, "_r._items.command_id", "_r._items.arrived_at", "_r._items.expected_version",
            (F.col("_start").isNotNull() & F.col("_r._applied")).alias("applied"),
            F.when(F.col("_start").isNull(), "NOT_FOUND").when(F.col("_r._applied"), "APPLIED").otherwise("CONFLICT").alias("outcome"),
        )
    )
    finals = walked.where("_version IS NOT NULL").select(*keys, F.col("_walk.version").alias("version"))
    return judged, finals


def classify_requests(requests: DataFrame) -> DataFrame:
    """First request of a key executes, the same hash replays, another hash conflicts.

    The first request comes from an aggregate that combines before the shuffle;
    a key that most requests share does not gather in one group.
    """
    key = ["tenant_id", "operation", "key"]
    first = requests.groupBy(*key).agg(
        F.min_by(F.struct("request_id", "request_hash"), F.struct("arrived_at", "request_id")).alias("_first")
    )
    outcome = (
        F.when(F.col("request_id") == F.col("_first.request_id"), "EXECUTE")
        .when(F.col("request_hash").eqNullSafe(F.col("_first.request_hash")), "REPLAY")
        .otherwise("CONFLICT")
    )
    return requests.join(first, key).withColumn("outcome", outcome).drop("_first")


def expires_at() -> Column:
    quality = F.col("action_type") == "CREATE_RECTIFICATION"
    if_quality = F.when(quality, schemas.QUALITY_PROPOSAL_MINUTES).otherwise(schemas.PROPOSAL_MINUTES)
    return plus_minutes(F.col("created_at"), if_quality)


_OPEN = ("PENDING_CONFIRMATION", "CONFIRMED")


def _expired(at: Column) -> Column:
    return (F.col("status") == "EXPIRED") | (F.col("status").isin(*_OPEN) & (F.col("expires_at") <= at))


def proposal_status(proposals: DataFrame, as_of: str | datetime) -> DataFrame:
    """Adds expiry time, risk, the role that may confirm, and the status as of an instant."""
    timed = proposals if "expires_at" in proposals.columns else proposals.withColumn("expires_at", expires_at())
    return (
        timed.withColumn("risk_level", lookup(schemas.RISK_LEVELS, F.col("action_type")))
        .withColumn("required_role", lookup(schemas.REQUIRED_ROLES, F.col("action_type")))
        .withColumn("status", F.when(_expired(moment(as_of)), "EXPIRED").otherwise(F.col("status")))
    )


def with_roles(df: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds the granted roles of ``actor_id``; there are only a handful of roles."""
    roles = grants.groupBy("tenant_id", "actor_id").agg(F.collect_set("role").alias("_roles"))
    empty = F.expr("CAST(array() AS array<string>)")
    return df.join(roles, ["tenant_id", "actor_id"], "left").withColumn("_roles", F.coalesce("_roles", empty))


def _permitted(confirming: bool) -> Column:
    service = F.array_contains("_roles", schemas.SERVICE_ROLE)
    has_role = F.array_contains(F.col("_roles"), lookup(schemas.REQUIRED_ROLES, F.col("action_type")))
    own = ~F.col("action_type").isin(*schemas.SELF_ASSIGNED_ACTIONS) | F.col("assignee_id").eqNullSafe(F.col("actor_id"))
    if confirming:
        return ~service & F.coalesce(has_role, F.lit(False)) & own
    return service | (F.coalesce(has_role, F.lit(False)) & own)


def authorize(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds ``may_propose`` and ``may_confirm`` to rows with actor, action and assignee.

    Service identities may propose without role or own assignment, but never confirm.
    """
    return (
        with_roles(requests, grants)
        .withColumn("may_propose", _permitted(confirming=False))
        .withColumn("may_confirm", _permitted(confirming=True))
        .drop("_roles")
    )


def decide(proposals: DataFrame, decisions: DataFrame, grants: DataFrame) -> DataFrame:
    """Outcome of each decision; the first one that passes its checks takes the proposal.

    Outcomes: CLAIMED, REJECTED, LATE (a valid one came first), EXPIRED,
    FORBIDDEN, INELIGIBLE, INVALID (neither CONFIRM nor REJECT) and NOT_FOUND.
    """
    key = ["tenant_id", "proposal_id"]
    target = proposals.withColumn("expires_at", expires_at()).select(
        "tenant_id", F.col("id").alias("proposal_id"), "action_type", "assignee_id", "status", "confirmed_by", "expires_at"
    )
    at, word = F.col("decided_at"), F.col("decision")
    pending = F.col("status") == "PENDING_CONFIRMATION"
    claims = pending | ((F.col("status") == "CONFIRMED") & F.col("confirmed_by").eqNullSafe(F.col("actor_id")))
    eligible = F.when(word == "REJECT", pending).otherwise(claims)
    forbidden, expired = ~_permitted(confirming=True), _expired(at)
    checked = with_roles(decisions, grants).join(target, key, "left").withColumn(
        "outcome",
        F.when(~word.isin("CONFIRM", "REJECT"), "INVALID")
        .when(F.col("status").isNull(), "NOT_FOUND")
        .when((word == "REJECT") & forbidden, "FORBIDDEN")
        .when(expired, "EXPIRED")
        .when(forbidden, "FORBIDDEN")
        .when(~eligible, "INELIGIBLE"),
    )
    winners = (
        checked.filter(F.col("outcome").isNull())
        .groupBy(*key)
        .agg(F.min_by("decision_id", F.struct("decided_at", "decision_id")).alias("_winner"))
    )
    taken = F.when(F.col("decision_id") != F.col("_winner"), "LATE").when(word == "REJECT", "REJECTED").otherwise("CLAIMED")
    return (
        checked.join(winners, key, "left")
        .withColumn("outcome", F.coalesce("outcome", taken))
        .select(*decisions.columns, "outcome")
    )


def _text_field(parameters: Column, name: str) -> Column:
    """A stripped text field; NULL when absent or JSON null."""
    return strip(F.get_json_object(parameters, f"$.{name}"))


def _is_text(parsed: Column, name: str) -> Column:
    """The field is absent, JSON null, or text."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    return F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))


def validate_commands(commands: DataFrame, id_pattern: str = UUID_TEXT) -> DataFrame:
    """Adds the parsed fields and ``reasons`` to (action_type, target_work_order_no, parameters).

    Each action has its own fields: unknown ones, blank or missing texts,
    malformed ids and times are refused; CREATE names no target, all others do;
    an update changes at least one field.
    """
    action, raw = F.trim(F.col("action_type")), F.col("parameters")
    fields = sorted({f for names in schemas.COMMAND_FIELDS.values() for f in names})
    allowed = F.create_map(
        *[x for name, names in schemas.COMMAND_FIELDS.items() for x in (F.lit(name), F.array(*[F.lit(n) for n in names]).cast("array<string>"))]
    )
    parsed = commands.withColumn("_json", F.try_parse_json(raw)).withColumn("_keys", F.json_object_keys(raw))
    for name in fields:
        parsed = parsed.withColumn(f"p_{name}", _text_field(raw, name))
    given = {name: F.col(f"p_{name}") for name in fields}
    known_action = action.isin(*schemas.COMMAND_FIELDS)
    unknown_field = F.size(F.array_except("_keys", F.try_element_at(allowed, action))) > 0
    bad_text = F.lit(False)
    for name in fields:
        bad_text = bad_text | (given[name].isNotNull() & (F.length(given[name]) == 0)) | ~_is_text(F.col("_json"), name)
    missing = F.lit(False)
    for name, names in schemas.COMMAND_FIELDS.items():
        for needed in names if name != "UPDATE" else ():
            missing = missing | ((action == name) & given[needed].isNull())
    bad_id = F.lit(False)
    for name in ("project_id", "assignee_id"):
        bad_id = bad_id | (given[name].isNotNull() & ~given[name].rlike(id_pattern))
    bad_time = given["due_at"].isNotNull() & (
        ~given["due_at"].rlike(LOCAL_DATE_TIME) | F.try_to_timestamp(given["due_at"]).isNull()
    )
    nothing = (action == "UPDATE") & F.coalesce(*[given[n] for n in schemas.COMMAND_FIELDS["UPDATE"]]).isNull()
    target = F.col("target_work_order_no")
    checks = {
        "action": ~F.coalesce(known_action, F.lit(False)),
        "parameters": F.col("_json").isNull() | F.col("_keys").isNull(),
        "target": F.when(action == "CREATE", target.isNotNull()).otherwise(is_blank(target)),
        "unknown_field": unknown_field,
        "text": bad_text,
        "missing_field": missing,
        "id": bad_id,
        "time": bad_time,
        "no_change": nothing,
    }
    reasons = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))
    return (
        parsed.withColumn("reasons", reasons)
        .withColumn("target_work_order_no", strip(target))
        .withColumn("p_due_at", F.try_to_timestamp(given["due_at"]).cast("timestamp_ntz"))
        .drop("_json", "_keys")
    )


def preview(
    commands: DataFrame, orders: DataFrame, projects: DataFrame, as_of: str | datetime, id_pattern: str = UUID_TEXT
) -> DataFrame:
    """Before and after snapshots of valid commands on the orders in scope.

    ``orders`` and ``projects`` are already cut to the caller's scope. Outcome:
    PREVIEW, INVALID, NOT_FOUND or ILLEGAL. A new order starts unassigned at
    version 0, any change raises the version by one.
    """
    now = moment(as_of)
    checked = validate_commands(commands, id_pattern)
    current = orders.select(
        F.col("tenant_id").alias("o_tenant"), F.col("work_order_no").alias("o_no"),
        F.struct(*[c for c in orders.columns if c != "tenant_id"]).alias("before"),
    )
    active = projects.filter(F.col("status") == "ACTIVE").select(
        F.col("tenant_id").alias("j_tenant"), F.col("id").alias("j_id"), F.col("name").alias("j_name")
    )
    action = F.trim(F.col("action_type"))
    joined = checked.join(
        current, (F.col("tenant_id") == F.col("o_tenant")) & (F.col("target_work_order_no") == F.col("o_no")), "left"
    ).join(active, (F.col("tenant_id") == F.col("j_tenant")) & (F.col("p_project_id") == F.col("j_id")), "left")
    creates = action == "CREATE"
    state = state_code(F.col("before.status"), F.col("before.accepted_at").isNotNull())
    moved = next_state(state, action_code(action, F.col("p_reason")))
    frozen = F.col("before.status").isin("CLOSED", "CANCELLED")
    illegal = F.when(action == "UPDATE", frozen).otherwise(~creates & (moved == state))
    outcome = (
        F.when(F.size("reasons") > 0, "INVALID")
        .when(F.when(creates, F.col("j_id").isNull()).otherwise(F.col("o_no").isNull()), "NOT_FOUND")
        .when(illegal, "ILLEGAL")
        .otherwise("PREVIEW")
    )

    def after(name: str, changed: Column, when: Column) -> Column:
        return F.when(when, changed).otherwise(F.col(f"before.{name}")).alias(name)

    updates = action == "UPDATE"

    def updated(name: str) -> Column:
        value = F.when(creates, F.col(f"p_{name}")).otherwise(F.coalesce(f"p_{name}", F.col(f"before.{name}")))
        return F.when(creates | updates, value).otherwise(F.col(f"before.{name}")).alias(name)

    snapshot = F.struct(
        F.when(creates, F.col("p_work_order_no")).otherwise(F.col("o_no")).alias("work_order_no"),
        updated("title"),
        updated("description"),
        after("project_id", F.col("p_project_id"), creates),
        after("project_name", F.col("j_name"), creates),
        after("space_path", F.col("p_space_path"), creates),
        after("order_type", F.col("p_order_type"), creates),
        updated("priority"),
        F.when(creates, "PENDING_DISPATCH").when(updates, F.col("before.status")).otherwise(status_of(moved)).alias("status"),
        after("source", F.col("p_source"), creates),
        after("assignee_id", F.col("p_assignee_id"), action == "ASSIGN"),
        after("assignee_name", F.col("p_assignee_name"), action == "ASSIGN"),
        F.when(creates, F.lit(0)).otherwise(F.col("before.version") + 1).cast("long").alias("version"),
        after("accepted_at", now, action == "ACCEPT"),
        after("created_at", now, creates),
        updated("due_at"),
        after("completed_at", now, action == "COMPLETE"),
        after("cancelled_at", now, action == "CANCEL"),
        after("cancel_reason", F.col("p_reason"), action == "CANCEL"),
    )
    return joined.withColumn("outcome", outcome).select(
        "tenant_id",
        "command_id",
        "action_type",
        "target_work_order_no",
        "outcome",
        lookup(schemas.RISK_LEVELS, action).alias("risk_level"),
        F.when(F.col("outcome") == "PREVIEW", F.when(creates, F.lit(0)).otherwise(F.col("before.version"))).cast("long").alias("expected_version"),
        F.when((F.col("outcome") == "PREVIEW") & ~creates, F.col("before")).alias("before"),
        F.when(F.col("outcome") == "PREVIEW", snapshot).alias("after"),
        F.when(F.col("outcome") == "PREVIEW", plus_minutes(now, F.lit(schemas.PROPOSAL_MINUTES))).alias("expires_at"),
    )
