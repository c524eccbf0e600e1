"""Order events: state replay, log checks, current state and assignment intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.ordering import FAN, SEGMENT, SEGMENT_BITS, by_time, in_segments, scan_maps, with_next, with_previous
from wrenchbook.functions.scalars import lookup
from wrenchbook.functions.text import is_blank

ACTIONS = ("ASSIGN", "ACCEPT", "START", "COMPLETE", "CLOSE", "CANCEL")
# A cancellation without a reason and an unknown action never change the state.
NO_ACTION = len(ACTIONS)
# A state is a status together with the fact whether acceptance was recorded.
STATES = [(status, accepted) for status in schemas.STATUSES for accepted in (False, True)]


def _successor(status: str, accepted: bool, action: str) -> tuple[str, bool]:
    target = schemas.TRANSITIONS.get((status, action))
    if target is None or (action == "ACCEPT" and accepted) or (action == "START" and not accepted):
        return status, accepted
    return target, accepted or action == "ACCEPT"


def transition_table() -> list[int]:
    """Next state for state * (number of actions + 1) + action."""
    table = []
    for state, (status, accepted) in enumerate(STATES):
        table += [STATES.index(_successor(status, accepted, action)) for action in ACTIONS] + [state]
    return table


def final_states() -> frozenset[int]:
    """States that no action leaves."""
    table, width = transition_table(), len(ACTIONS) + 1
    return frozenset(s for s in range(len(STATES)) if set(table[s * width : (s + 1) * width]) == {s})


def next_state(state: Column, action: Column) -> Column:
    table = F.array(*[F.lit(x) for x in transition_table()])
    return F.element_at(table, state * (len(ACTIONS) + 1) + action + 1)


def action_code(action: Column, reason: Column) -> Column:
    code = F.coalesce(lookup({name: at for at, name in enumerate(ACTIONS)}, action), F.lit(NO_ACTION))
    return F.when((action == "CANCEL") & is_blank(reason), NO_ACTION).otherwise(code)


def state_code(status: Column, accepted: Column) -> Column:
    index = lookup({name: at for at, name in enumerate(schemas.STATUSES)}, status)
    return index * 2 + F.when(accepted, 1).otherwise(0)


def status_of(state: Column) -> Column:
    names = F.array(*[F.lit(status) for status, _ in STATES])
    return F.element_at(names, state + 1)


def replay(
    events: DataFrame, grain: str | None = None, initial: DataFrame | None = None, bits: int = SEGMENT_BITS, fan: int = FAN
) -> tuple[DataFrame, DataFrame]:
    """Folds the actions of each order in time order.

    Returns the judged events (``legal``, ``reason``, status before and after)
    and the final state per order. An illegal action does not move the state.

    A fold is sequential, but a state machine with few states can be cut: each
    segment of 2 ** ``bits`` events is folded once from every possible state, the resulting
    maps are composed in a tree, and each segment is then judged from its true
    start. So no task holds more than one segment of one order, however many events
    a day has. An order makes few legal moves, so the list of moves that a fold keeps stays
    short. With ``grain`` the segments are calendar intervals, and nothing is written.

    ``initial`` (tenant_id, work_order_id, status, accepted) gives other start
    states than a new order's.
    """
    keys = ["tenant_id", "work_order_id"]
    cut = in_segments(events, keys, ["occurred_at", "event_id"], bits) if grain is None else events.withColumn(SEGMENT, F.unix_seconds(by_time("occurred_at", grain).cast("timestamp")))
    coded = cut.withColumn("_code", action_code(F.col("action"), F.col("reason")))
    item = F.struct("occurred_at", "event_id", "_code", "action", "reason")
    segments = coded.groupBy(*keys, SEGMENT).agg(F.array_sort(F.collect_list(item)).alias("_items"))

    every_state = F.array(*[F.lit(s) for s in range(len(STATES))])
    effect = F.aggregate(
        "_items", every_state, lambda ends, e: F.transform(ends, lambda s: next_state(s, e["_code"]))
    )
    effects = segments.select(*keys, SEGMENT, effect.alias("effect"))
    orders = segments.select(*keys).distinct()
    if initial is None:
        first = orders.withColumn("state", F.lit(0))
    else:
        given = initial.select(*keys, state_code(F.col("status"), F.col("accepted")).alias("state"))
        first = orders.join(given, keys, "left").withColumn("state", F.coalesce("state", F.lit(0)))
    starts, ends = scan_maps(
        effects, keys, first, every_state, lambda all_, effect: F.transform(all_, lambda s: F.element_at(effect, s + 1)), lambda effect, s: F.element_at(effect, s + 1),
        fan if grain is None else fan * 86_400,
    )
    starts = starts.withColumnRenamed("state", "_start")
    finals = ends.select(*keys, status_of(F.col("state")).alias("status"))

    # Positions and states of the moves inside the segment.
    moves = F.aggregate(
        "_items",
        F.struct(
            F.col("_start").alias("state"), F.lit(0).alias("n"),
            F.expr("CAST(array() AS array<struct<n: int, before: int, after: int>>)").alias("moves"),
        ),
        lambda acc, e: F.struct(
            next_state(acc["state"], e["_code"]).alias("state"),
            (acc["n"] + 1).alias("n"),
            F.when(next_state(acc["state"], e["_code"]) == acc["state"], acc["moves"])
            .otherwise(
                F.concat(
                    acc["moves"],
                    F.array(F.struct(acc["n"].alias("n"), acc["state"].alias("before"), next_state(acc["state"], e["_code"]).alias("after"))),
                )
            )
            .alias("moves"),
        ),
    )
    rows = (
        segments.join(starts, [*keys, SEGMENT])
        .withColumn("_moves", moves["moves"])
        .select(*keys, "_start", "_moves", F.posexplode("_items").alias("_n", "_e"))
    )
    here = F.filter("_moves", lambda m: m["n"] == F.col("_n"))
    earlier = F.filter("_moves", lambda m: m["n"] < F.col("_n"))
    legal = F.size(here) > 0
    before = F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["after"]).otherwise(F.col("_start"))
    judged = rows.select(
        *keys, "_e.event_id", "_e.occurred_at", "_e.action", F.col("_e.reason").alias("cancel_reason"),
        legal.alias("legal"), before.alias("_before"),
        F.when(legal, F.try_element_at(here, F.lit(1))["after"]).otherwise(before).alias("_after"),
    )
    status_before = status_of(F.col("_before"))
    reason = (
        F.when(F.col("legal"), None)
        .when(status_before.isin("CLOSED", "CANCELLED"), "final")
        .when((F.col("action") == "CANCEL"), "cancel_reason")
        .when((F.col("action") == "START") & (status_before == "PENDING_ACCEPTANCE"), "not_accepted")
        .when((F.col("action") == "ACCEPT") & (status_before == "PENDING_ACCEPTANCE"), "accepted_before")
        .otherwise("not_allowed")
    )
    steps = judged.select(
        *keys, "event_id", "occurred_at", "action", "legal", reason.alias("reason"),
        status_before.alias("status_before"), status_of(F.col("_after")).alias("status_after"),
    )
    accepted = steps.filter(F.col("legal") & (F.col("action") == "ACCEPT")).groupBy(*keys).agg(
        F.min("occurred_at").alias("accepted_at")
    )
    return steps, finals.join(accepted, keys, "left")


def audit_events(events: DataFrame, grain: str = "day") -> DataFrame:
    """Checks logged snapshot pairs: status pair, version step and unbroken chain.

    The log has (tenant_id, work_order_id, event_id, created_at, before_status,
    after_status, before_version, after_version).
    """
    keys = ["tenant_id", "work_order_id"]
    chained = with_previous(
        events, keys, ["created_at", "event_id"], ["after_status", "after_version"], by_time("created_at", grain)
    )
    pairs = sorted({(a, b) for (a, _), b in schemas.TRANSITIONS.items()})
    legal = F.concat_ws(">", "before_status", "after_status").isin(*[f"{a}>{b}" for a, b in pairs])
    follows = F.col("previous").isNull() | (
        (F.col("before_status") == F.col("previous.after_status")) & (F.col("before_version") == F.col("previous.after_version"))
    )
    return chained.select(
        *events.columns,
        legal.alias("legal_pair"),
        (F.col("after_version") == F.col("before_version") + 1).alias("version_step"),
        follows.alias("chained"),
    )


def current_state(events: DataFrame, after: Sequence[str] = ("after_status", "after_version")) -> DataFrame:
    """The last after-snapshot per order; combines before the shuffle."""
    last = F.max_by(F.struct(*after), F.struct("created_at", "event_id"))
    return events.groupBy("tenant_id", "work_order_id").agg(last.alias("_last")).select("tenant_id", "work_order_id", "_last.*")


def assignment_intervals(events: DataFrame, grain: str = "day") -> DataFrame:
    """Validity intervals of assignees; naming the same one again changes nothing.

    The last interval of an order is open.
    """
    keys, order = ["tenant_id", "work_order_id"], ["assigned_at", "event_id"]
    seen = with_previous(events, keys, order, ["assignee_id"], by_time("assigned_at", grain))
    changes = seen.filter(
        F.col("previous").isNull() | ~F.col("previous.assignee_id").eqNullSafe(F.col("assignee_id"))
    ).drop("previous")
    ended = with_next(changes, keys, order, ["assigned_at"], by_time("assigned_at", grain))
    return ended.select(
        *keys, "event_id", "assignee_id", "assigned_at", F.col("next.assigned_at").alias("unassigned_at")
    ).filter(F.col("assignee_id").isNotNull())
