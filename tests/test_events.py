"""Jobs, replay, concurrency, idempotency, proposals and commands against brute force."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.ordering import by_time, with_next, with_previous, with_running_sum
from wrenchbook.operators import commands, events, evaluate, jobs

T0 = datetime(2026, 7, 18, 8)
EVENT = "tenant_id string, work_order_id string, event_id long, action string, reason string, occurred_at timestamp_ntz"


def log(spark, *orders):
    rows = []
    for order, actions in orders:
        for n, action in enumerate(actions):
            name, _, reason = action.partition(":")
            rows.append(("t", order, n, name, reason or None, T0 + timedelta(hours=n)))
    return spark.createDataFrame(rows, EVENT)


def brute_replay(rows):
    """(legal flags, final status, acceptance) by following the rules one by one."""
    status, accepted, flags = "PENDING_DISPATCH", None, []
    for action, reason, at in rows:
        target = schemas.TRANSITIONS.get((status, action))
        ok = target is not None
        ok = ok and not (action == "ACCEPT" and accepted is not None)
        ok = ok and not (action == "START" and accepted is None)
        ok = ok and not (action == "CANCEL" and not (reason and reason.strip()))
        flags.append(ok)
        if ok:
            status = target
            accepted = at if action == "ACCEPT" else accepted
    return flags, status, accepted


def judged(spark, df, **options):
    steps, finals = events.replay(df, **options)
    legal = {}
    for r in steps.orderBy("occurred_at", "event_id").collect():
        legal.setdefault(r.work_order_id, []).append(r.legal)
    return legal, {r.work_order_id: (r.status, r.accepted_at) for r in finals.collect()}


def test_replay_cases(spark):
    df = log(
        spark,
        ("long", ["START", "ASSIGN", "START", "ACCEPT", "ACCEPT", "START", "COMPLETE", "CLOSE", "ASSIGN"]),
        ("blank", ["CANCEL", "CANCEL: ", "CANCEL:no longer needed", "ASSIGN"]),
        ("odd", ["DANCE", "ASSIGN", "COMPLETE"]),
    )
    legal, finals = judged(spark, df)
    assert legal["long"] == [False, True, False, True, False, True, True, True, False]
    assert legal["blank"] == [False, False, True, False]
    assert legal["odd"] == [False, True, False]
    assert finals["long"] == ("CLOSED", T0 + timedelta(hours=3))
    assert finals["blank"] == ("CANCELLED", None) and finals["odd"] == ("PENDING_ACCEPTANCE", None)
    reasons = [r.reason for r in events.replay(df)[0].filter("work_order_id = 'long'").orderBy("event_id").collect()]
    assert reasons == ["not_allowed", None, "not_accepted", None, "accepted_before", None, None, None, "final"]


@pytest.mark.parametrize("status", schemas.STATUSES)
@pytest.mark.parametrize("accepted", [False, True])
def test_every_state_and_action(spark, status, accepted):
    df = log(spark, *[(a, [f"{a}:why"]) for a in events.ACTIONS])
    start = df.select("tenant_id", "work_order_id", F.lit(status).alias("status"), F.lit(accepted).alias("accepted"))
    legal, _ = judged(spark, df, initial=start)
    for action in events.ACTIONS:
        expected = (status, action) in schemas.TRANSITIONS
        expected = expected and not (action == "ACCEPT" and accepted) and not (action == "START" and not accepted)
        assert legal[action] == [expected]


@pytest.mark.parametrize("grain", ["minute", "hour", "day", "year"])
def test_replay_of_a_hot_order_does_not_depend_on_segments(spark, grain):
    rng = random.Random(17)
    names = [*events.ACTIONS, "CANCEL"]
    rows, truth = [], {}
    for order, size in (("hot", 600), ("a", 7), ("b", 40), ("c", 1)):
        weights = [1, 1, 1, 1, 1, 0.02, 0.02]
        history = sorted((T0 + timedelta(minutes=rng.randrange(4000)), n) for n in range(size))
        acts = [(rng.choices(names, weights)[0], rng.choice([None, " ", "why"]), at, n) for at, n in history]
        rows += [("t", order, n, a, r, at) for a, r, at, n in acts]
        truth[order] = brute_replay([(a, r, at) for a, r, at, _ in acts])
    rng.shuffle(rows)
    legal, finals = judged(spark, spark.createDataFrame(rows, EVENT), grain=grain)
    for order, (flags, status, accepted) in truth.items():
        assert legal[order] == flags and finals[order] == (status, accepted)


def numbers(spark, size, seed):
    rng = random.Random(seed)
    moments = [T0 + timedelta(minutes=rng.randrange(3000)) for _ in range(size)]
    rows = [("hot" if rng.random() < 0.7 else "cold", m, n, rng.randrange(5)) for n, m in enumerate(moments)]
    return rows, spark.createDataFrame(rows, "k string, at timestamp_ntz, n long, v int")


@pytest.mark.parametrize("grain", ["hour", "year"])
def test_neighbours_and_running_sums(spark, grain):
    rows, df = numbers(spark, 300, 23)
    order, segment = ["at", "n"], by_time("at", grain)
    seen = {r.n: r.previous for r in with_previous(df, ["k"], order, ["v"], segment).collect()}
    ahead = {r.n: r.next for r in with_next(df, ["k"], order, ["v"], segment).collect()}
    total = {r.n: r.total for r in with_running_sum(df, ["k"], order, F.col("v"), "total", segment).collect()}
    for key in ("hot", "cold"):
        mine = sorted((at, n, v) for k, at, n, v in rows if k == key)
        for at, (_, n, _) in enumerate(mine):
            assert (seen[n].v if seen[n] else None) == (mine[at - 1][2] if at else None)
            assert (ahead[n].v if ahead[n] else None) == (mine[at + 1][2] if at + 1 < len(mine) else None)
            assert total[n] == sum(v for _, _, v in mine[: at + 1])


@pytest.mark.parametrize("grain", ["hour", "year"])
def test_commands_against_brute_force(spark, grain):
    rng = random.Random(29)
    rows, targets = [], []
    for target, size, version in (("hot", 500, 3), ("cold", 20, 0), ("none", 0, 7)):
        targets.append(("t", target, version))
        rows += [("t", target, f"{target}{n}", rng.randrange(3, 60) if target == "hot" else rng.randrange(4), T0 + timedelta(minutes=rng.randrange(4000))) for n in range(size)]
    batch = spark.createDataFrame(rows, "tenant_id string, target_id string, command_id string, expected_version long, arrived_at timestamp_ntz")
    applied, finals = commands.apply_commands(spark.createDataFrame(targets, "tenant_id string, id string, version long"), batch, grain)
    got = {r.command_id: r.applied for r in applied.collect()}
    ends = {r.target_id: r.version for r in finals.collect()}
    for _, target, version in targets[:2]:
        for _, _, name, expected, _ in sorted((r for r in rows if r[1] == target), key=lambda r: (r[4], r[2])):
            assert got[name] == (expected == version)
            version += expected == version
        assert ends[target] == version


def test_second_command_on_a_version_conflicts(spark):
    batch = spark.createDataFrame([("t", "o", "a", 3, T0), ("t", "o", "b", 3, T0 + timedelta(minutes=1))], "tenant_id string, target_id string, command_id string, expected_version long, arrived_at timestamp_ntz")
    applied, finals = commands.apply_commands(spark.createDataFrame([("t", "o", 3)], "tenant_id string, id string, version long"), batch)
    assert {r.command_id: r.applied for r in applied.collect()} == {"a": True, "b": False}
    assert finals.first().version == 4


def test_command_on_an_unknown_target_stays(spark):
    batch = spark.createDataFrame([("t", "o", "a", 3, T0), ("t", "o", "b", 9, T0), ("t", "lost", "c", 0, T0)], "tenant_id string, target_id string, command_id string, expected_version long, arrived_at timestamp_ntz")
    judged, finals = commands.apply_commands(spark.createDataFrame([("t", "o", 3)], "tenant_id string, id string, version long"), batch)
    assert {r.command_id: (r.applied, r.outcome) for r in judged.collect()} == {"a": (True, "APPLIED"), "b": (False, "CONFLICT"), "c": (False, "NOT_FOUND")}
    assert [(r.target_id, r.version) for r in finals.collect()] == [("o", 4)]


def test_log_checks(spark):
    rows = [
        ("t", "o", 1, T0, "PENDING_DISPATCH", "PENDING_ACCEPTANCE", 0, 1),
        ("t", "o", 2, T0 + timedelta(days=2), "PENDING_ACCEPTANCE", "PROCESSING", 1, 2),
        ("t", "o", 3, T0 + timedelta(days=2), "PROCESSING", "CLOSED", 3, 4),
        ("t", "o", 4, T0 + timedelta(days=9), "CLOSED", "CLOSED", 4, 4),
    ]
    df = spark.createDataFrame(rows, "tenant_id string, work_order_id string, event_id long, created_at timestamp_ntz, before_status string, after_status string, before_version long, after_version long")
    got = [(r.legal_pair, r.version_step, r.chained) for r in events.audit_events(df).orderBy("event_id").collect()]
    assert got == [(True, True, True), (True, True, True), (False, True, False), (False, False, True)]
    assert tuple(events.current_state(df).first())[2:] == ("CLOSED", 4)


def test_assignment_intervals(spark):
    hours = lambda n: T0 + timedelta(hours=n)
    rows = [("t", "o", n, who, hours(20 * n)) for n, who in enumerate(["a", "a", "b", "b", "a", None, "c"])]
    df = spark.createDataFrame(rows, "tenant_id string, work_order_id string, event_id long, assignee_id string, assigned_at timestamp_ntz")
    got = [(r.assignee_id, r.assigned_at, r.unassigned_at) for r in events.assignment_intervals(df).orderBy("assigned_at").collect()]
    assert got == [("a", hours(0), hours(40)), ("b", hours(40), hours(80)), ("a", hours(80), hours(100)), ("c", hours(120), None)]


def test_request_classes(spark):
    rows = [("t", "op", "k", "h1", 1), ("t", "op", "k", "h1", 2), ("t", "op", "k", "h2", 3), ("u", "op", "k", "h2", 4), ("t", "other", "k", "h1", 5)]
    df = spark.createDataFrame([(*r, T0 + timedelta(minutes=r[4])) for r in rows], "tenant_id string, operation string, key string, request_hash string, request_id long, arrived_at timestamp_ntz")
    got = [r.outcome for r in commands.classify_requests(df).orderBy("request_id").collect()]
    assert got == ["EXECUTE", "REPLAY", "CONFLICT", "EXECUTE", "EXECUTE"]


JOB = "tenant_id string, id string, status string, priority int, retry_count int, max_retry_count int, next_retry_at timestamp_ntz, started_at timestamp_ntz, created_at timestamp_ntz"


def test_claims(spark):
    rows = [
        ("t", "late", "PENDING", 1, 0, 3, None, None, T0),
        ("t", "first", "PENDING", 0, 0, 3, None, None, T0),
        ("t", "due", "RETRY_WAIT", 0, 1, 3, T0, None, T0 - timedelta(hours=1)),
        ("t", "early", "RETRY_WAIT", 0, 1, 3, T0 + timedelta(microseconds=1), None, T0),
        ("t", "spent", "RETRY_WAIT", 0, 3, 3, T0, None, T0),
        ("t", "running", "RUNNING", 0, 1, 3, None, T0, T0),
        ("u", "other", "PENDING", 9, 0, 3, None, None, T0),
    ]
    df = spark.createDataFrame(rows, JOB)
    got = jobs.claimable(df, str(T0), 2).orderBy("tenant_id", "position").collect()
    assert [(r.tenant_id, r.id) for r in got] == [("t", "due"), ("t", "first"), ("u", "other")]
    with pytest.raises(ValueError):
        jobs.claimable(df, str(T0), 21)


def test_leases(spark):
    edge = T0 - timedelta(minutes=15)
    rows = [
        ("t", "ended", "RUNNING", 0, 1, 3, None, edge, T0), ("t", "alive", "RUNNING", 0, 1, 3, None, edge + timedelta(microseconds=1), T0),
        ("t", "spent", "RUNNING", 0, 3, 3, None, edge, T0), ("t", "waiting", "RETRY_WAIT", 0, 1, 3, T0, None, T0),
    ]
    got = {r.id: (r.status, r.next_retry_at) for r in jobs.recover_leases(spark.createDataFrame(rows, JOB), str(T0)).collect()}
    assert got == {"ended": ("RETRY_WAIT", T0), "alive": ("RUNNING", None), "spent": ("FAILED", None), "waiting": ("RETRY_WAIT", T0)}


def test_leases_keep_other_error_codes(spark):
    rows = [("t", "ended", "RUNNING", 0, 1, 3, None, T0 - timedelta(hours=1), T0, "OLD"), ("t", "done", "FAILED", 0, 3, 3, None, None, T0, "OLD")]
    got = {r.id: r.error_code for r in jobs.recover_leases(spark.createDataFrame(rows, JOB + ", error_code string"), str(T0)).collect()}
    assert got == {"ended": jobs.LEASE_EXPIRED, "done": "OLD"}


def test_first_outcome_of_an_attempt_counts(spark):
    df = spark.createDataFrame([("t", "j", "RUNNING", 0, 1, 3, None, T0, T0)], JOB)
    reported = spark.createDataFrame(
        [("t", "j", 1, "FATAL", None, T0 + timedelta(minutes=1)), ("t", "j", 1, "OK", "PASS", T0)],
        "tenant_id string, job_id string, attempt int, outcome string, verdict string, finished_at timestamp_ntz",
    )
    assert [r.status for r in jobs.next_job_state(df, reported).collect()] == ["SUCCEEDED"]


def test_retry_delays(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 6, 80)], "n int")
    assert [r[0] for r in df.select(jobs.retry_delay(F.col("n"))).collect()] == [None, 5, 10, 20, 40, 60, 60, 60]


@pytest.mark.parametrize(
    "outcome,attempt,verdict,status",
    [
        ("OK", 1, "PASS", "SUCCEEDED"), ("OK", 3, "SKIP", "SKIPPED"), ("RETRYABLE", 2, None, "RETRY_WAIT"), ("RETRYABLE", 3, None, "FAILED"),
        ("FATAL", 1, None, "FAILED"), ("OUTPUT_INVALID", 1, None, "FAILED"), ("INPUT_INVALID", 1, None, "FAILED"), ("UNKNOWN", 1, None, "RUNNING"),
    ],
)
def test_next_states(spark, outcome, attempt, verdict, status):
    df = spark.createDataFrame([("t", "j", "RUNNING", 0, attempt, 3, None, T0, T0)], JOB)
    reported = spark.createDataFrame(
        [("t", "j", attempt, outcome, verdict, T0), ("t", "j", attempt + 1, "FATAL", None, T0)],
        "tenant_id string, job_id string, attempt int, outcome string, verdict string, finished_at timestamp_ntz",
    )
    row = jobs.next_job_state(df, reported).first()
    assert row.status == status
    assert row.next_retry_at == (T0 + timedelta(minutes=10) if status == "RETRY_WAIT" else None)


def test_intake_is_idempotent(spark):
    rows = [("t", "o", 3, 1, n, T0 + timedelta(minutes=-n)) for n in range(3)] + [("t", "o", 3, 2, 9, T0)]
    df = spark.createDataFrame(rows, "tenant_id string, work_order_id string, work_order_version long, inspection_round int, event_id long, occurred_at timestamp_ntz")
    first = jobs.intake(df)
    assert {(r.inspection_round, r.event_id) for r in first.collect()} == {(1, 2), (2, 9)}
    assert jobs.intake(df, first).count() == 0


def test_outbox_leftover(spark):
    rows = [("t", "a", "PENDING", 1), ("t", "b", "PENDING", 0), ("t", "c", "PENDING", 1), ("t", "d", "PUBLISHED", 1), ("u", "a", "PENDING", 2)]
    outbox = spark.createDataFrame(rows, "tenant_id string, event_id string, status string, attempts int").withColumn("event_type", F.lit("WORK_ORDER_COMPLETED"))
    acks = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "a")], "tenant_id string, event_id string")
    assert sorted((r.tenant_id, r.event_id) for r in jobs.pending_outbox(outbox, acks).collect()) == [("t", "b"), ("t", "c"), ("u", "a")]


PROPOSAL = "tenant_id string, id string, action_type string, status string, assignee_id string, confirmed_by string, created_at timestamp_ntz"


def test_proposal_times(spark):
    rows = [("t", "p1", "ASSIGN", "PENDING_CONFIRMATION", "a", None, T0), ("t", "p2", "CREATE_RECTIFICATION", "CONFIRMED", "a", None, T0), ("t", "p3", "CLOSE", "EXECUTED", "a", None, T0)]
    df = spark.createDataFrame(rows, PROPOSAL)
    at = lambda minutes: {r.id: (r.status, r.risk_level) for r in commands.proposal_status(df, str(T0 + timedelta(minutes=minutes))).collect()}
    assert at(14) == {"p1": ("PENDING_CONFIRMATION", "MEDIUM"), "p2": ("CONFIRMED", "CRITICAL"), "p3": ("EXECUTED", "HIGH")}
    assert at(15)["p1"][0] == "EXPIRED" and at(15)["p2"][0] == "CONFIRMED"
    assert at(24 * 60)["p2"][0] == "EXPIRED" and at(24 * 60)["p3"][0] == "EXECUTED"


GRANTS = [("t", "disp", "DISPATCHER"), ("t", "op", "OPERATOR"), ("t", "qr", "QUALITY_REVIEWER"), ("t", "bot", "AI_SERVICE"), ("t", "bot", "DISPATCHER")]


def test_rights(spark):
    grants = spark.createDataFrame(GRANTS, "tenant_id string, actor_id string, role string")
    rows = [
        ("disp", "ASSIGN", "x", True, True), ("disp", "ACCEPT", "disp", False, False), ("op", "ACCEPT", "op", True, True), ("op", "START", "x", False, False),
        ("qr", "CLOSE", "x", True, True), ("qr", "CREATE_RECTIFICATION", "x", True, True), ("bot", "COMPLETE", "x", True, False), ("bot", "ASSIGN", "x", True, False),
        ("nobody", "ASSIGN", "x", False, False),
    ]
    df = spark.createDataFrame([("t", *r) for r in rows], "tenant_id string, actor_id string, action_type string, assignee_id string, propose boolean, confirm boolean")
    wrong = commands.authorize(df, grants).filter("may_propose <> propose OR may_confirm <> confirm")
    assert wrong.count() == 0


def test_decisions(spark):
    grants = spark.createDataFrame(GRANTS, "tenant_id string, actor_id string, role string")
    rows = [
        ("t", "p1", "ASSIGN", "PENDING_CONFIRMATION", "x", None, T0), ("t", "p2", "ASSIGN", "CONFIRMED", "x", "disp", T0),
        ("t", "p3", "ASSIGN", "EXECUTED", "x", None, T0), ("t", "p4", "ASSIGN", "CONFIRMED", "x", "someone", T0), ("t", "p5", "ASSIGN", "PENDING_CONFIRMATION", "x", None, T0),
    ]
    minutes = lambda n: T0 + timedelta(minutes=n)
    asked = [
        ("a", "p1", "MAYBE", "disp", 1, "INVALID"), ("b", "p1", "CONFIRM", "op", 2, "FORBIDDEN"), ("c", "p1", "REJECT", "disp", 3, "REJECTED"),
        ("d", "p1", "CONFIRM", "disp", 4, "LATE"), ("e", "p2", "REJECT", "disp", 1, "INELIGIBLE"), ("f", "p2", "CONFIRM", "disp", 2, "CLAIMED"),
        ("g", "p3", "CONFIRM", "disp", 1, "INELIGIBLE"), ("h", "p4", "CONFIRM", "disp", 1, "INELIGIBLE"), ("i", "p5", "CONFIRM", "disp", 15, "EXPIRED"),
        ("j", "p5", "CONFIRM", "bot", 1, "FORBIDDEN"), ("k", "p9", "CONFIRM", "disp", 1, "NOT_FOUND"), ("l", "p5", "REJECT", "op", 20, "FORBIDDEN"),
        ("m", "p5", "CONFIRM", "op", 20, "EXPIRED"),
    ]
    decisions = spark.createDataFrame([("t", p, i, d, a, minutes(m)) for i, p, d, a, m, _ in asked], "tenant_id string, proposal_id string, decision_id string, decision string, actor_id string, decided_at timestamp_ntz")
    got = {r.decision_id: r.outcome for r in commands.decide(spark.createDataFrame(rows, PROPOSAL), decisions, grants).collect()}
    assert got == {a[0]: a[5] for a in asked}


ID = "00000000-0000-0000-0000-00000000000a"
CREATE = {"work_order_no": "N", "title": "T", "description": "D", "project_id": ID, "space_path": "S", "order_type": "O", "priority": "P", "source": "M", "due_at": "2026-07-20T08:00"}


@pytest.mark.parametrize(
    "action,target,parameters,reasons",
    [
        ("CREATE", None, CREATE, []),
        ("CREATE", "WO-1", CREATE, ["target"]),
        ("CREATE", None, {**CREATE, "title": " "}, ["text"]),
        ("CREATE", None, {**CREATE, "title": 5}, ["text"]),
        ("CREATE", None, {k: v for k, v in CREATE.items() if k != "source"}, ["missing_field"]),
        ("CREATE", None, {**CREATE, "project_id": "p"}, ["id"]),
        ("CREATE", None, {**CREATE, "due_at": "tomorrow"}, ["time"]),
        ("CREATE", None, {**CREATE, "status": "CLOSED"}, ["unknown_field"]),
        (" ASSIGN ", "WO-1", {"assignee_id": ID, "assignee_name": "N", "reason": "r"}, []),
        ("UPDATE", "WO-1", {"title": "x"}, []),
        ("UPDATE", "WO-1", {"title": None}, ["no_change"]),
        ("UPDATE", " ", {"title": "x"}, ["target"]),
        ("CANCEL", "WO-1", {}, ["missing_field"]),
        ("CLOSE", "WO-1", {}, []),
        ("CLOSE", "WO-1", {"force": True}, ["unknown_field"]),
        ("DANCE", "WO-1", {}, ["action"]),
    ],
)
def test_command_rules(spark, action, target, parameters, reasons):
    df = spark.createDataFrame([(action, target, json.dumps(parameters))], "action_type string, target_work_order_no string, parameters string")
    assert commands.validate_commands(df).first().reasons == reasons


@pytest.mark.parametrize("parameters", ["[1]", "{broken", "5", None])
def test_parameters_must_be_an_object(spark, parameters):
    df = spark.createDataFrame([("CLOSE", "WO-1", parameters)], "action_type string, target_work_order_no string, parameters string")
    assert "parameters" in commands.validate_commands(df).first().reasons


def test_previews(spark):
    columns = [f for f in schemas.WORK_ORDER.fieldNames()]
    base = dict.fromkeys(columns) | {"tenant_id": "t", "id": "o1", "work_order_no": "WO-1", "title": "Old", "status": "PENDING_ACCEPTANCE", "priority": "LOW", "version": 4, "project_id": ID}
    orders = spark.createDataFrame([tuple(base[c] for c in columns)], schemas.WORK_ORDER)
    projects = spark.createDataFrame([("t", ID, "Tower", "ACTIVE")], "tenant_id string, id string, name string, status string")
    asked = [
        ("accept", "ACCEPT", "WO-1", {}), ("start", "START", "WO-1", {}), ("update", "UPDATE", "WO-1", {"title": " New ", "due_at": "2026-07-20T08:00:00"}),
        ("cancel", "CANCEL", "WO-1", {"reason": " why "}), ("missing", "CLOSE", "WO-9", {}), ("create", "CREATE", None, CREATE), ("bad", "CANCEL", "WO-1", {}),
    ]
    df = spark.createDataFrame([("t", n, a, t, json.dumps(p)) for n, a, t, p in asked], "tenant_id string, command_id string, action_type string, target_work_order_no string, parameters string")
    got = {r.command_id: r for r in commands.preview(df, orders, projects, str(T0)).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        "accept": "PREVIEW", "start": "ILLEGAL", "update": "PREVIEW", "cancel": "PREVIEW", "missing": "NOT_FOUND", "create": "PREVIEW", "bad": "INVALID",
    }
    assert (got["accept"].after.status, got["accept"].after.accepted_at, got["accept"].after.version, got["accept"].expected_version) == ("PENDING_ACCEPTANCE", T0, 5, 4)
    assert (got["update"].after.title, got["update"].after.priority, got["update"].after.status) == ("New", "LOW", "PENDING_ACCEPTANCE")
    assert (got["cancel"].after.status, got["cancel"].after.cancel_reason, got["cancel"].after.cancelled_at) == ("CANCELLED", "why", T0)
    made = got["create"].after
    assert (made.status, made.version, made.project_name, made.created_at, got["create"].before) == ("PENDING_DISPATCH", 0, "Tower", T0, None)
    assert got["accept"].expires_at == T0 + timedelta(minutes=15)


def test_reconciliation(spark):
    orders = spark.createDataFrame([("t", "ok", 2), ("t", "short", 2), ("t", "quiet", 0)], "tenant_id string, id string, version long")
    rows = [("t", "ok"), ("t", "ok"), ("t", "short"), ("t", "ghost")]
    log_rows = spark.createDataFrame(rows, "tenant_id string, work_order_id string")
    wrong = evaluate.reconcile(orders, log_rows, log_rows.withColumnRenamed("work_order_id", "aggregate_id"), log_rows.withColumnRenamed("work_order_id", "target_id"))
    assert {r.work_order_id: (r.orders, r.version, r.events) for r in wrong.collect()} == {"short": (1, 2, 1), "ghost": (0, 0, 1)}
