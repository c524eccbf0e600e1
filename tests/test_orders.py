"""Seeded orders, scope, search, chains, routing, views, specs and screening on small fixtures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.operators import catalog, governed, orders, scope, screening, views
from wrenchbook.operators.governed import Condition, Field, Measure, Spec
from wrenchbook.sources import audit, loading

PROJECTS = ("星河中心", "云帆园区", "海棠公寓")


@pytest.fixture(scope="module")
def seed(spark):
    """The fifty seeded orders, by rule, over two tenants."""
    n = F.col("n")
    cycle = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), ((n - 1) % by + 1).cast("int"))
    number = lambda c: F.concat(F.lit("WO-20260718-"), F.lpad(c.cast("string"), 3, "0"))
    rework = n.isin(8, 18, 28, 38, 48)
    base = spark.range(1, 51).withColumnRenamed("id", "n").select(
        F.when(n <= 25, "A").otherwise("B").alias("tenant_id"),
        F.concat(F.lit("o"), n.cast("string")).alias("id"),
        number(n).alias("work_order_no"),
        F.concat(F.lit("Job "), n.cast("string")).alias("title"),
        F.lit("synthetic").alias("description"),
        cycle(("p0", "p1", "p2"), 3).alias("project_id"),
        cycle(PROJECTS, 3).alias("project_name"),
        F.lit("somewhere").alias("space_path"),
        F.when(rework, "REWORK").when(n % 7 == 0, "EMERGENCY").otherwise("STANDARD").alias("order_type"),
        F.when(n % 10 == 0, "URGENT").when(n % 3 == 0, "HIGH").when(n % 3 == 1, "MEDIUM").otherwise("LOW").alias("priority"),
        cycle(schemas.STATUSES, 5).alias("status"),
        F.lit("s1").alias("assignee_id"),
        cycle(("林晓", "周明", "陈安", "赵宁", "许晨"), 5).alias("assignee_name"),
        cycle(("PLAN", "MANUAL", "INSPECTION"), 3).alias("source"),
        F.when(rework, F.concat(F.lit("o"), (n - 1).cast("string"))).alias("root_work_order_id"),
        F.when(rework, number(n - 1)).alias("root_work_order_no"),
        F.lit(None).cast("string").alias("rework_reason"),
        F.lit(0).cast("long").alias("version"),
        F.lit(None).cast("timestamp_ntz").alias("accepted_at"),
        (F.lit("2026-07-18 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(n * 20).cast("int"))).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("cancelled_at"),
        F.lit(None).cast("string").alias("cancel_reason"),
    )
    return loading.with_sla(base).select(*schemas.WORK_ORDER.names).cache()


def grants(spark, *pairs):
    return spark.createDataFrame(list(pairs), "tenant_id string, project_id string")


def counts(df, column):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_seed_figures(spark, seed):
    assert seed.schema.simpleString() == schemas.WORK_ORDER.simpleString()
    assert counts(seed, "status") == {s: 10 for s in schemas.STATUSES if s != "CANCELLED"}
    assert counts(seed, "priority") == {"HIGH": 15, "LOW": 15, "MEDIUM": 15, "URGENT": 5}
    assert counts(seed, "order_type") == {"EMERGENCY": 6, "REWORK": 5, "STANDARD": 39}
    assert counts(seed, "project_name") == dict(zip(PROJECTS, (17, 17, 16)))


def test_view_figures(seed):
    view = views.work_order_v(seed, "2026-07-19 12:00:00")
    hours = [r[0] for r in view.select("completion_hours").collect()]
    assert hours.count(1.5) == 20 and hours.count(None) == 30
    late = sorted(int(r[0][-3:]) for r in view.filter("is_overdue").select("work_order_no").collect())
    assert late == [1, 3, 6, 7, 12, 18, 21, 27, 33, 36, 42, 48]
    assert catalog.schema_mismatches(catalog.WORK_ORDER_VIEW, view) == []


def test_view_reads_only_its_columns(tables):
    plan = views.work_order_v(tables["order_fact"], "1998-06-15").select("status")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_acctbal" not in plan and "c_mktsegment" not in plan


def test_chain_scope(spark, seed):
    request = spark.createDataFrame([("r", "A", "WO-20260718-008")], "request_id string, tenant_id string, work_order_no string")
    everywhere = grants(spark, ("A", "p0"), ("A", "p1"), ("A", "p2"))
    rows = orders.rework_chain(request, seed, everywhere).orderBy("created_at").collect()
    assert [r.member_no[-3:] for r in rows] == ["007", "008"]
    assert orders.rework_chain(request, seed, grants(spark, ("A", "p1"))).count() == 0
    other_tenant = grants(spark, ("B", "p0"), ("B", "p1"))
    assert orders.rework_chain(request, seed, other_tenant).count() == 0


def test_lookup_hides_what_is_out_of_scope(spark, seed):
    asked = spark.createDataFrame(
        [("a", "A", "WO-20260718-001"), ("b", "A", "WO-20260718-002"), ("c", "A", "WO-20260718-030")],
        "request_id string, tenant_id string, work_order_no string",
    )
    got = {r.request_id: r.outcome for r in orders.lookup(asked, seed, grants(spark, ("A", "p0"))).collect()}
    assert got == {"a": "FOUND", "b": "NOT_FOUND", "c": "NOT_FOUND"}


def test_search_pages(spark, seed):
    all_a = grants(spark, *[("A", p) for p in ("p0", "p1", "p2")])
    page = orders.search(seed, all_a, orders.SearchCriteria(status="COMPLETED", priority=" "), page=0, size=3)
    assert page.summary.first().asDict() == {"total": 5, "page": 0, "size": 3, "total_pages": 2}
    assert [r.work_order_no[-3:] for r in page.items.collect()] == ["024", "019", "014"]
    rest = orders.search(seed, all_a, orders.SearchCriteria(status="COMPLETED"), page=1, size=3)
    assert [r.work_order_no[-3:] for r in rest.items.collect()] == ["009", "004"]
    bounds = orders.SearchCriteria(created_from=datetime(2026, 7, 18, 8, 20), created_to=datetime(2026, 7, 18, 9, 0))
    assert orders.matching(seed, all_a, bounds).count() == 3
    none = orders.search(seed, all_a.limit(0))
    assert none.items.count() == 0 and none.summary.first()["total"] == 0 and none.summary.first()["total_pages"] == 0
    with pytest.raises(ValueError):
        orders.search(seed, all_a, size=101)


def test_missing_tenant_sees_nothing(seed):
    assert scope.scope_tenant(seed, "A").count() == 25
    assert scope.scope_tenant(seed, None).count() == scope.scope_tenant(seed, "  ").count() == 0


def test_entitlements(spark):
    users = spark.createDataFrame(
        [("u1", "i", "s1", "ACTIVE"), ("u2", "i", "s2", "ACTIVE"), ("u3", "i", "s2", "ACTIVE"), ("u4", "other", "s1", "ACTIVE")],
        "id string, issuer string, subject string, status string",
    )
    tenants = spark.createDataFrame([("A", "ACTIVE"), ("B", "INACTIVE")], "id string, status string")
    members = spark.createDataFrame(
        [("A", "u1", "OPERATOR", "ACTIVE"), ("A", "u1", "DISPATCHER", "INACTIVE"), ("B", "u1", "OPERATOR", "ACTIVE"), ("A", "u2", "OPERATOR", "ACTIVE")],
        "tenant_id string, user_identity_id string, role string, status string",
    )
    projects = spark.createDataFrame([("A", "p", "ACTIVE"), ("A", "q", "INACTIVE")], "tenant_id string, id string, status string")
    granted = spark.createDataFrame(
        [("A", "u1", "p", "ACTIVE"), ("A", "u1", "q", "ACTIVE"), ("B", "u1", "p", "ACTIVE")],
        "tenant_id string, user_identity_id string, project_id string, status string",
    )
    roles = scope.effective_roles(members, users, tenants, "i")
    allowed = scope.effective_projects(granted, users, tenants, projects, "i")
    assert {tuple(r) for r in roles.collect()} == {("A", "s1", "OPERATOR"), ("A", "s2", "OPERATOR")}
    assert {tuple(r) for r in allowed.collect()} == {("A", "s1", "p")}
    claims = spark.createDataFrame(
        [("s1", "A", ["OPERATOR", "DISPATCHER"], ["p", "q", "z"]), ("s2", "A", ["OPERATOR"], []), ("s9", "A", ["OPERATOR"], [])],
        "subject string, tenant_id string, roles array<string>, project_ids array<string>",
    )
    got = {r.subject: r for r in scope.effective_context(claims, users, roles, allowed, "i").collect()}
    assert (got["s1"].outcome, got["s1"].roles, got["s1"].project_ids) == ("ACCEPTED", ["OPERATOR"], ["p"])
    # Two active identities, and none at all.
    assert got["s2"].outcome == got["s9"].outcome == "REJECTED" and got["s2"].roles == []


@pytest.mark.parametrize(
    "message,route,number",
    [
        ("工单创建时必须包含哪些信息？", "knowledge", None),
        ("查询 wo-20260718-008", "work_order", "WO-20260718-008"),
        ("WO-20260718-008 为什么返工", "combined", "WO-20260718-008"),
        ("列出处理中的工单", "work_order", None),
        ("列出菜单", "knowledge", None),
        ("有哪些紧急工单", "work_order", None),
    ],
)
def test_routes(spark, message, route, number):
    row = orders.extract_filters(spark.createDataFrame([(message,)], "message string")).first()
    assert (row.route, row.work_order_no) == (route, number)


def test_slots_take_the_first_word_in_list_order(spark):
    row = orders.extract_filters(spark.createDataFrame([("查一下 海棠公寓 已关闭 处理中 高优先级 张小三的工单",)], "message string")).first()
    assert (row.status_filter, row.priority_filter, row.project_filter, row.assignee_filter) == ("PROCESSING", "HIGH", "海棠公寓", "张小三")


def test_event_names(spark):
    df = spark.createDataFrame([(a,) for a in (*schemas.EVENT_TYPES, "NONE")], "action string")
    got = {r.action: r.e for r in df.select("action", orders.event_type(F.col("action")).alias("e")).collect()}
    assert got == {**schemas.EVENT_TYPES, "NONE": None}


def test_catalog(spark):
    assert sum(len(c) for c in catalog.VIEWS.values()) == 53 == catalog.catalog_df(spark).count()
    assert catalog.resolve(catalog.WORK_ORDER_VIEW, "逾期").name == "is_overdue"
    assert catalog.join_path(catalog.WORK_ORDER_VIEW, catalog.QUALITY_VIEW).how == "left"
    with pytest.raises(catalog.CatalogError):
        catalog.join_path(catalog.QUALITY_VIEW, catalog.RECTIFICATION_VIEW)


def run(spark, seed, spec):
    all_views = {catalog.WORK_ORDER_VIEW: lambda columns: views.work_order_v(seed, "2026-07-19 12:00:00")}
    return governed.run_spec(spec, all_views, grants(spark, ("A", "p0"), ("A", "p1")))


def test_spec_runs_in_scope(spark, seed):
    spec = Spec(catalog.WORK_ORDER_VIEW, group_by=(Field("status"),), measures=(Measure("COUNT", "n"),), order_by=(("n", True), ("status", False)))
    assert sum(r.n for r in run(spark, seed, spec).collect()) == 17


@pytest.mark.parametrize(
    "spec",
    [
        Spec("work_order", select=(Field("id"),)),
        Spec(catalog.WORK_ORDER_VIEW, select=(Field("description"),)),
        Spec(catalog.WORK_ORDER_VIEW, select=(Field("status", "PG_SLEEP"),)),
        Spec(catalog.WORK_ORDER_VIEW, select=(Field("created_at", "UPPER"),)),
        Spec(catalog.WORK_ORDER_VIEW, select=(Field("status"),), where=(Condition(Field("tenant_id"), "=", "B"),)),
        Spec(catalog.WORK_ORDER_VIEW, select=(Field("status"),), where=(Condition(Field("status"), "~", "x"),)),
        Spec(catalog.WORK_ORDER_VIEW, group_by=(Field("id"),)),
        Spec(catalog.WORK_ORDER_VIEW, measures=(Measure("SUM", "s", Field("status")),)),
        Spec(catalog.WORK_ORDER_VIEW, select=(Field("verdict", joined=True),)),
        Spec(catalog.WORK_ORDER_VIEW, select=(Field("status"),), order_by=(("priority", False),)),
        Spec(catalog.WORK_ORDER_VIEW),
    ],
)
def test_spec_refuses(spark, seed, spec):
    with pytest.raises(catalog.CatalogError):
        run(spark, seed, spec)


@pytest.mark.parametrize("rows,limit,kept,truncated", [(200, 200, 200, False), (201, 200, 200, True), (300, 250, 250, True), (300, 500, 300, False), (5, 3, 3, True), (3, 3, 3, False)])
def test_guard_rows(spark, rows, limit, kept, truncated):
    got = governed.guard(spark.range(rows), [F.col("id")], limit=limit).collect()
    assert len(got) == kept and {r.truncated for r in got} == {truncated}


def test_guard_bytes_and_columns(spark):
    wide = spark.createDataFrame([(1, "x" * 10, None), (2, "y" * 10, "z")], "n int, a string, b string")
    got = governed.guard(wide, [F.col("n")], max_bytes=2 * (1 + 10 + 4)).collect()
    assert [r.n for r in got] == [1] and got[0].truncated
    narrow = governed.guard(wide, [F.col("n")], max_columns=1)
    assert narrow.columns == ["n", "truncated"] and {r.truncated for r in narrow.collect()} == {True}
    assert governed.guard(wide, [F.col("n")], max_columns=None, max_bytes=None).columns == ["n", "a", "b", "truncated"]


def test_spec_limits(spark, seed):
    def orders(limit):
        return run(spark, seed, Spec(catalog.WORK_ORDER_VIEW, select=(Field("status"), Field("work_order_no")), order_by=(("status", False),), limit=limit))

    every = orders(None)
    assert "truncated" not in every.columns
    rows = sorted((r.status, r.work_order_no) for r in every.collect())
    got = orders(4).collect()
    assert [(r.status, r.work_order_no) for r in got] == rows[:4] and {r.truncated for r in got} == {True}
    assert {r.truncated for r in orders(len(rows)).collect()} == {False}


ATTACKS = (
    "INSERT INTO work_order (status) VALUES ('HACKED')",
    "UPDATE work_order SET status = 'CLOSED'",
    "DELETE FROM work_order",
    "TRUNCATE TABLE work_order",
    "DROP TABLE work_order",
    "CREATE TABLE evil (id int)",
    "ALTER TABLE work_order ADD COLUMN evil text",
    "SELECT * FROM pg_catalog.pg_class",
    "SELECT * FROM information_schema.tables",
    "SELECT * FROM pg_stat_activity",
    "SELECT pg_sleep(30) FROM analytics_work_order_v",
    "SELECT lo_import('/etc/passwd') FROM analytics_work_order_v",
    "SELECT 1; DROP TABLE work_order",
    "SELECT 1 -- comment",
    "SELECT 1 /* two\nlines */",
    "SELECT work_order_no FROM analytics_work_order_v UNION ALL SELECT password FROM pg_user",
    "WITH RECURSIVE r AS (SELECT 1 UNION ALL SELECT n+1 FROM r WHERE n < 9) SELECT * FROM r",
    "COPY analytics_work_order_v TO '/tmp/dump.csv'",
    "SELECT current_setting('app.tenant_id')",
    "SELECT * FROM analytics_work_order_v, pg_user",
    "SELECT * FROM analytics_work_order_v a, secrets b",
    "SELECT * FROM analytics_work_order_v WHERE id IN (SELECT id FROM work_order)",
    "WITH x AS (SELECT 1) SELECT * FROM x",
)
LEGAL = (
    "SELECT work_order_no, status FROM analytics_work_order_v",
    "SELECT status, COUNT(*) FROM analytics_work_order_v GROUP BY status",
    "SELECT w.work_order_no, q.verdict FROM analytics_work_order_v w LEFT JOIN analytics_quality_v q ON w.tenant_id = q.tenant_id",
    "SELECT DATE_TRUNC('month', created_at) AS month, COUNT(*) FROM analytics_work_order_v GROUP BY month ORDER BY month",
    "SELECT EXTRACT(YEAR FROM created_at) FROM analytics_work_order_v",
    "SELECT status FROM public.analytics_work_order_v WHERE title = 'from pg_user' AND status IN ('A', 'B')",
    "SELECT a.status FROM analytics_work_order_v AS a, analytics_quality_v b",
)


def test_screening_corpus(spark):
    log = spark.createDataFrame([("attack", s) for s in ATTACKS] + [("legal", s) for s in LEGAL], "kind string, sql_text string")
    screened = screening.screen_queries(log)
    assert [r.sql_text for r in screened.filter("allowed <> (kind = 'legal')").collect()] == []
    report = {r.kind: r for r in screening.screen_report(screened).collect()}
    assert report["attack"].blocked == len(ATTACKS) and report["attack"].leaked == 0
    assert report["legal"].passed == len(LEGAL)


def test_audit_rows_cut_the_question(spark):
    asked = spark.createDataFrame([("A", "u", "r1", "x" * 501)], "tenant_id string, user_id string, request_id string, question string")
    row = audit.audit_rows(asked, F.lit("EXECUTED"), F.lit(None).cast("string"), F.lit(3), F.lit(None).cast("boolean"), F.lit(12)).first()
    assert len(row.question_summary) == 500 and row.executed and not row.truncated and row.row_count == 3


def test_sla_by_priority(spark):
    at = datetime(2026, 7, 18)
    df = spark.createDataFrame([(p, "CLOSED", at) for p in ("URGENT", "HIGH", "MEDIUM", "LOW", "?")], "priority string, status string, created_at timestamp_ntz")
    got = {r.priority: (r.due_at - at, r.completed_at - at) for r in loading.with_sla(df).collect()}
    assert {p: d[0] // timedelta(hours=1) for p, d in got.items()} == {"URGENT": 2, "HIGH": 8, "MEDIUM": 24, "LOW": 48, "?": 48}
    assert {d[1] for d in got.values()} == {timedelta(minutes=90)}


def test_legacy_rows_all_come_out(spark):
    legacy = spark.createDataFrame(
        [("W-007", "P", "W-001"), ("W-001", "P", None), ("W-002", "Q", None), ("W-999", "P", None), ("W-", "P", None), ("W-0051234567890123", "P", None)],
        "work_order_no string, project_name string, root_work_order_no string",
    )
    projects = spark.createDataFrame([("a", "p1", "P")], "tenant_id string, id string, name string")
    ranges = spark.createDataFrame([("a", "W-000", "W-100")], "tenant_id string, first_no string, last_no string")
    got = {r.work_order_no: r for r in loading.split_tenants(legacy, projects, ranges).collect()}
    assert {k: r.rejected for k, r in got.items()} == {
        "W-007": None, "W-001": None, "W-002": "NO_PROJECT", "W-999": "NO_RANGE", "W-": "BAD_NUMBER", "W-0051234567890123": "BAD_NUMBER",
    }
    assert got["W-007"].root_work_order_id == got["W-001"].id and got["W-001"].id.endswith("-000000000001")


def test_values_meet_the_ranges_that_hold_them(spark):
    """All pairs on random strings: empty and equal ends, turned ends, nulls, one frequent value, many ranges."""
    rng = random.Random(7)

    def word():
        return "".join(rng.choice("ab1é-") for _ in range(rng.randrange(0, 6)))

    values = [word() for _ in range(300)] + ["ab1"] * 200 + [None, ""]
    ends = sorted({word() for _ in range(400)})
    ranges = [(f"t{n}", ends[n], ends[n + 1]) for n in range(0, len(ends) - 1, 2)]
    ranges += [("one", "b1b", "b1b"), ("turned", "b", "a"), ("null", None, "b"), ("wide", "", "b1")]
    values_df = spark.createDataFrame(list(enumerate(values)), "n long, v string")
    ranges_df = spark.createDataFrame(ranges, "tenant_id string, first_no string, last_no string")
    found = loading.in_ranges(values_df, ranges_df, "v")
    got = sorted((r.n, r.tenant_id or "") for r in found.collect())
    expected = []
    for n, v in enumerate(values):
        hits = [t for t, first, last in ranges if v is not None and first is not None and first <= v <= last]
        expected += [(n, t) for t in hits or [""]]
    assert got == sorted(expected) and found.columns == ["v", "n", "tenant_id"]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    empty = loading.in_ranges(values_df, ranges_df.limit(0), "v")
    assert empty.count() == len(values) and empty.where("tenant_id IS NOT NULL").count() == 0


def test_values_meet_ten_thousand_ranges(spark):
    ranges = spark.range(10_000).selectExpr("id AS tenant_id", "lpad(id * 10, 6, '0') AS first_no", "lpad(id * 10 + 9, 6, '0') AS last_no")
    values = spark.range(100_000).selectExpr("id", "lpad(id, 6, '0') AS v")
    got = loading.in_ranges(values, ranges, "v")
    assert got.where("tenant_id = id DIV 10").count() == 100_000


def test_audit_medians_are_exact(spark):
    # More different durations than an approximate percentile tells apart.
    rows = spark.range(200_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('t', id % 3) END AS tenant_id", "'EXECUTED' AS validation_stage", "true AS executed", "id % 5 = 0 AS truncated",
        "CAST(1 AS INT) AS row_count", "CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 7919) % 400009 - 1000 END AS INT) AS execution_ms",
    )
    untimed = spark.sql("SELECT 't9' AS tenant_id, 'POLICY' AS validation_stage, false AS executed, false AS truncated, CAST(NULL AS INT) AS row_count, CAST(NULL AS INT) AS execution_ms")
    got = {r["tenant_id"]: r for r in audit.audit_summary(rows.union(untimed)).collect()}
    for tenant in (None, "t1", "t2"):
        own = [r["execution_ms"] for r in rows.where(F.col("tenant_id").eqNullSafe(F.lit(tenant))).collect()]
        timed = sorted(ms for ms in own if ms is not None)
        assert (got[tenant]["questions"], got[tenant]["max_ms"], got[tenant]["median_ms"]) == (len(own), timed[-1], timed[(len(timed) + 1) // 2 - 1])
    assert len(got) == 4 and got["t9"]["questions"] == 1 and got["t9"]["median_ms"] is None
