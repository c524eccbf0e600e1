"""Queries over the semantic views, the named questions, specs, screening and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.operators import catalog, governed, screening, views
from wrenchbook.operators.governed import Condition, Field, Measure, Spec
from wrenchbook.plans.bindings import AS_OF, Tables
from wrenchbook.plans.registry import query
from wrenchbook.sources import audit

_W = """
SELECT id, tenant_id, project_id, work_order_no, title, project_name, order_type, priority, status, source, assignee_name,
       root_work_order_no, created_at, due_at, accepted_at, completed_at, cancelled_at,
       CASE WHEN status IN ('COMPLETED', 'CLOSED') THEN round(date_diff('microsecond', created_at, completed_at) / 3.6e9, 6) END AS completion_hours,
       coalesce(due_at < TIMESTAMP '1998-06-15 00:00:00' AND status NOT IN ('COMPLETED', 'CLOSED', 'CANCELLED'), false) AS is_overdue
FROM {order_fact}
"""
_Q = """
SELECT q.id, q.tenant_id, w.project_id, q.work_order_id, w.work_order_no, w.title AS work_order_title, w.project_name,
       q.verdict, q.confidence, q.inspection_round, q.generated_at, m.provider AS model_provider, m.model_name,
       m.prompt_version, m.latency_ms AS model_latency_ms, f.finding_count, f.high_severity_count, f.medium_severity_count,
       f.low_severity_count
FROM {quality_result} q
JOIN {order_fact} w ON w.tenant_id = q.tenant_id AND w.id = q.work_order_id
LEFT JOIN {model_call} m ON m.tenant_id = q.tenant_id AND m.id = q.model_call_id
LEFT JOIN (SELECT tenant_id, quality_result_id, count(*) AS finding_count,
                  count(*) FILTER (WHERE severity = 'HIGH') AS high_severity_count,
                  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_severity_count,
                  count(*) FILTER (WHERE severity = 'LOW') AS low_severity_count
           FROM {quality_finding} GROUP BY 1, 2) f ON f.tenant_id = q.tenant_id AND f.quality_result_id = q.id
"""
_X = """
SELECT c.id, c.tenant_id, w.project_id, c.original_work_order_id, w.work_order_no AS original_work_order_no,
       w.title AS original_work_order_title, w.project_name, c.rectification_work_order_id,
       r.work_order_no AS rectification_work_order_no, c.current_verdict, c.inspection_round, c.status, c.created_at, c.closed_at,
       CASE WHEN c.closed_at IS NOT NULL THEN round(date_diff('microsecond', c.created_at, c.closed_at) / 3.6e9, 6) END AS resolution_hours
FROM {rectification_case} c
JOIN {order_fact} w ON w.tenant_id = c.tenant_id AND w.id = c.original_work_order_id
LEFT JOIN {order_fact} r ON r.tenant_id = c.tenant_id AND r.id = c.rectification_work_order_id
"""
_VIEWS = {"w_view": _W, "q_view": _Q, "x_view": _X}


def _w(t: Tables) -> DataFrame:
    return views.work_order_v(t["order_fact"], AS_OF)


def _q(t: Tables, *columns: str) -> DataFrame:
    return views.quality_v(t["quality_result"], t["order_fact"], t["model_call"], t["quality_finding"], columns or None)


def _x(t: Tables, *columns: str) -> DataFrame:
    return views.rectification_v(t["rectification_case"], t["order_fact"], columns or None)


@query("work_order_view", "D1", _W.replace("{order_fact}", "{work_order}"))
def work_order_view(t: Tables) -> DataFrame:
    return views.work_order_v(t["work_order"], AS_OF)


@query("quality_view", "D2", _Q)
def quality_view(t: Tables) -> DataFrame:
    return _q(t)


@query("rectification_view", "D3", _X)
def rectification_view(t: Tables) -> DataFrame:
    return _x(t)


@query("q01_orders_per_status", "E4", "SELECT status, count(*) AS orders FROM {w_view} GROUP BY 1", _VIEWS)
def q01(t: Tables) -> DataFrame:
    return governed.orders_per_status(_w(t))


@query("q02_top_priority_orders", "E4", "SELECT count(*) AS orders FROM {w_view} WHERE priority = 'URGENT'", _VIEWS)
def q02(t: Tables) -> DataFrame:
    return governed.orders_of_priority(_w(t))


@query(
    "q03_busiest_project", "E4",
    "SELECT project_name, count(*) AS orders FROM {w_view} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", _VIEWS,
)
def q03(t: Tables) -> DataFrame:
    return governed.busiest_project(_w(t))


@query(
    "q04_mean_completion_hours", "E4",
    "SELECT round(avg(completion_hours), 6) AS mean_hours FROM {w_view} WHERE status IN ('COMPLETED', 'CLOSED')", _VIEWS,
)
def q04(t: Tables) -> DataFrame:
    return governed.mean_completion_hours(_w(t))


@query(
    "q05_overdue_orders", "E4",
    "SELECT tenant_id, work_order_no, status, due_at FROM {w_view} WHERE is_overdue", _VIEWS,
)
def q05(t: Tables) -> DataFrame:
    return governed.overdue_orders(_w(t))


@query(
    "q06_newest_orders", "E4",
    "SELECT work_order_no, status, created_at FROM {w_view} ORDER BY created_at DESC, work_order_no LIMIT 10", _VIEWS,
)
def q06(t: Tables) -> DataFrame:
    return governed.newest_orders(_w(t))


@query("q07_orders_per_priority", "E4", "SELECT priority, count(*) AS orders FROM {w_view} GROUP BY 1", _VIEWS)
def q07(t: Tables) -> DataFrame:
    return governed.orders_per_priority(_w(t))


@query(
    "q08_completion_rate", "E4",
    """SELECT round(avg(CASE WHEN status IN ('COMPLETED', 'CLOSED') THEN 1.0 ELSE 0.0 END), 6) AS completion_rate
       FROM {w_view} WHERE order_type = 'EMERGENCY'""",
    _VIEWS,
)
def q08(t: Tables) -> DataFrame:
    return governed.completion_rate(_w(t))


@query(
    "q09_failed_orders", "E4 E6",
    """SELECT w.tenant_id, w.work_order_no, w.status, q.verdict, q.inspection_round
       FROM {w_view} w LEFT JOIN {q_view} q ON q.tenant_id = w.tenant_id AND q.work_order_no = w.work_order_no
       WHERE q.verdict = 'FAIL'""",
    _VIEWS,
)
def q09(t: Tables) -> DataFrame:
    return governed.failed_orders(_w(t), _q(t, "tenant_id", "work_order_no", "verdict", "inspection_round"))


@query(
    "q10_pass_rate_per_project", "E4",
    """SELECT tenant_id, project_name, count(*) AS results,
              round(avg(CASE WHEN verdict = 'PASS' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM {q_view} GROUP BY 1, 2""",
    _VIEWS,
)
def q10(t: Tables) -> DataFrame:
    return governed.pass_rate_per_project(_q(t, "tenant_id", "project_name", "verdict"))


@query(
    "q11_most_high_findings", "E4",
    """SELECT tenant_id, work_order_no, CAST(coalesce(sum(high_severity_count), 0) AS BIGINT) AS high_findings
       FROM {q_view} GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10""",
    _VIEWS,
)
def q11(t: Tables) -> DataFrame:
    return governed.most_high_findings(_q(t, "tenant_id", "work_order_no", "high_severity_count"))


@query("q12_closed_cases", "E4", "SELECT count(*) AS cases FROM {x_view} WHERE status = 'CLOSED'", _VIEWS)
def q12(t: Tables) -> DataFrame:
    return governed.closed_cases(_x(t, "status"))


@query(
    "q13_verdicts_per_round", "E4",
    "SELECT inspection_round, verdict, count(*) AS results FROM {q_view} GROUP BY 1, 2", _VIEWS,
)
def q13(t: Tables) -> DataFrame:
    return governed.verdicts_per_round(_q(t, "inspection_round", "verdict"))


@query(
    "q14_created_this_month", "E4",
    """SELECT count(*) AS orders FROM {w_view}
       WHERE date_trunc('month', created_at) = date_trunc('month', TIMESTAMP '1998-06-15 00:00:00')""",
    _VIEWS,
)
def q14(t: Tables) -> DataFrame:
    return governed.created_this_month(_w(t), AS_OF)


@query(
    "q15_orders_per_assignee", "E4",
    "SELECT coalesce(assignee_name, 'N/A') AS assignee, count(*) AS orders FROM {w_view} GROUP BY 1", _VIEWS,
)
def q15(t: Tables) -> DataFrame:
    return governed.orders_per_assignee(_w(t))


_SCOPED = {
    **_VIEWS,
    "w_scoped": "SELECT * FROM {w_view} WHERE (tenant_id, project_id) IN (SELECT tenant_id, project_id FROM {scope})",
    "q_scoped": "SELECT * FROM {q_view} WHERE (tenant_id, project_id) IN (SELECT tenant_id, project_id FROM {scope})",
    "x_scoped": "SELECT * FROM {x_view} WHERE (tenant_id, project_id) IN (SELECT tenant_id, project_id FROM {scope})",
}


def _all_views(t: Tables) -> dict[str, governed.ViewSource]:
    return {
        catalog.WORK_ORDER_VIEW: lambda columns: _w(t),
        catalog.QUALITY_VIEW: lambda columns: _q(t, *columns),
        catalog.RECTIFICATION_VIEW: lambda columns: _x(t, *columns),
    }


@query(
    "spec_monthly_orders", "E2 E5 B2",
    """SELECT date_trunc('month', created_at) AS month, upper(lower(status)) AS status, count(*) AS orders,
              count(*) FILTER (WHERE priority IN ('URGENT', 'HIGH')) AS pressing, max(due_at) AS last_due,
              count(*) OVER () > 500 AS truncated
       FROM {w_scoped} WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND title LIKE 'Order 1%'
       GROUP BY 1, 2 ORDER BY month DESC, status LIMIT 500""",
    _SCOPED,
)
def spec_monthly_orders(t: Tables) -> DataFrame:
    created = Field("created_at")
    spec = Spec(
        view=catalog.WORK_ORDER_VIEW,
        where=(
            Condition(created, "between", (views.moment("1996-01-01"), views.moment("1997-12-31"))),
            Condition(Field("title"), "like", "Order 1%"),
        ),
        group_by=(Field("created_at", "DATE_TRUNC", "month", alias="month"), Field("status", "UPPER")),
        measures=(
            Measure("COUNT", "orders"),
            Measure("COUNT", "pressing", where=(Condition(Field("priority"), "in", ("URGENT", "HIGH")),)),
            Measure("MAX", "last_due", Field("due_at")),
        ),
        order_by=(("month", True), ("status", False)),
        limit=500,
    )
    return governed.run_spec(spec, _all_views(t), t["scope"])


@query(
    "spec_join_quality", "E2 E6 B2",
    """SELECT w.project_name, q.verdict, count(*) AS orders, round(avg(q.confidence), 9) AS confidence,
              count(*) OVER () > 200 AS truncated
       FROM {w_scoped} w LEFT JOIN {q_scoped} q ON q.tenant_id = w.tenant_id AND q.work_order_no = w.work_order_no
       WHERE w.status <> 'CANCELLED' GROUP BY 1, 2 ORDER BY 1, 2 NULLS FIRST LIMIT 200""",
    _SCOPED,
)
def spec_join_quality(t: Tables) -> DataFrame:
    spec = Spec(
        view=catalog.WORK_ORDER_VIEW,
        join=catalog.QUALITY_VIEW,
        where=(Condition(Field("status"), "<>", "CANCELLED"),),
        group_by=(Field("project_name"), Field("verdict", joined=True)),
        measures=(Measure("COUNT", "orders"), Measure("AVG", "confidence", Field("confidence", joined=True))),
        order_by=(("project_name", False), ("verdict", False)),
    )
    return governed.run_spec(spec, _all_views(t), t["scope"]).withColumn("confidence", F.round("confidence", 9))


@query(
    "spec_join_rectification", "E2 E5 E6 B2",
    """SELECT w.work_order_no, length(trim(w.title)) AS title_length, extract(year FROM w.created_at) AS year,
              coalesce(x.status, 'NONE') AS case_status, x.resolution_hours,
              count(*) OVER () > 50 AS truncated
       FROM {w_scoped} w LEFT JOIN {x_scoped} x ON x.tenant_id = w.tenant_id AND x.original_work_order_no = w.work_order_no
       WHERE w.priority ILIKE 'urg%' AND x.current_verdict IS NOT NULL ORDER BY 1, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST, 5 NULLS FIRST LIMIT 50""",
    _SCOPED,
)
def spec_join_rectification(t: Tables) -> DataFrame:
    spec = Spec(
        view=catalog.WORK_ORDER_VIEW,
        join=catalog.RECTIFICATION_VIEW,
        select=(
            Field("work_order_no"),
            Field("title", "LENGTH", alias="title_length"),
            Field("created_at", "EXTRACT", "YEAR", alias="year"),
            Field("status", "COALESCE", "NONE", joined=True, alias="case_status"),
            Field("resolution_hours", joined=True),
        ),
        where=(
            Condition(Field("priority"), "ilike", "urg%"),
            Condition(Field("current_verdict", joined=True), "is not null"),
        ),
        order_by=(("work_order_no", False),),
        limit=50,
    )
    result = governed.run_spec(spec, _all_views(t), t["scope"])
    return result.withColumn("title_length", F.col("title_length").cast("bigint")).withColumn("year", F.col("year").cast("bigint"))


@query(
    "guarded_rows", "E3",
    """SELECT work_order_no, title, status, created_at, true AS truncated
       FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, work_order_no) AS n FROM {w_view}) head WHERE n <= 500""",
    _VIEWS,
)
def guarded_rows(t: Tables) -> DataFrame:
    rows = _w(t).select("work_order_no", "title", "status", "created_at")
    return governed.guard(rows, [F.col("created_at").desc(), F.col("work_order_no")], limit=500, max_bytes=1 << 20)


@query(
    "guarded_bytes", "E3",
    """SELECT work_order_no, title, status, true AS truncated
       FROM (SELECT *, row_number() OVER (ORDER BY title DESC, work_order_no) AS n,
                    sum(2 * (length(work_order_no) + length(title) + length(status))) OVER (ORDER BY title DESC, work_order_no) AS bytes
             FROM {w_view}) head WHERE n <= 100 AND bytes <= 5000""",
    _VIEWS,
)
def guarded_bytes(t: Tables) -> DataFrame:
    rows = _w(t).select("work_order_no", "title", "status")
    return governed.guard(rows, [F.col("title").desc(), F.col("work_order_no")], limit=100, max_bytes=5000)


@query(
    "query_functions", "E5",
    """SELECT tenant_id, count(assignee_name) AS named, CAST(sum(version) AS BIGINT) AS versions, round(avg(version), 6) AS mean_version,
              min(priority) AS first_priority, max(created_at) AS last_created, count(nullif(priority, 'LOW')) AS not_low,
              count(*) FILTER (WHERE coalesce(assignee_name, 'none') = 'none') AS unnamed,
              count(*) FILTER (WHERE extract(month FROM created_at) = 6) AS june, max(length(upper(trim(title)))) AS longest,
              count(*) FILTER (WHERE lower(status) LIKE 'c%' AND project_name BETWEEN 'NATION_1' AND 'NATION_2') AS chosen,
              count(DISTINCT lpad(CAST(version AS STRING), 3, '0')) AS version_texts
       FROM {order_fact} GROUP BY 1""",
)
def query_functions(t: Tables) -> DataFrame:
    return (
        t["order_fact"]
        .groupBy("tenant_id")
        .agg(
            F.count("assignee_name").alias("named"),
            F.sum("version").alias("versions"),
            F.round(F.avg("version"), 6).alias("mean_version"),
            F.min("priority").alias("first_priority"),
            F.max("created_at").alias("last_created"),
            F.count(F.nullif("priority", F.lit("LOW"))).alias("not_low"),
            F.count_if(F.coalesce("assignee_name", F.lit("none")) == "none").alias("unnamed"),
            F.count_if(F.extract(F.lit("MONTH"), "created_at") == 6).alias("june"),
            F.max(F.length(F.upper(F.trim("title")))).cast("bigint").alias("longest"),
            F.count_if(F.lower("status").like("c%") & F.col("project_name").between("NATION_1", "NATION_2")).alias("chosen"),
            F.countDistinct(F.lpad(F.col("version").cast("string"), 3, "0")).alias("version_texts"),
        )
    )


_SCREENED = r"""
SELECT id, kind, sql_text, reason, reason IS NULL AS allowed,
       CASE WHEN reason IS NULL THEN 'PASSED' WHEN reason = 'not_select' THEN 'PARSE' ELSE 'POLICY' END AS stage
FROM (
  SELECT id, kind, sql_text,
    CASE WHEN regexp_matches(sql_text, ';\s*\w') OR contains(sql_text, '--') OR regexp_matches(sql_text, '(?s)/\*.*?\*/')
              OR regexp_matches(sql_text, '(?i)\bUNION\s+ALL\s+SELECT\b') THEN 'blocked_pattern'
         WHEN NOT regexp_matches(sql_text, '(?i)^\s*(select|with)\b') THEN 'not_select'
         WHEN regexp_matches(code, '(?i)\b(union|intersect|except)\b') THEN 'set_operation'
         WHEN len(list_filter(names, lambda n: n LIKE 'pg_catalog.%' OR n LIKE 'information_schema.%')) > 0 THEN 'system_schema'
         WHEN len(list_filter(names, lambda n: n LIKE 'pg\_%' ESCAPE '\')) > 0 THEN 'system_table'
         WHEN len(list_filter(names, lambda n: replace(n, 'public.', '') NOT IN
              ('analytics_work_order_v', 'analytics_quality_v', 'analytics_rectification_v'))) > 0 THEN 'unknown_view'
         WHEN regexp_matches(code, '(?i)\b(pg_sleep|lo_import)\s*\(') THEN 'blocked_function' END AS reason
  FROM (SELECT *, list_transform(regexp_extract_all(code, '(?i)\b(?:from|join)\s+([\w.]+)', 1), lambda n: lower(n)) AS names
        FROM (SELECT *, regexp_replace(sql_text, '''(?:[^'']|'''')*''', '''''', 'g') AS code FROM {query_log}) cleaned) named) checked
"""


@query("query_screening", "E7", "SELECT id, stage, reason, allowed FROM {screened}", {"screened": _SCREENED})
def query_screening(t: Tables) -> DataFrame:
    return screening.screen_queries(t["query_log"]).select("id", "stage", "reason", "allowed")


@query(
    "screening_report", "K7",
    """SELECT kind, count(*) AS total, count(*) FILTER (WHERE NOT allowed) AS blocked, count(*) FILTER (WHERE allowed) AS passed,
              count(*) FILTER (WHERE allowed AND kind = 'attack') AS leaked FROM {screened} GROUP BY 1""",
    {"screened": _SCREENED},
)
def screening_report(t: Tables) -> DataFrame:
    return screening.screen_report(screening.screen_queries(t["query_log"]))


@query(
    "audit_summary", "A7",
    """SELECT tenant_id, validation_stage, count(*) AS questions, count(*) FILTER (WHERE executed) AS executed,
              count(*) FILTER (WHERE truncated) AS truncated, CAST(sum(row_count) AS BIGINT) AS rows_returned,
              max(execution_ms) AS max_ms, quantile_disc(execution_ms, 0.5) AS median_ms
       FROM {audit} GROUP BY 1, 2""",
)
def audit_summary(t: Tables) -> DataFrame:
    return audit.audit_summary(t["audit"])


@query(
    "audit_records", "A7",
    """SELECT 't' || (conv_id % 5) AS tenant_id, 'r' || conv_id || '-' || turn AS request_id, left(text, 500) AS question_summary,
              CASE WHEN role = 'system' THEN 'POLICY' ELSE 'EXECUTED' END AS validation_stage,
              CASE WHEN role = 'system' THEN 'role' END AS rejection_reason, role <> 'system' AS executed
       FROM {conversations}""",
)
def audit_records(t: Tables) -> DataFrame:
    asked = t["conversations"].select(
        F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string")).alias("tenant_id"),
        F.col("role").alias("user_id"),
        F.concat_ws("-", F.concat(F.lit("r"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("question"),
    )
    rejected = F.when(F.col("user_id") == "system", "role")
    return audit.audit_rows(
        asked,
        stage=F.when(rejected.isNotNull(), "POLICY").otherwise("EXECUTED"),
        reason=rejected,
        rows=F.lit(None),
        truncated=F.lit(None).cast("boolean"),
        execution_ms=F.lit(None),
    ).select("tenant_id", "request_id", "question_summary", "validation_stage", "rejection_reason", "executed")
