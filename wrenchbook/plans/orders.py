"""Queries over scope, entitlements, orders, chains and messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.operators import catalog, orders, scope, views
from wrenchbook.plans.bindings import AS_OF, Tables
from wrenchbook.plans.registry import query
from wrenchbook.sources import loading

VISIBLE = """
SELECT w.* FROM {work_order} w
WHERE EXISTS (SELECT 1 FROM {scope} s WHERE s.tenant_id = w.tenant_id AND s.project_id = w.project_id)
"""


@query("tenant_scope", "B1", "SELECT id, tenant_id, project_id, status FROM {order_fact} WHERE tenant_id = 't2'")
def tenant_scope(t: Tables) -> DataFrame:
    return scope.scope_tenant(t["order_fact"], "t2").select("id", "tenant_id", "project_id", "status")


@query(
    "project_scope",
    "B2",
    "SELECT id, tenant_id, project_id FROM {order_fact} WHERE (tenant_id, project_id) IN (SELECT tenant_id, project_id FROM {scope})",
)
def project_scope(t: Tables) -> DataFrame:
    return scope.scope_projects(t["order_fact"], t["scope"]).select("id", "tenant_id", "project_id")


ROLES = """
SELECT DISTINCT m.tenant_id, u.subject, m.role
FROM {tenant_membership} m
JOIN {user_identity} u ON u.id = m.user_identity_id
JOIN {tenant} t ON t.id = m.tenant_id
WHERE u.issuer = 'issuer' AND u.status = 'ACTIVE' AND t.status = 'ACTIVE' AND m.status = 'ACTIVE'
"""
PROJECTS = """
SELECT DISTINCT g.tenant_id, u.subject, g.project_id
FROM {project_scope} g
JOIN {user_identity} u ON u.id = g.user_identity_id
JOIN {tenant} t ON t.id = g.tenant_id
JOIN {project} p ON p.tenant_id = g.tenant_id AND p.id = g.project_id
WHERE u.issuer = 'issuer' AND u.status = 'ACTIVE' AND t.status = 'ACTIVE' AND g.status = 'ACTIVE' AND p.status = 'ACTIVE'
"""


def _roles(t: Tables) -> DataFrame:
    return scope.effective_roles(t["tenant_membership"], t["user_identity"], t["tenant"])


def _projects(t: Tables) -> DataFrame:
    return scope.effective_projects(t["project_scope"], t["user_identity"], t["tenant"], t["project"])


@query("effective_roles", "B3", ROLES)
def effective_roles(t: Tables) -> DataFrame:
    return _roles(t)


@query("effective_projects", "B3", PROJECTS)
def effective_projects(t: Tables) -> DataFrame:
    return _projects(t)


@query(
    "effective_context",
    "B4",
    """
    SELECT c.tenant_id, c.subject, i.user_id,
           CASE WHEN i.user_id IS NULL THEN 'REJECTED' ELSE 'ACCEPTED' END AS outcome,
           CASE WHEN i.user_id IS NULL THEN '' ELSE coalesce((SELECT string_agg(r.role, '|' ORDER BY r.role) FROM {roles} r
             WHERE r.tenant_id = c.tenant_id AND r.subject = c.subject AND list_contains(string_split(c.roles, '|'), r.role)), '') END AS roles,
           CASE WHEN i.user_id IS NULL THEN '' ELSE coalesce((SELECT string_agg(p.project_id, '|' ORDER BY p.project_id) FROM {projects} p
             WHERE p.tenant_id = c.tenant_id AND p.subject = c.subject AND list_contains(string_split(c.project_ids, '|'), p.project_id)), '') END AS project_ids
    FROM {claim} c
    LEFT JOIN (SELECT subject, min(id) AS user_id FROM {user_identity}
               WHERE issuer = 'issuer' AND status = 'ACTIVE' GROUP BY subject HAVING count(*) = 1) i ON i.subject = c.subject
    """,
    {"roles": ROLES, "projects": PROJECTS},
)
def effective_context(t: Tables) -> DataFrame:
    claims = t["claim"].select(
        "subject", "tenant_id", F.split("roles", r"\|").alias("roles"), F.split("project_ids", r"\|").alias("project_ids")
    )
    return scope.effective_context(claims, t["user_identity"], _roles(t), _projects(t)).select(
        "tenant_id", "subject", "user_id", "outcome",
        F.array_join("roles", "|").alias("roles"), F.array_join("project_ids", "|").alias("project_ids"),
    )


@query(
    "safe_columns",
    "B5",
    """SELECT id, tenant_id, project_id, work_order_no, title, project_name, order_type, priority, status, source,
              assignee_name, root_work_order_no, created_at, due_at, accepted_at, completed_at, cancelled_at,
              CASE WHEN status IN ('COMPLETED', 'CLOSED') THEN round(date_diff('microsecond', created_at, completed_at) / 3.6e9, 6) END AS completion_hours,
              coalesce(due_at < TIMESTAMP '1998-06-15 00:00:00' AND status NOT IN ('COMPLETED', 'CLOSED', 'CANCELLED'), false) AS is_overdue
       FROM {work_order}""",
)
def safe_columns(t: Tables) -> DataFrame:
    wide = t["work_order"].withColumn("completion_hours", views.completion_hours()).withColumn("is_overdue", views.is_overdue(AS_OF))
    return catalog.project_safe(wide, catalog.WORK_ORDER_VIEW)


@query(
    "order_lookup",
    "C1",
    """SELECT r.request_id, r.tenant_id, r.work_order_no, v.id AS work_order_id, v.status, v.project_id,
              CASE WHEN v.id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS outcome
       FROM {lookup_request} r LEFT JOIN {visible} v ON v.tenant_id = r.tenant_id AND v.work_order_no = r.work_order_no""",
    {"visible": VISIBLE.replace("{work_order}", "{order_fact}")},
)
def order_lookup(t: Tables) -> DataFrame:
    return orders.lookup(t["lookup_request"], t["order_fact"], t["scope"])


def _criteria() -> orders.SearchCriteria:
    return orders.SearchCriteria(
        status="COMPLETED", priority="HIGH", project_name="  ",
        created_from=datetime(1996, 1, 1), created_to=datetime(1999, 12, 31),
    )


_FOUND = """
FROM {visible} WHERE status = 'COMPLETED' AND priority = 'HIGH'
 AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-12-31'
"""
_VISIBLE_FACT = {"visible": VISIBLE.replace("{work_order}", "{order_fact}")}


@query(
    "order_search_page",
    "C2",
    f"SELECT id, work_order_no, created_at {_FOUND} ORDER BY created_at DESC, id LIMIT 20 OFFSET 20",
    _VISIBLE_FACT,
)
def order_search_page(t: Tables) -> DataFrame:
    page = orders.search(t["order_fact"], t["scope"], _criteria(), page=1, size=20)
    return page.items.select("id", "work_order_no", "created_at")


@query(
    "order_search_total",
    "C2",
    f"SELECT count(*) AS total, 1 AS page, 20 AS size, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages {_FOUND}",
    _VISIBLE_FACT,
)
def order_search_total(t: Tables) -> DataFrame:
    return orders.search(t["order_fact"], t["scope"], _criteria(), page=1, size=20).summary


@query(
    "rework_chain",
    "C3",
    """SELECT r.request_id, r.tenant_id, root.id AS root_id, m.id AS member_id, m.work_order_no AS member_no, m.status, m.created_at
       FROM {lookup_request} r
       JOIN {visible} o ON o.tenant_id = r.tenant_id AND o.work_order_no = r.work_order_no
       JOIN {visible} root ON root.tenant_id = o.tenant_id AND root.id = coalesce(o.root_work_order_id, o.id)
       JOIN {visible} m ON m.tenant_id = root.tenant_id AND (m.id = root.id OR m.root_work_order_id = root.id)""",
    {"visible": VISIBLE},
)
def rework_chain(t: Tables) -> DataFrame:
    return orders.rework_chain(t["lookup_request"], t["work_order"], t["scope"])


@query(
    "chain_stats",
    "C3",
    """SELECT tenant_id, coalesce(root_work_order_id, id) AS root_id, count(*) AS orders,
              count(*) FILTER (WHERE status NOT IN ('COMPLETED', 'CLOSED', 'CANCELLED')) AS open_orders,
              min(created_at) AS first_created_at, max(created_at) AS last_created_at
       FROM {work_order} GROUP BY 1, 2""",
)
def chain_stats(t: Tables) -> DataFrame:
    return orders.chain_stats(t["work_order"])


_SLOTS = """
SELECT *, CASE WHEN work_order_no IS NOT NULL AND explains THEN 'combined' WHEN work_order_no IS NOT NULL OR asks THEN 'work_order'
               ELSE 'knowledge' END AS route
FROM (
  SELECT message_id, tenant_id, message,
    nullif(upper(regexp_extract(message, '(?i)WO-[0-9]{{8}}-[0-9]{{3}}')), '') AS work_order_no,
    regexp_matches(message, '为什么|怎么处理|如何处理|规则|制度|要求|依据') AS explains,
    regexp_matches(message, '查询|查一下|列出|有哪些') AND regexp_matches(message, '工单|待派单|待接单|处理中|已完成|已关闭|紧急工单') AS asks,
    CASE WHEN contains(message, '待派单') THEN 'PENDING_DISPATCH' WHEN contains(message, '待接单') THEN 'PENDING_ACCEPTANCE'
         WHEN contains(message, '处理中') THEN 'PROCESSING' WHEN contains(message, '已完成') THEN 'COMPLETED'
         WHEN contains(message, '已关闭') THEN 'CLOSED' END AS status_filter,
    CASE WHEN contains(message, '紧急') THEN 'URGENT' WHEN contains(message, '高优先级') THEN 'HIGH'
         WHEN contains(message, '中优先级') THEN 'MEDIUM' WHEN contains(message, '低优先级') THEN 'LOW' END AS priority_filter,
    CASE WHEN contains(message, '星河中心') THEN '星河中心' WHEN contains(message, '云帆园区') THEN '云帆园区'
         WHEN contains(message, '海棠公寓') THEN '海棠公寓' END AS project_filter,
    nullif(regexp_extract(message, '([一-龥]{{2,3}})的工单', 1), '') AS assignee_filter
  FROM {message}) slots
"""


@query("message_route", "C4", "SELECT message_id, route FROM {slots}", {"slots": _SLOTS})
def message_route(t: Tables) -> DataFrame:
    return t["message"].select("message_id", orders.route(F.col("message")).alias("route"))


@query(
    "message_filters",
    "C5",
    "SELECT message_id, work_order_no, status_filter, priority_filter, project_filter, assignee_filter FROM {slots}",
    {"slots": _SLOTS},
)
def message_filters(t: Tables) -> DataFrame:
    return orders.extract_filters(t["message"]).select(
        "message_id", "work_order_no", "status_filter", "priority_filter", "project_filter", "assignee_filter"
    )


@query(
    "message_answers",
    "C6",
    """
    SELECT s.message_id, s.tenant_id, 'get_work_order' AS tool, v.id AS work_order_id, v.status
    FROM {tools} s JOIN {visible} v ON v.tenant_id = s.tenant_id AND v.work_order_no = s.work_order_no
    WHERE s.tool = 'get_work_order'
    UNION ALL
    SELECT s.message_id, s.tenant_id, 'get_rework_chain' AS tool, m.id AS work_order_id, m.status
    FROM {tools} s JOIN {visible} o ON o.tenant_id = s.tenant_id AND o.work_order_no = s.work_order_no
    JOIN {visible} r ON r.tenant_id = o.tenant_id AND r.id = coalesce(o.root_work_order_id, o.id)
    JOIN {visible} m ON m.tenant_id = r.tenant_id AND (m.id = r.id OR m.root_work_order_id = r.id)
    WHERE s.tool = 'get_rework_chain'
    UNION ALL
    SELECT message_id, tenant_id, 'search_work_orders' AS tool, work_order_id, status FROM (
      SELECT s.message_id, s.tenant_id, v.id AS work_order_id, v.status,
             row_number() OVER (PARTITION BY s.message_id ORDER BY v.created_at DESC, v.id) AS position
      FROM {tools} s JOIN {visible} v ON v.tenant_id = s.tenant_id
       AND (s.status_filter IS NULL OR s.status_filter = v.status) AND (s.priority_filter IS NULL OR s.priority_filter = v.priority)
       AND (s.project_filter IS NULL OR s.project_filter = v.project_name) AND (s.assignee_filter IS NULL OR s.assignee_filter = v.assignee_name)
      WHERE s.tool = 'search_work_orders') ranked WHERE position <= 20
    """,
    {
        "slots": _SLOTS,
        "tools": """SELECT *, CASE WHEN route = 'knowledge' THEN NULL
                              WHEN work_order_no IS NOT NULL AND (route = 'combined' OR contains(message, '返工')) THEN 'get_rework_chain'
                              WHEN work_order_no IS NOT NULL THEN 'get_work_order' ELSE 'search_work_orders' END AS tool FROM {slots}""",
        "visible": """SELECT o.* FROM {numbered_order} o WHERE EXISTS
                      (SELECT 1 FROM {numbered_scope} s WHERE s.tenant_id = o.tenant_id AND s.project_id = o.project_id)""",
    },
)
def message_answers(t: Tables) -> DataFrame:
    return orders.answer_requests(t["message"], t["numbered_order"], t["numbered_scope"])


@query(
    "event_names",
    "C7",
    """SELECT event_id, CASE action WHEN 'ASSIGN' THEN 'WORK_ORDER_ASSIGNED' WHEN 'ACCEPT' THEN 'WORK_ORDER_ACCEPTED'
              WHEN 'START' THEN 'WORK_ORDER_STARTED' WHEN 'COMPLETE' THEN 'WORK_ORDER_COMPLETED' WHEN 'CLOSE' THEN 'WORK_ORDER_CLOSED'
              WHEN 'CANCEL' THEN 'WORK_ORDER_CANCELLED' END AS event_name FROM {order_event}""",
)
def event_names(t: Tables) -> DataFrame:
    return t["order_event"].select("event_id", orders.event_type(F.col("action")).alias("event_name"))


@query(
    "legacy_split",
    "A3",
    """
    SELECT s.tenant_id, s.id, s.work_order_no, s.project_id, r.id AS root_work_order_id, s.rejected
    FROM {rekeyed} s LEFT JOIN {rekeyed} r ON r.rejected IS NULL AND r.tenant_id = s.tenant_id AND r.work_order_no = s.root_work_order_no
    """,
    {
        "rekeyed": """SELECT g.tenant_id,
                             CASE WHEN length(regexp_extract(l.work_order_no, '[0-9]+$')) BETWEEN 1 AND 12
                                  THEN '00000000-0000-0000-0000-' || lpad(regexp_extract(l.work_order_no, '[0-9]+$'), 12, '0') END AS id,
                             l.work_order_no, l.root_work_order_no, p.id AS project_id,
                             CASE WHEN length(regexp_extract(l.work_order_no, '[0-9]+$')) NOT BETWEEN 1 AND 12 THEN 'BAD_NUMBER'
                                  WHEN g.tenant_id IS NULL THEN 'NO_RANGE' WHEN p.id IS NULL THEN 'NO_PROJECT' END AS rejected
                      FROM {legacy_order} l
                      LEFT JOIN {legacy_range} g ON l.work_order_no BETWEEN g.first_no AND g.last_no
                      LEFT JOIN {legacy_project} p ON p.tenant_id = g.tenant_id AND p.name = l.project_name"""
    },
)
def legacy_split(t: Tables) -> DataFrame:
    return loading.split_tenants(t["legacy_order"], t["legacy_project"], t["legacy_range"]).select(
        "tenant_id", "id", "work_order_no", "project_id", "root_work_order_id", "rejected"
    )


@query(
    "sla_times",
    "A4",
    """SELECT work_order_no,
              created_at + INTERVAL 1 HOUR * CASE priority WHEN 'URGENT' THEN 2 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 24 ELSE 48 END AS due_at,
              CASE WHEN status IN ('COMPLETED', 'CLOSED') THEN created_at + INTERVAL 90 MINUTE END AS completed_at
       FROM {legacy_order}""",
)
def sla_times(t: Tables) -> DataFrame:
    return loading.with_sla(t["legacy_order"]).select("work_order_no", "due_at", "completed_at")
