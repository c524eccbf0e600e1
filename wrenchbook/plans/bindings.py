"""Domain tables derived from the star-schema test tables.

Each binding is one SELECT in the dialect that Spark and DuckDB share. Names in
braces are other bindings or base tables. Spark resolves them to DataFrames,
the oracles to common table expressions, so both sides read the same input and
differ only in how they compute an operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows are expensive to work on.
SPREAD_TABLES = ("documents", "pages", "conversations", "lineitem", "events", "orders", "embeddings")

# The instant at which time-dependent operators look at the order tables.
AS_OF = "1998-06-15 00:00:00"
# The same for the tables that derive from events.
EVENTS_AS_OF = "2024-01-16 12:00:00"

BINDINGS: dict[str, str] = {}

BINDINGS["tenant"] = """
SELECT 't' || r_regionkey AS id, r_name AS name,
       CASE WHEN r_regionkey = 4 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {region}
"""

BINDINGS["project"] = """
SELECT 't' || n_regionkey AS tenant_id, 'p' || n_nationkey AS id, n_name AS name,
       CASE WHEN n_nationkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {nation}
"""

BINDINGS["user_identity"] = """
SELECT 'u' || s_suppkey AS id, 'issuer' AS issuer,
       'sub' || CASE WHEN s_suppkey % 10 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS subject,
       s_name AS display_name,
       CASE WHEN s_suppkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {supplier}
"""

BINDINGS["tenant_membership"] = """
SELECT 't' || n.n_regionkey AS tenant_id, 'u' || s.s_suppkey AS user_identity_id,
       CASE s.s_suppkey % 4 WHEN 0 THEN 'DISPATCHER' WHEN 1 THEN 'OPERATOR'
            WHEN 2 THEN 'QUALITY_REVIEWER' ELSE 'TENANT_ADMIN' END AS role,
       'ACTIVE' AS status
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
UNION ALL
SELECT 't' || n.n_regionkey AS tenant_id, 'u' || s.s_suppkey AS user_identity_id,
       CASE s.s_nationkey % 3 WHEN 0 THEN 'OPERATOR' WHEN 1 THEN 'DISPATCHER' ELSE 'AI_SERVICE' END AS role,
       CASE WHEN s.s_suppkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
"""

BINDINGS["project_scope"] = """
SELECT 't' || n.n_regionkey AS tenant_id, 'u' || s.s_suppkey AS user_identity_id,
       'p' || p.n_nationkey AS project_id,
       CASE WHEN (s.s_suppkey + p.n_nationkey) % 6 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {supplier} s
JOIN {nation} n ON n.n_nationkey = s.s_nationkey
JOIN {nation} p ON p.n_regionkey = n.n_regionkey
"""

# Token claims: every user claims its first role, a role it may have lost, and two projects.
BINDINGS["claim"] = """
SELECT 'sub' || s.s_suppkey AS subject, 't' || n.n_regionkey AS tenant_id,
       'DISPATCHER|OPERATOR|QUALITY_REVIEWER' AS roles,
       'p' || s.s_nationkey || '|p' || (s.s_nationkey + 5) % 25 || '|p' || (s.s_nationkey + 10) % 25 AS project_ids
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
"""

# The scope of one reading user per tenant: the active projects.
BINDINGS["scope"] = """
SELECT tenant_id, id AS project_id FROM {project} WHERE status = 'ACTIVE'
"""

_ORDER_COLUMNS = """
       't' || n.n_regionkey AS tenant_id,
       'o' || o.o_orderkey AS id,
       'WO-' || o.o_orderkey AS work_order_no,
       'Order ' || o.o_orderkey || ' of ' || c.c_name AS title,
       'Service request from segment ' || c.c_mktsegment AS description,
       'p' || c.c_nationkey AS project_id,
       n.n_name AS project_name,
       n.n_name || '/' || c.c_mktsegment AS space_path,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH'
            WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       CASE WHEN o.o_orderstatus = 'O' AND o.o_orderkey % 2 = 0 THEN 'PENDING_DISPATCH'
            WHEN o.o_orderstatus = 'O' THEN 'PENDING_ACCEPTANCE'
            WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 10 = 0 THEN 'CANCELLED'
            WHEN o.o_orderstatus = 'P' THEN 'PROCESSING'
            WHEN o.o_orderkey % 2 = 0 THEN 'COMPLETED' ELSE 'CLOSED' END AS status,
       's' || (o.o_custkey % 50) AS assignee_id,
       CASE WHEN o.o_custkey % 50 = 7 THEN NULL ELSE 'Worker ' || (o.o_custkey % 50) END AS assignee_name,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'PLAN' WHEN 1 THEN 'MANUAL' ELSE 'INSPECTION' END AS source,
       CAST(o.o_orderkey % 5 AS BIGINT) AS version,
       CASE WHEN o.o_orderstatus = 'F' OR o.o_orderkey % 3 = 0
            THEN o.o_orderdate + INTERVAL '1' HOUR END AS accepted_at,
       o.o_orderdate AS created_at,
       o.o_orderdate + INTERVAL '1' DAY * CASE o.o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 8
            WHEN '3-MEDIUM' THEN 24 ELSE 48 END AS due_at,
       CASE WHEN o.o_orderstatus = 'F'
            THEN o.o_orderdate + INTERVAL '1' DAY * CAST(o.o_orderkey % 60 - 3 AS INT) END AS completed_at,
       CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 10 = 0
            THEN o.o_orderdate + INTERVAL '3' DAY END AS cancelled_at,
       CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 10 = 0 THEN 'duplicate request' END AS cancel_reason
"""

# Orders without the rework link, for questions that never look at it.
BINDINGS["order_fact"] = f"""
SELECT {_ORDER_COLUMNS},
       CASE WHEN o.o_orderkey % 10 = 8 THEN 'REWORK' WHEN o.o_orderkey % 7 = 0 THEN 'EMERGENCY'
            ELSE 'STANDARD' END AS order_type,
       CAST(NULL AS STRING) AS root_work_order_id,
       CAST(NULL AS STRING) AS root_work_order_no,
       CAST(NULL AS STRING) AS rework_reason
FROM {{orders}} o
JOIN {{customer}} c ON c.c_custkey = o.o_custkey
JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
"""

# First order per customer: (days, key) packed into one number, so that a plain min finds it.
BINDINGS["first_order"] = """
SELECT o_custkey AS custkey,
       min(CAST((year(o_orderdate) - 1970) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) AS BIGINT)
           * 10000000000000 + o_orderkey) % 10000000000000 AS root_key
FROM {orders} GROUP BY o_custkey
"""

BINDINGS["work_order"] = f"""
SELECT {_ORDER_COLUMNS},
       CASE WHEN o.o_orderkey % 10 = 8 AND f.root_key <> o.o_orderkey THEN 'REWORK'
            WHEN o.o_orderkey % 7 = 0 THEN 'EMERGENCY' ELSE 'STANDARD' END AS order_type,
       CASE WHEN o.o_orderkey % 10 = 8 AND f.root_key <> o.o_orderkey THEN 'o' || f.root_key END AS root_work_order_id,
       CASE WHEN o.o_orderkey % 10 = 8 AND f.root_key <> o.o_orderkey THEN 'WO-' || f.root_key END AS root_work_order_no,
       CASE WHEN o.o_orderkey % 10 = 8 AND f.root_key <> o.o_orderkey THEN 'first repair failed' END AS rework_reason
FROM {{orders}} o
JOIN {{customer}} c ON c.c_custkey = o.o_custkey
JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
JOIN {{first_order}} f ON f.custkey = o.o_custkey
"""

# Requests by number: each customer asks for the order that carries its own key.
BINDINGS["lookup_request"] = """
SELECT 'r' || c.c_custkey AS request_id, 't' || n.n_regionkey AS tenant_id,
       'WO-' || (c.c_custkey * 7 + 8) AS work_order_no
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

# Chat messages around a number, a filter or neither; the customer's own words follow.
BINDINGS["message"] = """
SELECT 'm' || conv_id || '-' || turn AS message_id, 't' || (conv_id % 5) AS tenant_id,
       CASE turn % 6
         WHEN 0 THEN '查询 wo-' || lpad(CAST(CAST(floor(conv_id / 1000) AS BIGINT) AS STRING), 8, '0') || '-' || lpad(CAST(conv_id % 1000 AS STRING), 3, '0') || ' '
         WHEN 1 THEN 'WO-' || lpad(CAST(CAST(floor(conv_id / 1000) AS BIGINT) AS STRING), 8, '0') || '-' || lpad(CAST(conv_id % 1000 AS STRING), 3, '0') || ' 为什么超时? '
         WHEN 2 THEN '列出星河中心处理中的高优先级工单 '
         WHEN 3 THEN '有哪些待派单 张小三的工单 '
         WHEN 4 THEN '查一下 WO-' || lpad(CAST(CAST(floor(conv_id / 1000) AS BIGINT) AS STRING), 8, '0') || '-' || lpad(CAST(conv_id % 1000 AS STRING), 3, '0') || ' 的返工 '
         ELSE '' END || text AS message
FROM {conversations}
"""

# Orders renumbered into the shape that chat messages ask for: 8 and 3 digits, one number per key.
BINDINGS["numbered_order"] = """
SELECT * FROM (
  SELECT 't' || (o_orderkey % 5) AS tenant_id, 'o' || o_orderkey AS id,
         'WO-' || lpad(CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) AS STRING), 8, '0') || '-' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') AS work_order_no,
         'p' || (o_orderkey % 4) AS project_id,
         CASE o_orderkey % 3 WHEN 0 THEN '星河中心' WHEN 1 THEN '云帆园区' ELSE '海棠公寓' END AS project_name,
         CASE o_orderstatus WHEN 'O' THEN 'PENDING_DISPATCH' WHEN 'P' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH'
              WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
         CASE WHEN o_custkey % 3 = 0 THEN '张小三' ELSE '林晓' END AS assignee_name,
         CASE WHEN o_orderkey % 10 = 8 THEN 'o' || (o_orderkey - 5) END AS root_work_order_id,
         o_orderdate AS created_at
  FROM {orders}
) numbered
"""

BINDINGS["numbered_scope"] = """
SELECT 't' || r_regionkey AS tenant_id, 'p0' AS project_id FROM {region}
UNION ALL SELECT 't' || r_regionkey, 'p1' FROM {region}
UNION ALL SELECT 't' || r_regionkey, 'p3' FROM {region}
"""

BINDINGS["quality_result"] = """
SELECT 'qr' || o.o_orderkey AS id, 't' || n.n_regionkey AS tenant_id, 'j' || o.o_orderkey AS quality_job_id,
       'o' || o.o_orderkey AS work_order_id, CAST(o.o_orderkey % 5 AS BIGINT) AS work_order_version,
       CAST(1 + o.o_orderkey % 3 AS INT) AS inspection_round,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'SKIP' WHEN 3 THEN 'FAIL'
            ELSE 'PASS' END AS verdict,
       (50 + o.o_orderkey % 50) / 100.0E0 AS confidence,
       o.o_orderdate + INTERVAL '1' DAY * CAST(o.o_orderkey % 60 + 1 AS INT) AS generated_at,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE 'mc' || o.o_orderkey END AS model_call_id
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderstatus = 'F'
"""

BINDINGS["model_call"] = """
SELECT 'mc' || o.o_orderkey AS id, 't' || n.n_regionkey AS tenant_id, 'provider' AS provider,
       'm' || (o.o_custkey % 3) AS model_name, 'v1' AS prompt_version,
       CAST(floor(o.o_totalprice) AS BIGINT) % 1000 AS latency_ms
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderstatus = 'F'
"""

BINDINGS["quality_finding"] = """
SELECT q.tenant_id AS tenant_id, q.id AS quality_result_id,
       'f' || l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey || '-' || l.l_suppkey AS id,
       CAST(l.l_linenumber AS INT) AS ordinal,
       'POLICY_' || upper(p.p_type) AS rule_code,
       CASE l.l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE WHEN l.l_discount > 0.08 THEN 'FAIL' WHEN l.l_tax >= 0.07 THEN 'UNCERTAIN' ELSE 'PASS' END AS label,
       'Replace ' || p.p_name || ' from supplier ' || l.l_suppkey AS recommendation
FROM {lineitem} l
JOIN {quality_result} q ON q.id = 'qr' || l.l_orderkey
JOIN {part} p ON p.p_partkey = l.l_partkey
"""

BINDINGS["rectification_case"] = """
SELECT 'rc' || substring(q.id, 3) AS id, q.tenant_id AS tenant_id, q.work_order_id AS original_work_order_id,
       q.id AS current_quality_result_id, q.verdict AS current_verdict, q.inspection_round AS inspection_round,
       CASE WHEN CAST(substring(q.id, 3) AS BIGINT) % 6 = 0
            THEN 'o' || (CAST(substring(q.id, 3) AS BIGINT) + 5) END AS rectification_work_order_id,
       CASE WHEN CAST(substring(q.id, 3) AS BIGINT) % 4 = 0 THEN 'CLOSED'
            WHEN q.verdict = 'PASS' THEN 'PROPOSED' ELSE 'RECTIFYING' END AS status,
       q.generated_at AS created_at,
       CASE WHEN CAST(substring(q.id, 3) AS BIGINT) % 4 = 0
            THEN q.generated_at + INTERVAL '1' HOUR * CAST(CAST(substring(q.id, 3) AS BIGINT) % 48 AS INT) END AS closed_at
FROM {quality_result} q
WHERE q.verdict <> 'SKIP'
"""

# One inspected order with the fields and attachment counts that the rules read.
BINDINGS["inspection_input"] = """
SELECT w.tenant_id AS tenant_id, 'j' || substring(w.id, 2) AS job_id, w.id AS work_order_id,
       w.title AS title, w.description AS description, w.order_type AS order_type, w.space_path AS space_path,
       CASE WHEN CAST(substring(w.id, 2) AS BIGINT) % 11 = 0 THEN NULL
            WHEN CAST(substring(w.id, 2) AS BIGINT) % 13 = 0 THEN '   '
            ELSE ' Done: ' || w.description || ' ' END AS completion_summary,
       w.created_at AS created_at, w.completed_at AS completed_at, w.due_at AS due_at
FROM {order_fact} w
WHERE w.status IN ('COMPLETED', 'CLOSED')
"""

BINDINGS["attachment"] = """
SELECT 'j' || l_orderkey AS job_id,
       'a' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS attachment_id,
       'image/png' AS media_type, CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, l_quantity > 10 AS present
FROM {lineitem}
"""

# Model findings of an inspection and the policy chunks that were retrieved for it.
BINDINGS["model_finding"] = """
SELECT 'j' || l_orderkey AS job_id, CAST(l_linenumber AS INT) AS ordinal,
       'f' || l_partkey || '-' || l_suppkey AS finding_id,
       CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE WHEN l_discount > 0.08 THEN 'FAIL' WHEN l_tax >= 0.07 THEN 'UNCERTAIN' ELSE 'PASS' END AS label,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE 'c' || (l_partkey % 40) END AS policy_chunk_id
FROM {lineitem}
"""

BINDINGS["model_output"] = """
SELECT 'j' || o_orderkey AS job_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'FAIL' WHEN 2 THEN 'SKIP' WHEN 4 THEN 'UNCERTAIN' ELSE 'PASS' END AS verdict,
       (60 + o_orderkey % 40) / 100.0E0 AS confidence
FROM {orders}
"""

# Model answers as JSON text, one finding per line, some of them malformed.
BINDINGS["model_payload"] = """
SELECT 'j' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS job_id,
       'chunk-' || (l_partkey % 40) AS chunk_id,
       '{{"verdict":"' || CASE WHEN l_suppkey % 29 = 0 THEN 'GOOD' ELSE 'PASS' END || '","confidence":'
       || CASE WHEN l_suppkey % 31 = 0 THEN '1.5' ELSE '0.75' END || CASE WHEN l_suppkey % 37 = 0 THEN ',"note":"x"' ELSE '' END
       || ',"findings":[{{"rule_code":"' || CASE WHEN l_suppkey % 23 = 0 THEN 'policy' WHEN l_suppkey % 19 = 0 THEN 'POLICY_X' ELSE 'POLICY_A' END
       || '","severity":"' || CASE WHEN l_suppkey % 17 = 0 THEN 'CRITICAL' ELSE 'LOW' END
       || '","label":"FAIL","evidence":' || CASE WHEN l_suppkey % 41 = 0 THEN '5' WHEN l_suppkey % 43 = 0 THEN '{{"a":1}}'
                                           WHEN l_suppkey % 13 = 0 THEN '" "' ELSE '"seen by ' || l_returnflag || '"' END
       || ',"policy_chunk_id":null' || CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE ',"recommendation":"Repair"' END || ',"confidence":0.5}}'
       || CASE WHEN l_suppkey % 7 = 0 THEN ',{{"rule_code":"POLICY_A","severity":"LOW","label":"PASS","evidence":"e","policy_chunk_id":null,"recommendation":"r","confidence":1}}' ELSE '' END
       || ']}}' || CASE WHEN l_suppkey % 47 = 0 THEN ' and more' ELSE '' END AS payload
FROM {lineitem}
"""

BINDINGS["policy_hit"] = """
SELECT 'j' || l_orderkey AS job_id, 'c' || (l_partkey % 40) AS chunk_id,
       'k' || (l_partkey % 8) AS document_key, CAST(1 + l_suppkey % 4 AS INT) AS document_version
FROM {lineitem} WHERE l_returnflag <> 'N'
"""

BINDINGS["order_event"] = """
SELECT 't' || (user_id % 5) AS tenant_id,
       'w' || user_id || '-' || CAST(floor((day(ts) - 1) / 7) AS INT) AS work_order_id,
       event_id AS event_id,
       CASE WHEN value > 150 THEN 'CANCEL' WHEN event_type = 'signup' THEN 'ASSIGN' WHEN event_type = 'view' THEN 'ACCEPT'
            WHEN event_type = 'click' THEN 'START' WHEN event_type = 'purchase' THEN 'COMPLETE' ELSE 'CLOSE' END AS action,
       CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 3 = 1 THEN NULL ELSE ' not needed ' END AS reason,
       'a' || (user_id % 11) AS actor_id, ts AS occurred_at
FROM {events}
"""

# Assignment events: the assignee changes from time to time.
BINDINGS["assignment_event"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS work_order_id, event_id AS event_id,
       's' || CAST(floor(value / 40) AS INT) AS assignee_id, ts AS assigned_at
FROM {events} WHERE event_type = 'signup' OR event_type = 'view'
"""

# Logged before and after statuses; most steps follow the log, some break the chain.
BINDINGS["snapshot_event"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS work_order_id, event_id AS event_id, ts AS created_at,
       CASE CAST(floor(value) AS INT) % 5 WHEN 0 THEN 'PENDING_DISPATCH' WHEN 1 THEN 'PENDING_ACCEPTANCE'
            WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'COMPLETED' ELSE 'CLOSED' END AS before_status,
       CASE event_type WHEN 'signup' THEN 'PENDING_ACCEPTANCE' WHEN 'view' THEN 'PROCESSING'
            WHEN 'click' THEN 'COMPLETED' WHEN 'purchase' THEN 'CLOSED' ELSE 'CANCELLED' END AS after_status,
       CAST(floor(value) AS BIGINT) % 9 AS before_version,
       CAST(floor(value) AS BIGINT) % 9 + CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS after_version
FROM {events}
"""

BINDINGS["command"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS target_id, event_id AS command_id,
       CAST(floor(value) AS BIGINT) % 8 AS expected_version, ts AS arrived_at
FROM {events}
"""

BINDINGS["command_target"] = """
SELECT DISTINCT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS id, CAST(user_id % 3 AS BIGINT) AS version
FROM {events}
"""

BINDINGS["request"] = """
SELECT 't' || (user_id % 5) AS tenant_id, event_type AS operation, 'u' || user_id || '-' || props AS key,
       'h' || CAST(floor(value / 50) AS INT) AS request_hash, event_id AS request_id, ts AS arrived_at
FROM {events}
"""

BINDINGS["proposal"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'pr' || event_id AS id, 'o' || user_id AS target_id,
       CASE event_type WHEN 'signup' THEN 'ASSIGN' WHEN 'view' THEN 'ACCEPT' WHEN 'click' THEN 'UPDATE'
            WHEN 'purchase' THEN 'CLOSE' ELSE 'CREATE_RECTIFICATION' END AS action_type,
       CASE WHEN event_id % 11 = 0 THEN 'EXECUTED' WHEN event_id % 13 = 0 THEN 'REJECTED'
            WHEN event_id % 4 = 0 THEN 'CONFIRMED' ELSE 'PENDING_CONFIRMATION' END AS status,
       'a' || (user_id % 11) AS requested_by,
       CASE WHEN event_id % 4 = 0 THEN 'a' || (event_id % 6) END AS confirmed_by,
       'a' || (user_id % 6) AS assignee_id, ts AS created_at
FROM {events}
"""

# Who decides, with which roles; the second decision on a proposal comes an hour later.
BINDINGS["decision"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'pr' || event_id AS proposal_id, 'd1-' || event_id AS decision_id,
       CASE WHEN value > 120 THEN 'REJECT' WHEN value > 115 THEN 'MAYBE' ELSE 'CONFIRM' END AS decision,
       'a' || (event_id % 6) AS actor_id,
       ts + INTERVAL '1' MINUTE * CAST(event_id % 20 AS INT) AS decided_at
FROM {events}
UNION ALL
SELECT 't' || (user_id % 5) AS tenant_id, 'pr' || event_id AS proposal_id, 'd2-' || event_id AS decision_id,
       'CONFIRM' AS decision, 'a' || ((event_id + 1) % 6) AS actor_id, ts + INTERVAL '1' HOUR AS decided_at
FROM {events} WHERE event_type <> 'click'
"""

BINDINGS["actor_role"] = """
SELECT DISTINCT 't' || (user_id % 5) AS tenant_id, 'a' || (event_id % 6) AS actor_id,
       CASE event_id % 6 WHEN 0 THEN 'DISPATCHER' WHEN 1 THEN 'OPERATOR' WHEN 2 THEN 'QUALITY_REVIEWER'
            WHEN 3 THEN 'AI_SERVICE' WHEN 4 THEN 'DISPATCHER' ELSE 'TENANT_ADMIN' END AS role
FROM {events}
UNION
SELECT DISTINCT 't' || (user_id % 5) AS tenant_id, 'a' || (event_id % 6) AS actor_id,
       CASE WHEN event_id % 6 = 2 OR event_id % 6 = 4 THEN 'OPERATOR' ELSE 'TENANT_ADMIN' END AS role
FROM {events}
"""

BINDINGS["outbox"] = """
SELECT 'e' || o.o_orderkey AS event_id, w.tenant_id AS tenant_id, 'WORK_ORDER' AS aggregate_type,
       w.id AS aggregate_id,
       CASE WHEN w.status = 'COMPLETED' THEN 'WORK_ORDER_COMPLETED' ELSE 'WORK_ORDER_UPDATED' END AS event_type,
       '{{"id":"' || w.id || '","tenant_id":"' || CASE WHEN o.o_orderkey % 31 = 0 THEN 'tx' ELSE w.tenant_id END
         || '","version":' || CASE WHEN o.o_orderkey % 37 = 0 THEN -1 ELSE w.version END
         || ',"status":"' || CASE WHEN o.o_orderkey % 41 = 0 THEN 'CLOSED' ELSE w.status END
         || '","title":"' || w.title || '","extra":{{"list":[{{"'
         || CASE WHEN o.o_orderkey % 29 = 0 THEN 'Photo_URL' WHEN o.o_orderkey % 43 = 0 THEN ' token ' ELSE 'note' END
         || '":"a ' || chr(92) || '"secret' || chr(92) || '": b"}}]}},"inspection_round":' || CASE WHEN o.o_orderkey % 47 = 0 THEN 0 ELSE 1 END || '}}' AS payload,
       CASE WHEN o.o_orderkey % 6 = 0 THEN 'PUBLISHED' ELSE 'PENDING' END AS status,
       w.created_at AS occurred_at, w.created_at + INTERVAL '1' DAY * CAST(o.o_orderkey % 9 AS INT) AS available_at,
       CAST(o.o_orderkey % 4 AS INT) AS attempts
FROM {order_fact} w JOIN {orders} o ON 'o' || o.o_orderkey = w.id
WHERE w.status IN ('COMPLETED', 'CLOSED')
"""

BINDINGS["outbox_ack"] = """
SELECT 't' || n.n_regionkey AS tenant_id, 'e' || o.o_orderkey AS event_id
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
WHERE o.o_totalprice > 250000
"""

BINDINGS["inbox_message"] = """
SELECT 't' || (user_id % 5) AS tenant_id, event_type AS provider, 'x' || user_id || '-' || props AS external_message_id,
       event_id AS message_id, ts AS received_at
FROM {events}
"""

BINDINGS["quality_job"] = """
SELECT 't' || n.n_regionkey AS tenant_id, 'j' || o.o_orderkey AS id, 'o' || o.o_orderkey AS work_order_id,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'RETRY_WAIT'
            WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
       CAST(o.o_orderkey % 3 AS INT) AS priority,
       CASE WHEN o.o_orderkey % 6 = 0 THEN 0 ELSE CAST(1 + o.o_orderkey % 4 AS INT) END AS retry_count,
       3 AS max_retry_count,
       CASE WHEN o.o_orderkey % 6 = 2 THEN TIMESTAMP '1998-06-15 00:00:00' + INTERVAL '1' MINUTE * CAST(o.o_orderkey % 50 - 25 AS INT) END AS next_retry_at,
       CASE WHEN o.o_orderkey % 6 IN (1, 3) THEN TIMESTAMP '1998-06-15 00:00:00' - INTERVAL '1' MINUTE * CAST(o.o_orderkey % 31 AS INT) END AS started_at,
       o.o_orderdate AS created_at
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

# Outcomes of attempts; some report an attempt that is no longer the current one.
BINDINGS["job_outcome"] = """
SELECT 't' || n.n_regionkey AS tenant_id, 'j' || o.o_orderkey AS job_id,
       CASE WHEN o.o_orderkey % 17 = 0 THEN 9 ELSE CAST(1 + o.o_orderkey % 4 AS INT) END AS attempt,
       CASE o.o_custkey % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'RETRYABLE' WHEN 2 THEN 'FATAL' WHEN 3 THEN 'OUTPUT_INVALID'
            WHEN 4 THEN 'INPUT_INVALID' ELSE 'UNKNOWN' END AS outcome,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'SKIP' ELSE 'PASS' END AS verdict,
       TIMESTAMP '1998-06-15 00:00:00' AS finished_at
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

BINDINGS["completed_event"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS work_order_id,
       CAST(floor(value / 30) AS BIGINT) AS work_order_version, CAST(1 + event_id % 2 AS INT) AS inspection_round,
       event_id AS event_id, ts AS occurred_at
FROM {events}
"""

# Incoming revisions of documents in arrival order, and the versions already stored.
BINDINGS["incoming_document"] = """
SELECT lang AS tenant_id, split_part(text, '.', 1) AS document_key, doc_id AS arrival, text AS markdown
FROM {documents}
"""

BINDINGS["stored_document"] = """
SELECT d.lang AS tenant_id, split_part(d.text, '.', 1) AS document_key, CAST(d.doc_id + 1 AS INT) AS version,
       d.text AS markdown, d.doc_id AS doc_id
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id
WHERE l.toxic = 1
"""

BINDINGS["document_input"] = """
SELECT lang AS tenant_id, CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 50 = 1 THEN ' padded ' ELSE 'd' || doc_id END AS document_key,
       CASE WHEN doc_id % 50 = 2 THEN repeat('x', 301) ELSE source END AS title,
       CASE WHEN doc_id % 50 = 3 THEN ' ' ELSE text END AS markdown,
       CASE WHEN doc_id % 50 = 4 THEN '' ELSE 'doc://' || source || '/' || doc_id END AS source_uri
FROM {documents}
"""

BINDINGS["document_version"] = """
SELECT lang AS tenant_id, 'd' || doc_id AS id, source AS document_key, CAST(1 + doc_id AS INT) AS version, source AS title,
       CASE WHEN n_chars > 2000 THEN 'ACTIVE' ELSE 'PENDING' END AS status
FROM {documents}
"""

BINDINGS["embedding_job"] = """
SELECT lang AS tenant_id, 'd' || doc_id AS document_id, 'c' || doc_id || '-0' AS id,
       CASE WHEN doc_id % 7 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status
FROM {documents}
UNION ALL
SELECT lang AS tenant_id, 'd' || doc_id AS document_id, 'c' || doc_id || '-1' AS id,
       CASE WHEN doc_id % 11 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status
FROM {documents} WHERE n_chars > 500
"""

BINDINGS["stored_chunk"] = """
SELECT lang AS tenant_id, 'd' || doc_id AS document_id, 'c' || doc_id || '-0' AS id, CAST(0 AS INT) AS ordinal, 'ACTIVE' AS status
FROM {documents}
UNION ALL
SELECT lang AS tenant_id, 'd' || doc_id AS document_id, 'c' || doc_id || '-1' AS id, CAST(1 AS INT) AS ordinal,
       CASE WHEN n_chars > 3000 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {documents} WHERE n_chars > 500
"""

# Markdown around each document: a title, a dropped preface and two sections.
BINDINGS["markdown"] = """
SELECT lang AS tenant_id, 'd' || doc_id AS document_key, '# Policy ' || doc_id || chr(10) || 'preface' || chr(10) || '##  Rules of ' || source || ' '
       || chr(10) || chr(10) || text || chr(10) || '### Scope' || chr(10) || lang || chr(10) || chr(10) || '## Empty' || chr(10) || ' ' AS markdown
FROM {documents}
"""

BINDINGS["section"] = """
SELECT lang AS tenant_id, 'd' || lpad(CAST(doc_id AS STRING), 12, '0') AS document_key, source AS title,
       0 AS section_index, source AS section, text AS text
FROM {documents}
"""

BINDINGS["benchmark_query"] = """
SELECT 'q' || item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS tenant_id,
       text AS query
FROM {benchmark}
"""

BINDINGS["vector"] = """
SELECT 'g' || (label % 3) AS tenant_id, 'v' || lpad(CAST(vec_id AS STRING), 12, '0') AS chunk_id,
       CASE WHEN vec_id % 17 = 0 THEN 'old' ELSE 'model-a' END AS model_key,
       CASE WHEN vec_id % 19 = 0 THEN 'stale' ELSE 'h' || vec_id END AS content_hash, embedding AS embedding
FROM {embeddings}
"""

BINDINGS["vector_chunk"] = """
SELECT 'g' || (label % 3) AS tenant_id, 'v' || lpad(CAST(vec_id AS STRING), 12, '0') AS chunk_id,
       'k' || label AS document_key, CAST(vec_id AS INT) AS ordinal, 'h' || vec_id AS content_hash
FROM {embeddings}
"""

BINDINGS["vector_query"] = """
SELECT 'q' || vec_id AS query_id, 'g' || (label % 3) AS tenant_id, embedding AS embedding
FROM {embeddings}
"""

# Chunks that have both a text and a vector, and queries for both; some vectors are missing or switched off.
BINDINGS["hybrid_chunk"] = """
SELECT c.tenant_id, c.chunk_id, c.document_key, c.ordinal, c.content_hash, d.source AS title, d.lang AS section, d.text AS text
FROM {vector_chunk} c JOIN {documents} d ON d.doc_id = c.ordinal
"""

BINDINGS["hybrid_query"] = """
SELECT 'q' || b.item_id AS query_id, 'g' || (e.label % 3) AS tenant_id, CASE WHEN b.item_id % 9 = 4 THEN '  ' ELSE b.text END AS query,
       CASE WHEN b.item_id % 5 = 1 THEN NULL ELSE e.embedding END AS embedding, b.item_id % 10 = 1 OR b.item_id % 7 = 3 AS vector_disabled
FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id
"""

# What the hybrid queries should find: one or two documents of their tenant, or nothing.
BINDINGS["hybrid_case"] = """
SELECT 'q' || b.item_id AS id, CASE WHEN b.item_id % 4 = 0 THEN 'hard_negative' ELSE 'positive' END AS kind,
       CASE WHEN b.item_id % 4 = 0 THEN '' WHEN b.item_id % 3 = 0 THEN 'k' || e.label || '|k' || ((e.label + 3) % 9) ELSE 'k' || e.label END AS expected_document_ids
FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id
"""

# Chunks that are still published after the search.
BINDINGS["published_chunk"] = """
SELECT document_key, title, section, text FROM {hybrid_chunk} WHERE ordinal % 13 <> 5
"""

BINDINGS["eval_case"] = """
SELECT 'c' || l.doc_id AS id, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'hard_negative' END AS kind,
       CASE WHEN l.quality = 1 THEN d.source ELSE '' END AS expected_document_ids,
       CASE WHEN l.toxic = 1 THEN 'get_work_order' ELSE 'search_work_orders' END AS expected_tools,
       'the|und' AS required_facts, 'zz' AS forbidden_facts, d.text AS answer
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
"""

# Sets of cases with every kind of fault: blank and repeated fields, unknown kinds and documents, expectations that do not fit.
BINDINGS["answer_set"] = """
SELECT CASE WHEN n % 50 = 1 THEN 'twice' ELSE id END AS id,
       CASE WHEN n % 10 = 0 THEN ' ' WHEN n % 3 = 0 THEN 'knowledge' WHEN n % 3 = 1 THEN 'work_order' ELSE 'combined' END AS category,
       CASE WHEN n % 9 = 0 THEN '' ELSE 'Question ' || id END AS message
FROM (SELECT id, CAST(substring(id, 2) AS BIGINT) AS n FROM {eval_case}) numbered
"""

BINDINGS["retrieval_set"] = """
SELECT CASE WHEN n % 60 = 2 THEN 'twice' ELSE id END AS id, 'Question ' || id AS query, CASE WHEN n % 40 = 3 THEN 'other' ELSE kind END AS kind,
       CASE WHEN n % 30 = 4 THEN 'typo' WHEN n % 25 = 5 THEN 'synonym' WHEN kind = 'hard_negative' THEN 'hard_negative'
            WHEN n % 2 = 0 THEN 'synonym' ELSE 'conversational' END AS challenge,
       CASE WHEN n % 35 = 6 THEN '' ELSE expected_document_ids END AS expected_document_ids
FROM (SELECT id, kind, expected_document_ids, CAST(substring(id, 2) AS BIGINT) AS n FROM {eval_case}) numbered
"""

BINDINGS["known_document"] = """
SELECT DISTINCT source AS document_key FROM {documents} WHERE lang = 'de'
"""

# Benchmark items as policy files, some without an id, some without a title.
BINDINGS["policy_text"] = """
SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE '<!-- document_id: item-' || item_id || ' -->' || chr(10) END
                || CASE WHEN item_id % 7 = 0 THEN '' ELSE '# First' || chr(10) || '#  Item ' || item_id || ' ' || chr(10) END
                || coalesce(text, '') AS markdown
FROM {benchmark}
"""

BINDINGS["eval_citation"] = """
SELECT 'c' || doc_id AS case_id, source AS document_id FROM {documents} WHERE lang <> 'de'
UNION ALL
SELECT 'c' || (doc_id + 1) AS case_id, source AS document_id FROM {documents} WHERE n_chars > 800
"""

BINDINGS["eval_tool_call"] = """
SELECT 'c' || doc_id AS case_id, 'search_work_orders' AS name,
       CASE WHEN doc_id % 6 = 0 THEN 'error' ELSE 'success' END AS status
FROM {documents}
UNION ALL
SELECT 'c' || doc_id AS case_id, 'get_work_order' AS name, 'success' AS status
FROM {documents} WHERE lang = 'fr'
"""

BINDINGS["scan_text"] = """
SELECT 'documents' AS origin, 'd' || doc_id AS doc_id, text AS text FROM {documents}
UNION ALL SELECT 'pages' AS origin, 'p' || page_id AS doc_id, html AS text FROM {pages}
UNION ALL SELECT 'conversations' AS origin, 'c' || conv_id || '-' || turn AS doc_id, text AS text FROM {conversations}
"""

# Submitted SQL texts: legal questions and attacks, each with the caller's own literal.
BINDINGS["query_log"] = """
SELECT event_id AS id, CASE WHEN event_id % 14 < 6 THEN 'legal' ELSE 'attack' END AS kind,
       CASE event_id % 14
         WHEN 0 THEN 'SELECT work_order_no, status FROM analytics_work_order_v WHERE project_id = ''p' || user_id || ''''
         WHEN 1 THEN 'SELECT status, COUNT(*) FROM analytics_work_order_v GROUP BY status'
         WHEN 2 THEN 'select q.verdict from analytics_work_order_v w left join analytics_quality_v q on w.tenant_id = q.tenant_id'
         WHEN 3 THEN 'SELECT AVG(resolution_hours) FROM analytics_rectification_v LIMIT ' || user_id
         WHEN 4 THEN 'SELECT DATE_TRUNC(''month'', created_at) AS m FROM analytics_work_order_v GROUP BY m ORDER BY m'
         WHEN 5 THEN '  SELECT 1 FROM public.analytics_quality_v'
         WHEN 6 THEN 'UPDATE work_order SET status = ''' || event_type || ''''
         WHEN 7 THEN 'SELECT * FROM pg_catalog.pg_class'
         WHEN 8 THEN 'SELECT * FROM work_order WHERE id = ' || event_id
         WHEN 9 THEN 'SELECT pg_sleep(' || user_id || ') FROM analytics_work_order_v'
         WHEN 10 THEN 'SELECT 1; DROP TABLE work_order'
         WHEN 11 THEN 'SELECT 1 -- ' || event_type
         WHEN 12 THEN 'SELECT a FROM analytics_work_order_v UNION SELECT b FROM analytics_quality_v'
         ELSE 'SELECT * FROM pg_user' END AS sql_text
FROM {events}
"""

# What a command run left behind, per order.
BINDINGS["run_order"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS id,
       CAST(count(*) + CASE WHEN min(user_id) % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version
FROM {events} GROUP BY user_id
"""

BINDINGS["run_event"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS work_order_id, event_id AS id FROM {events}
"""

BINDINGS["run_outbox"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS aggregate_id, event_id AS id
FROM {events} WHERE NOT (event_type = 'click' AND value > 200)
"""

BINDINGS["run_proposal"] = """
SELECT 't' || (user_id % 5) AS tenant_id, 'w' || user_id AS target_id, event_id AS id
FROM {events} WHERE value <= 240
"""

BINDINGS["audit"] = """
SELECT 't' || (user_id % 5) AS tenant_id, event_id AS id,
       CASE event_type WHEN 'signup' THEN 'PYTHON_POLICY' WHEN 'view' THEN 'EXECUTED' WHEN 'click' THEN 'EXECUTED'
            WHEN 'purchase' THEN 'COST_CHECK' ELSE 'JAVA_POLICY' END AS validation_stage,
       event_type = 'view' OR event_type = 'click' AS executed,
       CAST(floor(value * 10) AS INT) AS execution_ms, CAST(event_id % 201 AS INT) AS row_count,
       event_id % 201 = 200 AS truncated
FROM {events}
"""

# Commands as submitted: action, target and JSON parameters, some of them invalid.
BINDINGS["submitted_command"] = """
SELECT 't' || n.n_regionkey AS tenant_id, 'k' || o.o_orderkey AS command_id,
       CASE o.o_orderkey % 8 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'ASSIGN' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'ACCEPT'
            WHEN 4 THEN 'START' WHEN 5 THEN 'COMPLETE' WHEN 6 THEN 'CLOSE' ELSE 'CANCEL' END AS action_type,
       CASE WHEN o.o_orderkey % 8 = 0 AND o.o_custkey % 9 <> 0 THEN NULL WHEN o.o_custkey % 23 = 0 THEN ' '
            ELSE 'WO-' || (o.o_orderkey - o.o_orderkey % 3) END AS target_work_order_no,
       CASE o.o_orderkey % 8
         WHEN 0 THEN '{{"work_order_no":"N-' || o.o_orderkey || '","title":"T","description":"D","project_id":"p' || c.c_nationkey
              || '","space_path":"S","order_type":"STANDARD","priority":"HIGH","source":"MANUAL"'
              || CASE WHEN o.o_custkey % 5 = 0 THEN '' ELSE ',"due_at":"2026-07-20T08:00:00"' END || '}}'
         WHEN 1 THEN '{{"assignee_id":"s1","assignee_name":"' || CASE WHEN o.o_custkey % 4 = 0 THEN ' ' ELSE 'Worker 1' END
              || '","reason":"shift"' || CASE WHEN o.o_custkey % 6 = 0 THEN ',"extra":1' ELSE '' END || '}}'
         WHEN 2 THEN CASE o.o_custkey % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"title":" New title "}}'
              WHEN 2 THEN '{{"due_at":"soon"}}' ELSE '{{"priority":"LOW","due_at":"2026-07-21T10:30:00"}}' END
         WHEN 7 THEN CASE WHEN o.o_custkey % 3 = 0 THEN '{{"reason":""}}' ELSE '{{"reason":" changed plans "}}' END
         ELSE CASE WHEN o.o_custkey % 10 = 0 THEN '{{"force":true}}' ELSE '{{}}' END END AS parameters
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

# Legacy rows before tenants existed, keyed by a number of 12 digits or more in the order text; an id holds 12.
BINDINGS["legacy_order"] = """
SELECT 'WO-20260718-' || lpad(CAST(o.o_orderkey AS STRING), CAST(greatest(12, length(CAST(o.o_orderkey AS STRING))) AS INT), '0') AS work_order_no, n.n_name AS project_name,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH'
            WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       CASE o.o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING_DISPATCH' ELSE 'CLOSED' END AS status,
       CASE WHEN o.o_orderkey % 10 = 8 THEN 'WO-20260718-' || lpad(CAST(o.o_orderkey - 1 AS STRING), CAST(greatest(12, length(CAST(o.o_orderkey - 1 AS STRING))) AS INT), '0') END AS root_work_order_no,
       o.o_orderdate AS created_at
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

BINDINGS["legacy_project"] = """
SELECT 'a' AS tenant_id, 'pa' || n_nationkey AS id, n_name AS name FROM {nation}
UNION ALL SELECT 'b' AS tenant_id, 'pb' || n_nationkey AS id, n_name AS name FROM {nation} WHERE n_nationkey <> 7
"""

# Number ranges per tenant: the lower and the upper half of the keys, without the first ten.
BINDINGS["legacy_range"] = """
SELECT 'a' AS tenant_id, 'WO-20260718-' || lpad('10', 12, '0') AS first_no,
       'WO-20260718-' || lpad(CAST(CAST(floor(max(o_orderkey) / 2) AS BIGINT) AS STRING), 12, '0') AS last_no
FROM {orders}
UNION ALL
SELECT 'b' AS tenant_id, 'WO-20260718-' || lpad(CAST(CAST(floor(max(o_orderkey) / 2) AS BIGINT) + 1 AS STRING), 12, '0') AS first_no,
       'WO-20260718-' || lpad(CAST(max(o_orderkey) AS STRING), 12, '0') AS last_no
FROM {orders}
"""

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def inputs_of(sql: str) -> list[str]:
    """Names in braces, in order of first use."""
    return list(dict.fromkeys(_NAME.findall(sql)))


def _naive_times(df: DataFrame) -> DataFrame:
    """Timestamp literals of the shared dialect carry a zone in Spark; the domain tables have naive times."""
    zoned = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({name: df[name].cast("timestamp_ntz") for name in zoned}) if zoned else df


class Tables:
    """Lazily built domain tables over one directory of parquet files."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BASE_TABLES:
                self._cache[name] = self._spread(name, self.spark.read.parquet(f"{self.directory}/{name}.parquet"))
            else:
                self._cache[name] = _naive_times(self.sql(BINDINGS[name]))
        return self._cache[name]

    def _spread(self, name: str, df: DataFrame) -> DataFrame:
        """Deals out a table of fewer files than cores, which one task would read otherwise.

        A table of many files is left as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if name not in SPREAD_TABLES or len(df.inputFiles()) >= cores:
            return df
        return df.repartition(cores)

    def pieces(self, name: str, size: int = 4 << 20) -> int:
        """A number of partitions that grows with the files of a base table, of about ``size`` bytes of them each."""
        plan = self.spark.read.parquet(f"{self.directory}/{name}.parquet")._jdf.queryExecution().analyzed()
        return max(self.spark.sparkContext.defaultParallelism, -(-int(str(plan.stats().sizeInBytes())) // size))

    def stamp(self, name: str) -> str:
        """Paths, sizes and times of the files of a base table."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        told = []
        for file in sorted(self.spark.read.parquet(f"{self.directory}/{name}.parquet").inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
            status = path.getFileSystem(conf).getFileStatus(path)
            told.append(f"{file} {status.getLen()} {status.getModificationTime()}")
        return "\n".join(told)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: self[name] for name in inputs_of(text)})


def with_bindings(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` as one statement: bindings named in braces become CTEs ahead of it."""
    available = {**BINDINGS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in inputs_of(text):
            if name not in BASE_TABLES and name not in ordered:
                visit(available[name])
                ordered.append(name)

    visit(sql)

    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text).replace("{{", "{").replace("}}", "}")

    if not ordered:
        return plain(sql)
    # A CTE must not carry the name of a base table it reads, and none does.
    ctes = ",\n".join(f"{name} AS ({plain(available[name])})" for name in ordered)
    return f"WITH {ctes}\n{plain(sql)}"
