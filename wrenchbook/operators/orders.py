"""Work-order lookups, search, rework chains and message routing."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.scalars import lookup as fixed_value
from wrenchbook.operators.scope import scope_projects

# Word lists and patterns of the message router.
ORDER_NUMBER = r"(?i)WO-\p{Nd}{8}-\p{Nd}{3}"
ASSIGNEE_OF = r"([一-龥]{2,3})的工单"
EXPLANATION_TERMS = ("为什么", "怎么处理", "如何处理", "规则", "制度", "要求", "依据")
QUERY_TERMS = ("查询", "查一下", "列出", "有哪些")
ORDER_TERM = "工单"
STATUS_TERMS = ("待派单", "待接单", "处理中", "已完成", "已关闭", "紧急工单")
STATUS_WORDS = {
    "待派单": "PENDING_DISPATCH",
    "待接单": "PENDING_ACCEPTANCE",
    "处理中": "PROCESSING",
    "已完成": "COMPLETED",
    "已关闭": "CLOSED",
}
PRIORITY_WORDS = {"紧急": "URGENT", "高优先级": "HIGH", "中优先级": "MEDIUM", "低优先级": "LOW"}
PROJECT_NAMES = ("星河中心", "云帆园区", "海棠公寓")
REWORK_TERM = "返工"
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100


def lookup(requests: DataFrame, orders: DataFrame, scope: DataFrame) -> DataFrame:
    """Answer requested numbers; an order out of scope looks like a missing one."""
    visible = scope_projects(orders, scope).select(
        "tenant_id", "work_order_no", F.col("id").alias("work_order_id"), "status", "project_id"
    )
    return requests.join(visible, ["tenant_id", "work_order_no"], "left").withColumn(
        "outcome", F.when(F.col("work_order_id").isNull(), "NOT_FOUND").otherwise("FOUND")
    )


@dataclass(frozen=True)
class SearchCriteria:
    """Optional equalities and an inclusive creation range; blank text is ignored."""

    status: str | None = None
    priority: str | None = None
    project_name: str | None = None
    assignee_name: str | None = None
    created_from: datetime | None = None
    created_to: datetime | None = None


@dataclass(frozen=True)
class SearchPage:
    """One page: the rows, and one row with total, page, size and page count."""

    items: DataFrame
    summary: DataFrame


def matching(orders: DataFrame, scope: DataFrame, criteria: SearchCriteria) -> DataFrame:
    """All scoped orders that satisfy the criteria; the filters reach the scan."""
    found = orders
    for column in ("status", "priority", "project_name", "assignee_name"):
        wanted = getattr(criteria, column)
        if wanted is not None and wanted.strip():
            found = found.filter(F.col(column) == F.lit(wanted))
    if criteria.created_from is not None:
        found = found.filter(F.col("created_at") >= F.lit(criteria.created_from).cast("timestamp_ntz"))
    if criteria.created_to is not None:
        found = found.filter(F.col("created_at") <= F.lit(criteria.created_to).cast("timestamp_ntz"))
    return scope_projects(found, scope)


def search(
    orders: DataFrame,
    scope: DataFrame,
    criteria: SearchCriteria = SearchCriteria(),
    page: int = 0,
    size: int = DEFAULT_PAGE_SIZE,
) -> SearchPage:
    """Newest first, zero-based pages; the id makes the page order total."""
    if page < 0 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page must not be negative and size must be between 1 and 100")
    found = matching(orders, scope, criteria)
    items = found.orderBy(F.col("created_at").desc(), F.col("id")).offset(page * size).limit(size)
    summary = found.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        F.ceil(F.col("total") / F.lit(size)).cast("long").alias("total_pages"),
    )
    return SearchPage(items, summary)


def rework_chain(requests: DataFrame, orders: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of the requested chains: the root and every visible order that points to it.

    The root must be visible itself, or the whole chain is hidden. Sort by
    request and creation time when the order matters.
    """
    visible = scope_projects(orders, scope)
    own = F.coalesce("root_work_order_id", "id")
    wanted = (
        requests.join(
            visible.select("tenant_id", "work_order_no", own.alias("root_id")), ["tenant_id", "work_order_no"]
        )
        .select("request_id", "tenant_id", "root_id")
        .join(visible.select("tenant_id", F.col("id").alias("root_id")), ["tenant_id", "root_id"], "left_semi")
    )
    # An order belongs to its own chain and to the chain of its root.
    members = visible.select(
        "tenant_id",
        F.explode(F.array_distinct(F.array_compact(F.array("id", "root_work_order_id")))).alias("root_id"),
        F.col("id").alias("member_id"),
        F.col("work_order_no").alias("member_no"),
        "status",
        "created_at",
    )
    return wanted.join(members, ["tenant_id", "root_id"])


def chain_stats(orders: DataFrame) -> DataFrame:
    """Per root: number of orders, of unfinished ones, and the time span."""
    return (
        orders.groupBy("tenant_id", F.coalesce("root_work_order_id", "id").alias("root_id"))
        .agg(
            F.count("*").alias("orders"),
            F.count_if(~F.col("status").isin(*schemas.FINAL_STATUSES)).alias("open_orders"),
            F.min("created_at").alias("first_created_at"),
            F.max("created_at").alias("last_created_at"),
        )
    )


def _has_any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def _first_word(text: Column, words: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.contains(word), F.lit(value)) for word, value in words.items()])


def route(message: Column) -> Column:
    """combined, work_order or knowledge, decided by number, terms and verbs."""
    has_number = message.rlike(ORDER_NUMBER)
    asks = _has_any(message, QUERY_TERMS) & (message.contains(ORDER_TERM) | _has_any(message, STATUS_TERMS))
    return (
        F.when(has_number & _has_any(message, EXPLANATION_TERMS), "combined")
        .when(has_number | asks, "work_order")
        .otherwise("knowledge")
    )


def _optional(extracted: Column) -> Column:
    return F.nullif(extracted, F.lit(""))


def extract_filters(messages: DataFrame) -> DataFrame:
    """Adds route, order number, status, priority, project and assignee slots.

    The slots come out of a generator of one row. A filter on a slot would be
    pushed below a plain projection, with the patterns of all slots behind it
    written out again in every condition, until the code is too long to compile.
    """
    text = F.col("message")
    slots = F.struct(
        route(text).alias("route"),
        F.upper(_optional(F.regexp_extract(text, ORDER_NUMBER, 0))).alias("work_order_no"),
        _first_word(text, STATUS_WORDS).alias("status_filter"),
        _first_word(text, PRIORITY_WORDS).alias("priority_filter"),
        _first_word(text, {name: name for name in PROJECT_NAMES}).alias("project_filter"),
        _optional(F.regexp_extract(text, ASSIGNEE_OF, 1)).alias("assignee_filter"),
    )
    return messages.select("*", F.inline(F.array(slots)))


def select_tool(messages: DataFrame) -> DataFrame:
    """The tool that answers each routed message; knowledge messages need none."""
    slots = extract_filters(messages)
    number = F.col("work_order_no").isNotNull()
    chain = number & ((F.col("route") == "combined") | F.col("message").contains(REWORK_TERM))
    return slots.withColumn(
        "tool",
        F.when(F.col("route") == "knowledge", None)
        .when(chain, "get_rework_chain")
        .when(number, "get_work_order")
        .otherwise("search_work_orders"),
    )


def answer_requests(messages: DataFrame, orders: DataFrame, scope: DataFrame, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row per message and order that answers it, by the selected tool.

    Searches return the newest ``page_size`` orders of the message's tenant, as
    the first page of the search does. Messages share few distinct filters, so
    a page is computed once per distinct filter and joined back. Each order is
    of one cell (status, priority, project, assignee), and one that is on the page
    of any filter is among the newest ``page_size`` of its cell: one pass over the
    orders keeps those, with a limit per task before the shuffle, and the pages of all
    filters are put together from the cells.
    """
    chosen = select_tool(messages)
    visible = scope_projects(orders, scope)
    keys = ["message_id", "tenant_id", "tool"]

    by_number = chosen.filter(F.col("tool") == "get_work_order").select(*keys, "work_order_no").join(
        visible.select("tenant_id", "work_order_no", F.col("id").alias("work_order_id"), "status"),
        ["tenant_id", "work_order_no"],
    ).select(*keys, "work_order_id", "status")

    by_chain = rework_chain(
        chosen.filter(F.col("tool") == "get_rework_chain").select(
            F.struct("message_id", "tool").alias("request_id"), "tenant_id", "work_order_no"
        ),
        orders,
        scope,
    ).select("request_id.message_id", "tenant_id", "request_id.tool", F.col("member_id").alias("work_order_id"), "status")

    searches = chosen.filter(F.col("tool") == "search_work_orders")
    slots = {
        "status_filter": "status",
        "priority_filter": "priority",
        "project_filter": "project_name",
        "assignee_filter": "assignee_name",
    }
    used = sum((F.when(F.col(slot).isNotNull(), 1 << at).otherwise(0) for at, slot in enumerate(slots)), F.lit(0))
    filters = searches.select("tenant_id", *slots).distinct().withColumn("_used", used)
    # Which slots are filled together: at most sixteen combinations per tenant. The newest of a cell meet the filters
    # of each combination by equality of the filled slots, so they never meet a filter that they do not match.
    combinations = filters.select("tenant_id", "_used").distinct()
    in_cell = Window.partitionBy("tenant_id", *slots.values()).orderBy(F.col("created_at").desc(), F.col("id"))
    cells = (
        visible.join(searches.select("tenant_id").distinct(), "tenant_id", "left_semi")
        .select("tenant_id", *slots.values(), "created_at", "id")
        .withColumn("_position", F.row_number().over(in_cell))
        .filter(F.col("_position") <= page_size)
    )
    keyed = cells.join(combinations, "tenant_id").select(
        "tenant_id", "_used", "status", "priority", "project_name", "assignee_name", "created_at", F.col("id").alias("work_order_id")
    ).select(
        "tenant_id", "_used", "work_order_id", "status", "created_at",
        *[
            F.when(F.col("_used").bitwiseAND(1 << at) != 0, F.col(column)).alias(slot)
            for at, (slot, column) in enumerate(slots.items())
        ],
    )
    match = (F.col("f.tenant_id") == F.col("o.tenant_id")) & (F.col("f._used") == F.col("o._used"))
    for slot in slots:
        match = match & F.col(f"f.{slot}").eqNullSafe(F.col(f"o.{slot}"))
    newest = Window.partitionBy("tenant_id", *slots).orderBy(F.col("created_at").desc(), F.col("work_order_id"))
    pages = (
        keyed.alias("o")
        .join(filters.alias("f"), match)
        .select("f.tenant_id", *[f"f.{slot}" for slot in slots], "o.work_order_id", "o.status", "o.created_at")
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= page_size)
    )
    same = F.col("s.tenant_id") == F.col("p.tenant_id")
    for slot in slots:
        same = same & F.col(f"s.{slot}").eqNullSafe(F.col(f"p.{slot}"))
    by_search = searches.alias("s").join(pages.alias("p"), same).select(
        "s.message_id", "s.tenant_id", "s.tool", "p.work_order_id", "p.status"
    )
    return by_number.unionByName(by_chain).unionByName(by_search)


def event_type(action: Column) -> Column:
    """Event name of an executed action, NULL for an unknown one."""
    return fixed_value(schemas.EVENT_TYPES, action)
