"""Semantic catalog: the views, columns, functions and join paths open to questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wrenchbook import schemas

CATALOG_VERSION = "1.0.0"
MAX_ROWS = 200
MAX_COLUMNS = 50
MAX_RESULT_BYTES = 1_048_576

WORK_ORDER_VIEW = "analytics_work_order_v"
QUALITY_VIEW = "analytics_quality_v"
RECTIFICATION_VIEW = "analytics_rectification_v"


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    synonyms: tuple[str, ...] = ()
    enum_values: tuple[str, ...] = ()
    filterable: bool = True
    groupable: bool = True
    orderable: bool = True


@dataclass(frozen=True)
class JoinPath:
    left: str
    right: str
    how: str
    keys: tuple[tuple[str, str], ...]


def _key(name: str) -> Column:
    return Column(name, "uuid", filterable=False, groupable=False)


# Column names, types and synonyms of the three views. The
# enumerations are those that occur in the data.
VIEWS: dict[str, tuple[Column, ...]] = {
    WORK_ORDER_VIEW: (
        _key("id"),
        _key("tenant_id"),
        Column("project_id", "uuid", ("项目",)),
        Column("work_order_no", "varchar", ("编号", "工单号")),
        Column("title", "varchar", ("标题",)),
        Column("project_name", "varchar", ("项目名",)),
        Column("order_type", "varchar", ("类型",), ("STANDARD", "EMERGENCY", "REWORK")),
        Column("priority", "varchar", ("紧急程度",), ("URGENT", "HIGH", "MEDIUM", "LOW")),
        Column("status", "varchar", ("工单状态",), schemas.STATUSES),
        Column("source", "varchar", ("渠道",), ("PLAN", "MANUAL", "INSPECTION", "AI_QUALITY")),
        Column("assignee_name", "varchar", ("处理人", "经办人")),
        Column("root_work_order_no", "varchar", ("关联工单",)),
        Column("created_at", "timestamp", ("创建日期",)),
        Column("due_at", "timestamp", ("截止日期", "截止")),
        Column("accepted_at", "timestamp"),
        Column("completed_at", "timestamp", ("完成日期",)),
        Column("cancelled_at", "timestamp"),
        Column("completion_hours", "numeric", ("处理时长", "耗时")),
        Column("is_overdue", "boolean", ("超期", "逾期")),
    ),
    QUALITY_VIEW: (
        _key("id"),
        _key("tenant_id"),
        Column("project_id", "uuid"),
        _key("work_order_id"),
        Column("work_order_no", "varchar", ("编号",)),
        Column("work_order_title", "varchar"),
        Column("project_name", "varchar"),
        Column("verdict", "varchar", ("结果", "判定"), schemas.VERDICTS),
        Column("confidence", "numeric"),
        Column("inspection_round", "integer", ("轮次",)),
        Column("generated_at", "timestamp", ("检查时间",)),
        Column("model_provider", "varchar"),
        Column("model_name", "varchar"),
        Column("prompt_version", "varchar"),
        Column("model_latency_ms", "integer"),
        Column("finding_count", "bigint", ("问题数",)),
        Column("high_severity_count", "bigint"),
        Column("medium_severity_count", "bigint"),
        Column("low_severity_count", "bigint"),
    ),
    RECTIFICATION_VIEW: (
        _key("id"),
        _key("tenant_id"),
        Column("project_id", "uuid"),
        _key("original_work_order_id"),
        Column("original_work_order_no", "varchar", ("工单编号",)),
        Column("original_work_order_title", "varchar"),
        Column("project_name", "varchar"),
        _key("rectification_work_order_id"),
        Column("rectification_work_order_no", "varchar"),
        Column("current_verdict", "varchar", ("判定",), ("PASS", "FAIL", "UNCERTAIN")),
        Column("inspection_round", "integer", ("轮次",)),
        Column("status", "varchar", ("状态",), ("PROPOSED", "RECTIFYING", "RECHECKING", "CLOSED")),
        Column("created_at", "timestamp"),
        Column("closed_at", "timestamp"),
        Column("resolution_hours", "numeric", ("处理时长",)),
    ),
}

# The joins a question may use.
JOIN_PATHS = (
    JoinPath(WORK_ORDER_VIEW, QUALITY_VIEW, "left", (("tenant_id", "tenant_id"), ("work_order_no", "work_order_no"))),
    JoinPath(
        WORK_ORDER_VIEW,
        RECTIFICATION_VIEW,
        "left",
        (("tenant_id", "tenant_id"), ("work_order_no", "original_work_order_no")),
    ),
)

_COUNTED = ("uuid", "varchar", "integer", "bigint", "boolean", "timestamp")
_NUMBERS = ("integer", "bigint", "numeric")
_ORDERED = ("integer", "bigint", "numeric", "varchar", "timestamp")

# Functions a question may use, with the types they take.
FUNCTIONS: dict[str, tuple[str, ...]] = {
    "COUNT": _COUNTED,
    "SUM": _NUMBERS,
    "AVG": _NUMBERS,
    "MIN": _ORDERED,
    "MAX": _ORDERED,
    "COALESCE": ("uuid", "varchar", "integer", "bigint", "numeric", "boolean", "timestamp"),
    "DATE_TRUNC": ("timestamp",),
    "EXTRACT": ("timestamp",),
    "UPPER": ("varchar", "text"),
    "LOWER": ("varchar", "text"),
    "TRIM": ("varchar", "text"),
    "LENGTH": ("varchar", "text"),
}

_SPARK_TYPES = {
    "uuid": ("string",),
    "varchar": ("string",),
    "text": ("string",),
    "integer": ("int", "bigint"),
    "bigint": ("bigint",),
    "numeric": ("double", "decimal"),
    "boolean": ("boolean",),
    "timestamp": ("timestamp_ntz", "timestamp"),
}


class CatalogError(ValueError):
    """A name that the catalog does not know, or a use that it does not allow."""


def column(view: str, name: str) -> Column:
    if view not in VIEWS:
        raise CatalogError(f"unknown view: {view}")
    for candidate in VIEWS[view]:
        if candidate.name == name:
            return candidate
    raise CatalogError(f"unknown column: {view}.{name}")


def resolve(view: str, word: str) -> Column:
    """A column by its name or by one of its synonyms."""
    for candidate in VIEWS.get(view, ()):
        if word == candidate.name or word in candidate.synonyms:
            return candidate
    raise CatalogError(f"unknown column or synonym: {view}.{word}")


def join_path(left: str, right: str) -> JoinPath:
    for path in JOIN_PATHS:
        if (path.left, path.right) == (left, right):
            return path
    raise CatalogError(f"no join path from {left} to {right}")


def catalog_df(spark: SparkSession) -> DataFrame:
    """The catalog as rows, one per column."""
    rows = [
        (CATALOG_VERSION, view, position, c.name, c.data_type, list(c.synonyms), list(c.enum_values), c.filterable, c.groupable, c.orderable)
        for view, columns in VIEWS.items()
        for position, c in enumerate(columns)
    ]
    return spark.createDataFrame(
        rows,
        "version string, view string, position int, column string, data_type string, synonyms array<string>, "
        "enum_values array<string>, filterable boolean, groupable boolean, orderable boolean",
    )


def schema_mismatches(view: str, df: DataFrame) -> list[str]:
    """Differences between a view's DataFrame and its catalog entry, from the schema alone."""
    actual = {f.name: f.dataType.simpleString().split("(")[0] for f in df.schema.fields}
    expected = {c.name: _SPARK_TYPES[c.data_type] for c in VIEWS[view]}
    problems = [f"missing column {name}" for name in expected if name not in actual]
    problems += [f"extra column {name}" for name in actual if name not in expected]
    problems += [
        f"type of {name} is {actual[name]}" for name in expected if name in actual and actual[name] not in expected[name]
    ]
    return problems


def project_safe(df: DataFrame, view: str) -> DataFrame:
    """Only the columns that the catalog lists for the view, in its order."""
    return df.select(*[c.name for c in VIEWS[view]])
