"""Governed questions: structured specs, result guard and the named questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.operators import catalog
from wrenchbook.operators.catalog import CatalogError
from wrenchbook.operators.scope import scope_projects
from wrenchbook.operators.views import moment


@dataclass(frozen=True)
class Field:
    """A column of a view, or of the joined view when ``joined`` is set, with an optional function."""

    name: str
    function: str | None = None
    argument: str | None = None
    joined: bool = False
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Condition:
    field: Field
    operator: str
    value: object = None


@dataclass(frozen=True)
class Measure:
    """An aggregate over a field, or over rows when ``field`` is None, with optional row conditions."""

    function: str
    alias: str
    field: Field | None = None
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Spec:
    view: str
    select: tuple[Field, ...] = ()
    where: tuple[Condition, ...] = ()
    join: str | None = None
    group_by: tuple[Field, ...] = ()
    measures: tuple[Measure, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = field(default=())
    #: Rows that a caller is shown; None for all of them.
    limit: int | None = catalog.MAX_ROWS


_SCALARS = {
    "UPPER": lambda c, a: F.upper(c),
    "LOWER": lambda c, a: F.lower(c),
    "TRIM": lambda c, a: F.trim(c),
    "LENGTH": lambda c, a: F.length(c),
    "COALESCE": lambda c, a: F.coalesce(c, F.lit(a)),
    "DATE_TRUNC": lambda c, a: F.date_trunc(a, c).cast("timestamp_ntz"),
    "EXTRACT": lambda c, a: F.extract(F.lit(a), c),
}
_AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
_OPERATORS = {
    "=": lambda c, v: c == F.lit(v),
    "<>": lambda c, v: c != F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "in": lambda c, v: c.isin(*v),
    "between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}


class _Names:
    """Checks names and flags of one spec against the catalog and turns them into columns."""

    def __init__(self, spec: Spec):
        if spec.view not in catalog.VIEWS:
            raise CatalogError(f"unknown view: {spec.view}")
        self.spec = spec

    def entry(self, f: Field) -> catalog.Column:
        if f.joined and self.spec.join is None:
            raise CatalogError("a joined field needs a join")
        return catalog.column(self.spec.join if f.joined else self.spec.view, f.name)

    def column(self, f: Field) -> Column:
        entry = self.entry(f)
        raw = F.col(f"{'r' if f.joined else 'l'}.`{f.name}`")
        if f.function is None:
            return raw
        if f.function not in _SCALARS:
            raise CatalogError(f"function not allowed: {f.function}")
        if entry.data_type not in catalog.FUNCTIONS[f.function]:
            raise CatalogError(f"{f.function} does not take {entry.data_type}")
        return _SCALARS[f.function](raw, f.argument)

    def condition(self, c: Condition) -> Column:
        entry = self.entry(c.field)
        if not entry.filterable:
            raise CatalogError(f"not filterable: {entry.name}")
        if c.operator not in _OPERATORS:
            raise CatalogError(f"operator not allowed: {c.operator}")
        return _OPERATORS[c.operator](self.column(c.field), c.value)

    def group(self, f: Field) -> Column:
        if not self.entry(f).groupable:
            raise CatalogError(f"not groupable: {f.name}")
        return self.column(f).alias(f.label)

    def measure(self, m: Measure) -> Column:
        if m.function not in _AGGREGATES:
            raise CatalogError(f"aggregate not allowed: {m.function}")
        if m.field is None:
            if m.function != "COUNT":
                raise CatalogError(f"{m.function} needs a field")
            value: Column = F.lit(1)
        else:
            entry = self.entry(m.field)
            if entry.data_type not in catalog.FUNCTIONS[m.function]:
                raise CatalogError(f"{m.function} does not take {entry.data_type}")
            value = self.column(m.field)
        for c in m.where:
            value = F.when(self.condition(c), value)
        return _AGGREGATES[m.function](value).alias(m.alias)


ViewSource = Callable[[set[str]], DataFrame]


def _used_columns(spec: Spec, joined: bool) -> set[str]:
    fields = [*spec.select, *spec.group_by, *(c.field for c in spec.where)]
    for m in spec.measures:
        fields += [f for f in (m.field, *(c.field for c in m.where)) if f is not None]
    used = {f.name for f in fields if f.joined == joined} | {"tenant_id", "project_id"}
    if spec.join is not None:
        used |= {pair[1 if joined else 0] for pair in catalog.join_path(spec.view, spec.join).keys}
    return used


def run_spec(spec: Spec, views: Mapping[str, ViewSource], scope: DataFrame) -> DataFrame:
    """Checks a spec against the catalog and builds its DataFrame over scoped views.

    ``views`` gives for each view a function from the needed columns to its
    DataFrame. Every view is cut to the caller's projects first. A limited result
    is in a total order (ties by the other columns from the left) and has a
    ``truncated`` flag; without a limit all rows come. Nothing is parsed: a spec
    can only name catalog entries.
    """
    names = _Names(spec)
    source = scope_projects(views[spec.view](_used_columns(spec, joined=False)), scope).alias("l")
    if spec.join is not None:
        path = catalog.join_path(spec.view, spec.join)
        condition = F.lit(True)
        for left, right in path.keys:
            condition = condition & (F.col(f"l.{left}") == F.col(f"r.{right}"))
        right = scope_projects(views[spec.join](_used_columns(spec, joined=True)), scope).alias("r")
        source = source.join(right, condition, path.how)
    for c in spec.where:
        source = source.filter(names.condition(c))
    if spec.measures or spec.group_by:
        if spec.select:
            raise CatalogError("select plain fields or measures, not both")
        grouped = source.groupBy(*[names.group(f) for f in spec.group_by])
        result = grouped.agg(*[names.measure(m) for m in spec.measures]) if spec.measures else grouped.agg(F.count(F.lit(1)).alias("count"))
    else:
        if not spec.select:
            raise CatalogError("nothing selected")
        result = source.select(*[names.column(f).alias(f.label) for f in spec.select])
    ordering = []
    for label, descending in spec.order_by:
        if label not in result.columns:
            raise CatalogError(f"cannot order by {label}")
        for f in (*spec.select, *spec.group_by):
            if f.label == label and not names.entry(f).orderable:
                raise CatalogError(f"not orderable: {label}")
        ordering.append(F.col(label).desc() if descending else F.col(label).asc())
    if spec.limit is None:
        return result.orderBy(*ordering) if ordering else result
    named = {label for label, _ in spec.order_by}
    ordering += [F.col(c).asc() for c in result.columns if c not in named]
    return guard(result, ordering, limit=spec.limit, max_columns=None, max_bytes=None)


def guard(
    df: DataFrame,
    order: Sequence[Column],
    limit: int = catalog.MAX_ROWS,
    max_columns: int | None = catalog.MAX_COLUMNS,
    max_bytes: int | None = catalog.MAX_RESULT_BYTES,
) -> DataFrame:
    """The first rows within the row, column and size limits, with a ``truncated`` flag.

    The flag is set when rows or columns were dropped; None lifts a limit. A cell counts two bytes per character of its text, NULL as four characters.
    Reading one row beyond the limit tells whether rows were dropped. The
    windows run over that bounded set only.
    """
    columns = df.columns[:max_columns]
    narrowed = len(columns) < len(df.columns)
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(4)) for c in columns), F.lit(0)) * 2
    head = df.orderBy(*order).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))
    numbered = head.withColumn("_n", F.row_number().over(everything.orderBy(*order))).withColumn(
        "_bytes", F.sum(size).over(everything.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    kept = F.col("_n") <= limit
    if max_bytes is not None:
        kept = kept & (F.col("_bytes") <= max_bytes)
    flagged = numbered.withColumn("_kept", kept).withColumn("truncated", F.max(~F.col("_kept")).over(everything) | F.lit(narrowed))
    return flagged.filter("_kept").select(*columns, "truncated")


# The named questions. W, Q and X are the order, quality and rectification views.


def orders_per_status(w: DataFrame) -> DataFrame:
    return w.groupBy("status").agg(F.count("*").alias("orders"))


def orders_of_priority(w: DataFrame, priority: str = "URGENT") -> DataFrame:
    return w.filter(F.col("priority") == priority).agg(F.count("*").alias("orders"))


def busiest_project(w: DataFrame) -> DataFrame:
    return w.groupBy("project_name").agg(F.count("*").alias("orders")).orderBy(F.desc("orders"), "project_name").limit(1)


def mean_completion_hours(w: DataFrame) -> DataFrame:
    done = w.filter(F.col("status").isin(*schemas.DONE_STATUSES))
    return done.agg(F.round(F.avg("completion_hours"), 6).alias("mean_hours"))


def overdue_orders(w: DataFrame) -> DataFrame:
    return w.filter("is_overdue").select("tenant_id", "work_order_no", "status", "due_at")


def newest_orders(w: DataFrame, count: int = 10) -> DataFrame:
    return w.select("work_order_no", "status", "created_at").orderBy(F.desc("created_at"), "work_order_no").limit(count)


def orders_per_priority(w: DataFrame) -> DataFrame:
    return w.groupBy("priority").agg(F.count("*").alias("orders"))


def completion_rate(w: DataFrame, order_type: str = "EMERGENCY") -> DataFrame:
    """Share of completed orders of a type; NULL when there is none."""
    done = F.when(F.col("status").isin(*schemas.DONE_STATUSES), 1.0).otherwise(0.0)
    return w.filter(F.col("order_type") == order_type).agg(F.round(F.avg(done), 6).alias("completion_rate"))


def failed_orders(w: DataFrame, q: DataFrame, verdict: str = "FAIL") -> DataFrame:
    left = w.select("tenant_id", "work_order_no", "status")
    right = q.select("tenant_id", "work_order_no", "verdict", "inspection_round")
    return left.join(right, ["tenant_id", "work_order_no"], "left").filter(F.col("verdict") == verdict)


def pass_rate_per_project(q: DataFrame) -> DataFrame:
    passed = F.when(F.col("verdict") == "PASS", 1.0).otherwise(0.0)
    return q.groupBy("tenant_id", "project_name").agg(
        F.count("*").alias("results"), F.round(F.avg(passed), 6).alias("pass_rate")
    )


def most_high_findings(q: DataFrame, count: int = 10) -> DataFrame:
    """Orders with the most findings of high severity; unknown counts sort as zero."""
    return (
        q.groupBy("tenant_id", "work_order_no")
        .agg(F.coalesce(F.sum("high_severity_count"), F.lit(0)).alias("high_findings"))
        .orderBy(F.desc("high_findings"), "work_order_no")
        .limit(count)
    )


def closed_cases(x: DataFrame) -> DataFrame:
    return x.filter(F.col("status") == "CLOSED").agg(F.count("*").alias("cases"))


def verdicts_per_round(q: DataFrame) -> DataFrame:
    return q.groupBy("inspection_round", "verdict").agg(F.count("*").alias("results"))


def created_this_month(w: DataFrame, as_of: str | datetime) -> DataFrame:
    """A half-open range instead of a truncated column, so that the filter can be pushed down."""
    start = F.date_trunc("month", moment(as_of)).cast("timestamp_ntz")
    end = F.add_months(start, 1).cast("timestamp_ntz")
    return w.filter((F.col("created_at") >= start) & (F.col("created_at") < end)).agg(F.count("*").alias("orders"))


def orders_per_assignee(w: DataFrame) -> DataFrame:
    return w.groupBy(F.coalesce("assignee_name", F.lit("N/A")).alias("assignee")).agg(F.count("*").alias("orders"))
