"""Screening of submitted SQL texts. A lexical report, not an execution gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.operators.catalog import FUNCTIONS, VIEWS

# Patterns and names that a submitted text must not contain.
INJECTION_PATTERNS = (
    r";\s*\w",
    r"--",
    r"(?s)/\*.*?\*/",
    r"(?i)\bUNION\s+ALL\s+SELECT\b",
    r"(?i)\bINTO\s+(OUTFILE|DUMPFILE)\b",
    r"(?i)\bLOAD_FILE\s*\(",
)
BLOCKED_FUNCTIONS = (
    "pg_sleep", "pg_terminate_backend", "pg_cancel_backend", "lo_import", "lo_export", "dblink",
    "dblink_connect", "dblink_exec", "dblink_open", "dblink_close", "pg_read_file", "pg_write_file",
    "pg_read_binary_file", "copy", "copy_to", "copy_from",
)
BLOCKED_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
SYSTEM_TABLE_PREFIX = "pg_"
# Words that may stand before an opening bracket without being a function.
KEYWORDS = (
    "SELECT", "FROM", "JOIN", "ON", "WHERE", "AND", "OR", "NOT", "IN", "IS", "LIKE", "BETWEEN", "EXISTS", "ANY",
    "ALL", "SOME", "CASE", "WHEN", "THEN", "ELSE", "IF", "NULLIF", "CAST", "AS", "BY", "HAVING", "FILTER", "VALUES",
    "INTERVAL", "DATE", "TIMESTAMP",
)

STRING_LITERAL = r"'(?:[^']|'')*'"
FROM_IN_FUNCTION = r"(?i)\b(extract|trim|substring)\s*\([^()]*?\bfrom\b"
FROM_LIST = r"(?i)\bfrom\s+([\w.]+(?:\s+(?:as\s+)?\w+)?(?:\s*,\s*[\w.]+(?:\s+(?:as\s+)?\w+)?)*)"
JOIN_NAME = r"(?i)\bjoin\s+([\w.]+)"
CALLED_NAME = r"(\w+)\s*\("


def _referenced_relations(code: Column) -> Column:
    lists = F.regexp_extract_all(code, F.lit(FROM_LIST), F.lit(1))
    listed = F.flatten(F.transform(lists, lambda part: F.split(part, r"\s*,\s*")))
    first_words = F.transform(listed, lambda item: F.lower(F.regexp_extract(item, r"^([\w.]+)", 1)))
    joined = F.transform(F.regexp_extract_all(code, F.lit(JOIN_NAME), F.lit(1)), F.lower)
    return F.concat(first_words, joined)


def screen_queries(log: DataFrame, text: str = "sql_text") -> DataFrame:
    """Adds ``stage``, ``reason`` (of the first failing check) and ``allowed``."""
    raw = F.col(text)
    # Literals hold data, not code; a FROM inside a function names no relation.
    code = F.regexp_replace(F.regexp_replace(raw, STRING_LITERAL, "''"), FROM_IN_FUNCTION, "$1(")
    prepared = log.withColumn("_relations", _referenced_relations(code)).withColumn(
        "_calls", F.transform(F.regexp_extract_all(code, F.lit(CALLED_NAME), F.lit(1)), F.upper)
    )
    injected = F.lit(False)
    for pattern in INJECTION_PATTERNS:
        injected = injected | raw.rlike(pattern)
    relations, calls = F.col("_relations"), F.col("_calls")
    views = F.array(*[F.lit(v) for v in VIEWS])
    blocked_calls = F.array(*[F.lit(f.upper()) for f in BLOCKED_FUNCTIONS])
    known_calls = F.array(*[F.lit(f) for f in (*FUNCTIONS, *KEYWORDS)])
    in_blocked_schema = F.exists(relations, lambda r: F.substring_index(r, ".", 1).isin(*BLOCKED_SCHEMAS) & r.contains("."))
    system_table = F.exists(relations, lambda r: F.substring_index(r, ".", -1).startswith(SYSTEM_TABLE_PREFIX))
    unknown_view = F.exists(
        relations, lambda r: ~F.array_contains(views, F.regexp_replace(r, r"^public\.", ""))
    )
    reason = (
        F.when(injected, "blocked_pattern")
        .when(~raw.rlike(r"(?i)^\s*(select|with)\b"), "not_select")
        .when(code.rlike(r"(?i)\b(union|intersect|except)\b"), "set_operation")
        .when(in_blocked_schema, "system_schema")
        .when(system_table, "system_table")
        .when(unknown_view, "unknown_view")
        .when(F.arrays_overlap(calls, blocked_calls), "blocked_function")
        .when(F.size(F.array_except(calls, known_calls)) > 0, "unknown_function")
    )
    return (
        prepared.withColumn("reason", reason)
        .withColumn("allowed", F.col("reason").isNull())
        .withColumn("stage", F.when(F.col("allowed"), "PASSED").when(F.col("reason") == "not_select", "PARSE").otherwise("POLICY"))
        .drop("_relations", "_calls")
    )


def screen_report(screened: DataFrame) -> DataFrame:
    """Per kind of statement: how many were blocked and how many passed; a passed attack is a leak."""
    return screened.groupBy("kind").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("allowed")).alias("blocked"),
        F.count_if(F.col("allowed")).alias("passed"),
        F.count_if(F.col("allowed") & (F.col("kind") == "attack")).alias("leaked"),
    )
