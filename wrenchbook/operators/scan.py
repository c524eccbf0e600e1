"""Scan of texts for sensitive patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that must not occur in published texts. Names of one's
# own company or product belong into a caller's list.
DEFAULT_PATTERNS = (
    ("Private paths", r"C:\\Projects\\java\\"),
    ("Private paths", r"C:\\Projects\\private\\"),
    ("Private paths", r"C:\\Users\\.*\\Documents\\"),
    ("Private paths", r"/home/.*\/\.ssh/"),
    ("API keys/tokens", r"sk-[a-zA-Z0-9]{20,}"),
    ("API keys/tokens", r"AKIA[0-9A-Z]{16}"),
    ("API keys/tokens", r"ghp_[a-zA-Z0-9]{36}"),
    ("API keys/tokens", r"Bearer\s+[a-zA-Z0-9\-._~+/]+=*"),
    ("API keys/tokens", r"""password\s*[:=]\s*["'][^"']{8,}"""),
    ("API keys/tokens", r"""secret\s*[:=]\s*["'][^"']{8,}"""),
    ("Private hostnames", r"192\.168\.\d+\.\d+"),
    ("Private hostnames", r"10\.\d+\.\d+\.\d+"),
    ("Private hostnames", r"172\.(1[6-9]|2[0-9]|3[01])\.\d+\.\d+"),
    ("Private hostnames", r"localhost:\d{4,5}(?!8080|8000|5432)"),
    ("Private hostnames", r"\.internal\."),
    ("Private hostnames", r"\.corp\."),
    ("Private hostnames", r"\.local"),
    ("Company identifiers", "卓越"),
    ("Company identifiers", "某公司"),
    ("Company identifiers", "某某企业"),
    ("Company identifiers", "真实客户"),
    ("Company identifiers", "生产环境"),
)

# Personal data that public text corpora carry.
PERSONAL_PATTERNS = (
    ("Personal data", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("Personal data", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("Personal data", r"\+?\d[\d ()-]{7,}\d"),
    ("Personal data", r"\b(?:\d[ -]?){13,16}\b"),
)


#: Escapes that stand for a class or a place; others with a letter or digit are not read.
_CLASS_ESCAPES = "dDsSwWbBAzZGhHvVRtnrfae"


def required_text(pattern: str) -> str | None:
    """The longest text that every match of ``pattern`` contains, in lower case, or None if none is plain to see.

    Groups, classes and optional characters are left out; a choice at the top level and patterns with flags have no such text.
    """
    if re.search(r"\(\?[a-zA-Z]|\\Q", pattern):
        return None
    runs, run, at, depth = [], "", 0, 0
    while at < len(pattern):
        char, step, literal = pattern[at], 1, ""
        if char == "\\":
            step, escaped = 2, pattern[at + 1 : at + 2]
            if escaped.isalnum() and escaped not in _CLASS_ESCAPES:
                return None
            literal = "" if escaped.isalnum() else escaped
        elif char == "[":
            end = at + 2 if pattern[at + 1 : at + 2] != "^" else at + 3
            while end < len(pattern) and pattern[end] != "]":
                if pattern[end] in "[&":
                    return None
                end += 2 if pattern[end] == "\\" else 1
            step = end + 1 - at
        elif char == "|" and not depth:
            return None
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "{":
            step = pattern.index("}", at) + 1 - at
        elif char not in "^$.*+?|":
            literal = char
        at += step
        if literal and not depth:
            if pattern[at : at + 1] in ("?", "*", "{"):
                literal = ""
            else:
                run += literal
        if not literal or depth or pattern[at : at + 1] == "+":
            runs.append(run)
            run = ""
    return max([*runs, run], key=len).lower() or None


def scan(docs: DataFrame, patterns: Sequence[tuple[str, str]] = DEFAULT_PATTERNS, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per line and pattern that matches, ignoring case.

    The texts are read once and nothing is shuffled. A pattern is tried only on
    lines that contain the text which it requires. The generator is an outer one,
    since Spark repeats what goes into an inner one in a filter before it.
    """
    lines = docs.select(*key, F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("_at", "line")).withColumn("_low", F.lower("line"))

    def hit(category: str, pattern: str) -> Column:
        matches, needed = F.col("line").rlike(f"(?i){pattern}"), required_text(pattern)
        if needed is not None:
            matches = F.contains(F.col("_low"), F.lit(needed)) & matches
        return F.when(matches, F.struct(F.lit(category).alias("category"), F.lit(pattern).alias("pattern")))

    found = F.array_compact(F.array(*[hit(category, pattern) for category, pattern in patterns]))
    return (
        lines.select(*key, (F.col("_at") + 1).alias("line_no"), F.explode_outer(found).alias("_hit"))
        .where("_hit IS NOT NULL")
        .select(*key, "line_no", "_hit.category", "_hit.pattern")
    )


def scan_summary(docs: DataFrame, hits: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Number of texts, hits and failing texts; the scan fails when there is any hit."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    texts = docs.select(one.alias("texts"), zero.alias("hits"), zero.alias("failing_texts"))
    failing = hits.groupBy(*key).agg(F.count("*").alias("hits")).select(
        zero.alias("texts"), "hits", one.alias("failing_texts")
    )
    return (
        texts.unionByName(failing)
        .agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("texts", "hits", "failing_texts")])
        .withColumn("passed", F.col("hits") == 0)
    )
