"""Evaluation sets: reader and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchbook.functions.text import is_blank
from wrenchbook.schemas import EVALUATION_CASE, RETRIEVAL_CASE

# What an evaluation set must cover.
CATEGORY_COUNTS = {"knowledge": 10, "work_order": 10, "combined": 10}
KINDS = ("positive", "hard_negative")
CHALLENGES = ("synonym", "conversational", "keyword_absent", "hard_negative")
MIN_RETRIEVAL_CASES = 30


def read_cases(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """A JSON list of ``answer`` or ``retrieval`` cases; with ``lines`` one case per line, which many tasks can read.

    Text that is no case comes out as a case of nulls, which the checks report.
    """
    schemas = {"answer": EVALUATION_CASE, "retrieval": RETRIEVAL_CASE}
    if kind not in schemas:
        raise ValueError("kind must be answer or retrieval")
    return spark.read.schema(schemas[kind]).option("multiLine", not lines).json(path)


def _violation(df: DataFrame, reason: str, detail: str = "id") -> DataFrame:
    return df.select(F.lit(reason).alias("reason"), F.col(detail).cast("string").alias("detail"))


def _repeated(cases: DataFrame) -> DataFrame:
    return _violation(cases.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated_id")


def check_answer_cases(cases: DataFrame) -> DataFrame:
    """Violations of an answer set: blank fields, repeated ids, wrong counts per category."""
    blank = cases.filter(is_blank(F.col("id")) | is_blank(F.col("category")) | is_blank(F.col("message")))
    expected = cases.sparkSession.createDataFrame(list(CATEGORY_COUNTS.items()), "category string, expected long")
    counted = cases.groupBy("category").agg(F.count("*").alias("n"))
    wrong = expected.join(counted, "category", "full").filter(~F.col("expected").eqNullSafe(F.col("n")))
    return _violation(blank, "blank_field").unionByName(_repeated(cases)).unionByName(
        _violation(wrong, "category_count", "category")
    )


def check_retrieval_cases(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Violations of a retrieval set against the known documents (document_key)."""
    size = F.coalesce(F.size("expected_document_ids"), F.lit(0))
    positive = F.col("kind") == "positive"
    wrong_kind = cases.filter(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))
    wrong_challenge = cases.filter(~F.coalesce(F.col("challenge").isin(*CHALLENGES), F.lit(False)))
    mismatch = cases.filter(positive != (F.col("challenge") != "hard_negative"))
    expectation = cases.filter(positive != (size > 0))
    unknown = (
        cases.select("id", F.explode("expected_document_ids").alias("document_key"))
        .join(documents.select("document_key"), "document_key", "left_anti")
    )
    challenges = cases.sparkSession.createDataFrame([(c,) for c in CHALLENGES], "challenge string")
    uncovered = challenges.join(cases, "challenge", "left_anti")
    total = cases.agg(F.count("*").alias("n")).filter(F.col("n") < MIN_RETRIEVAL_CASES)
    found = _violation(wrong_kind, "kind")
    for df, reason, detail in (
        (wrong_challenge, "challenge", "id"),
        (mismatch, "kind_and_challenge", "id"),
        (expectation, "expectation", "id"),
        (unknown, "unknown_document", "id"),
        (uncovered, "uncovered_challenge", "challenge"),
        (total, "too_few_cases", "n"),
    ):
        found = found.unionByName(_violation(df, reason, detail))
    return found.unionByName(_repeated(cases))
