"""Evaluation: recall, citation validity, tools, facts, gates and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.functions.scalars import ratio
from wrenchbook.functions.text import content_hash, is_blank, strip
from wrenchbook.operators.retrieve import CITATIONS, DEGRADED
from wrenchbook.sources.policies import TITLE

# Acceptance gates as (metric, smallest value).
ANSWER_GATES = (
    ("successful_request_rate", 1.0),
    ("retrieval_recall_at_5", 0.80),
    ("citation_validity", 0.90),
    ("tool_accuracy", 1.0),
    ("required_fact_accuracy", 1.0),
    ("forbidden_fact_accuracy", 1.0),
)
RETRIEVAL_GATES = (
    ("successful_request_rate", 1.0),
    ("hybrid_recall_at_5", 0.90),
    ("citation_validity", 0.95),
    ("hard_negative_accuracy", 1.0),
)


def _counts(citations: DataFrame, name: str) -> DataFrame:
    return citations.groupBy("case_id").agg(F.count("*").alias(name))


def case_recall(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """Per case: expected and found documents, citations, and whether all were found.

    A case without expectations is hit when nothing is cited. ``cases`` has (id,
    expected_document_ids array), ``citations`` has (case_id, document_id).
    """
    expected = cases.select(F.col("id").alias("case_id"), F.explode(F.array_distinct("expected_document_ids")).alias("document_id"))
    found = _counts(expected.join(citations.select("case_id", "document_id"), ["case_id", "document_id"], "left_semi"), "hits")
    zero = F.lit(0).cast("long")
    return (
        cases.select(F.col("id").alias("case_id"), F.size(F.array_distinct("expected_document_ids")).cast("long").alias("expected"))
        .join(found, "case_id", "left")
        .join(_counts(citations, "citations"), "case_id", "left")
        .withColumn("hits", F.coalesce("hits", zero))
        .withColumn("citations", F.coalesce("citations", zero))
        .withColumn("hit", F.when(F.col("expected") > 0, F.col("hits") == F.col("expected")).otherwise(F.col("citations") == 0))
    )


def recall(per_case: DataFrame) -> DataFrame:
    """Recall over all expected documents, not the mean over cases."""
    return per_case.agg(
        F.count("*").alias("cases"), F.sum("hits").alias("hits"), F.sum("expected").alias("expected"),
        F.count_if("hit").alias("hit_cases"),
    ).withColumn("recall_at_5", ratio(F.col("hits"), F.col("expected")))


def policy_sections(policies: DataFrame) -> DataFrame:
    """(document_id, title, section, body) of every H2 section; of equal headings the first counts."""
    parts = F.split("markdown", r"(?m)^(?=##[^\S\n]+\S)")
    split_up = policies.select(
        F.col("document_key").alias("document_id"),
        strip(F.regexp_extract("markdown", TITLE, 1)).alias("title"),
        F.posexplode(parts).alias("position", "part"),
    ).filter(F.col("part").rlike(r"^##[^\S\n]+\S"))
    named = split_up.select(
        "document_id", "title", "position",
        strip(F.regexp_extract("part", r"^##\s+([^\n]+)", 1)).alias("section"),
        F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"),
    )
    first = named.groupBy("document_id", "title", "section").agg(F.min_by("body", "position").alias("body"))
    return first


def citation_validity(citations: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``valid``: the document and title exist and the quote stands in that section."""
    fields = ("document_id", "title", "section", "quote")
    given = citations
    for name in fields:
        given = given.withColumn(name, strip(F.col(name)))
    known = policy_sections(policies).withColumnRenamed("title", "_title")
    blank = F.lit(False)
    for name in fields:
        blank = blank | is_blank(F.col(name))
    valid = ~blank & (F.col("title") == F.col("_title")) & F.contains(F.col("body"), F.col("quote"))
    return (
        given.join(known, ["document_id", "section"], "left")
        .withColumn("valid", F.coalesce(valid, F.lit(False)))
        .select(*citations.columns, "valid")
    )


def tool_accuracy(cases: DataFrame, calls: DataFrame) -> DataFrame:
    """Adds ``tools_correct``: the set of successful tools is the expected set. Tool names are few."""
    used = calls.filter((F.col("status") == "success") & ~is_blank(F.col("name"))).groupBy("case_id").agg(
        F.sort_array(F.collect_set(strip(F.col("name")))).alias("_used")
    )
    empty = F.expr("CAST(array() AS array<string>)")
    return (
        cases.join(used.withColumnRenamed("case_id", "id"), "id", "left")
        .withColumn("tools_correct", F.coalesce("_used", empty) == F.sort_array(F.array_distinct("expected_tools")))
        .drop("_used")
    )


def fact_accuracy(cases: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Adds ``required_facts_present`` and ``forbidden_facts_absent``; facts are literal texts."""
    joined = cases if answers is None else cases.join(answers.select(F.col("case_id").alias("id"), "answer"), "id", "left")
    answer = F.coalesce("answer", F.lit(""))
    return joined.withColumn(
        "required_facts_present", F.forall("required_facts", lambda fact: F.contains(answer, fact))
    ).withColumn("forbidden_facts_absent", F.forall("forbidden_facts", lambda fact: ~F.contains(answer, fact)))


def answer_report(per_case: DataFrame) -> DataFrame:
    """Summary of judged answers; a failed request counts as wrong everywhere.

    ``per_case`` has request_successful, hits, expected, valid_citations,
    total_citations, tools_correct, required_facts_present, forbidden_facts_absent.
    """
    ok = F.col("request_successful")

    def share(name: str) -> Column:
        return ratio(F.count_if(ok & F.col(name)), F.count(F.lit(1)))

    return per_case.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(ok).alias("successful_requests"),
        ratio(F.count_if(ok), F.count(F.lit(1))).alias("successful_request_rate"),
        ratio(F.sum(F.when(ok, F.col("hits")).otherwise(0)), F.sum("expected")).alias("retrieval_recall_at_5"),
        ratio(F.sum(F.when(ok, F.col("valid_citations")).otherwise(0)), F.sum(F.when(ok, F.col("total_citations")).otherwise(0))).alias("citation_validity"),
        share("tools_correct").alias("tool_accuracy"),
        share("required_facts_present").alias("required_fact_accuracy"),
        share("forbidden_facts_absent").alias("forbidden_fact_accuracy"),
    )


def published_citations(cited: DataFrame, published: DataFrame) -> DataFrame:
    """Adds ``valid``: a published chunk has the citation's document, title and section, and its text is the quote.

    ``cited`` is made by :func:`retrieve.citations`; a citation of a chunk that was withdrawn since is not valid.
    """
    place = ["document_id", "title", "section", "_hash"]
    known = published.select(F.col("document_key").alias("document_id"), "title", "section", content_hash(F.col("text")).alias("_hash")).distinct()
    judged = cited.withColumn("_hash", content_hash(F.col("quote"))).join(known.withColumn("_known", F.lit(True)), place, "left")
    return judged.withColumn("valid", F.coalesce("_known", F.lit(False))).select(*cited.columns, "valid")


def search_cases(cases: DataFrame, keyword: DataFrame, searched: DataFrame, cited: DataFrame, k: int = CITATIONS) -> DataFrame:
    """What the two routes of a search found per case, as :func:`retrieval_report` wants it.

    ``cases`` has (id, kind, expected_document_ids array), and a query's id is that of its case. ``keyword`` holds the hits of
    keyword search alone, ``searched`` the rows of hybrid search, ``cited`` its citations with ``valid``. A case without a mode
    of its own failed; what it expects stays expected.
    """
    expected = cases.select(F.col("id").alias("case_id"), F.explode(F.array_distinct("expected_document_ids")).alias("document_id"))

    def met(found: DataFrame, name: str) -> DataFrame:
        return _counts(expected.join(found, ["case_id", "document_id"], "left_semi"), name)

    by_words = keyword.where(F.col("rank") <= k).select(F.col("query_id").alias("case_id"), F.col("document_key").alias("document_id"))
    quoted = cited.withColumnRenamed("query_id", "case_id")
    told = quoted.groupBy("case_id").agg(F.count("*").alias("citations"), F.count_if("valid").alias("valid_citations"))
    modes = searched.groupBy(F.col("query_id").alias("case_id")).agg(F.max(F.col("mode") != "none").alias("request_successful"), F.max("warning").alias("warning"))
    size = F.size(F.array_distinct("expected_document_ids")).cast("long").alias("expected")
    joined = cases.select(F.col("id").alias("case_id"), "kind", size)
    for found in (met(by_words, "bm25_hits"), met(quoted.select("case_id", "document_id"), "hybrid_hits"), told, modes):
        joined = joined.join(found, "case_id", "left")
    zero = F.lit(0).cast("long")
    counts = {name: F.coalesce(name, zero) for name in ("bm25_hits", "hybrid_hits", "citations", "valid_citations")}
    return joined.withColumns({**counts, "request_successful": F.coalesce("request_successful", F.lit(False))})


def retrieval_report(per_case: DataFrame) -> DataFrame:
    """Summary of a retrieval run.

    ``per_case`` has kind, request_successful, expected, bm25_hits, hybrid_hits,
    citations, valid_citations and warning.
    """
    ok, positive = F.col("request_successful"), F.col("kind") == "positive"
    return per_case.agg(
        F.count(F.lit(1)).alias("total_cases"),
        ratio(F.count_if(ok), F.count(F.lit(1))).alias("successful_request_rate"),
        ratio(F.sum(F.when(positive, F.col("bm25_hits")).otherwise(0)), F.sum(F.when(positive, F.col("expected")).otherwise(0))).alias("bm25_recall_at_5"),
        ratio(F.sum(F.when(positive & ok, F.col("hybrid_hits")).otherwise(0)), F.sum(F.when(positive, F.col("expected")).otherwise(0))).alias("hybrid_recall_at_5"),
        ratio(F.sum(F.when(ok, F.col("valid_citations")).otherwise(0)), F.sum(F.when(ok, F.col("citations")).otherwise(0))).alias("citation_validity"),
        ratio(F.count_if(~positive & ok & (F.col("citations") == 0)), F.count_if(~positive)).alias("hard_negative_accuracy"),
        F.count_if(F.col("warning").eqNullSafe(F.lit(DEGRADED))).alias("degraded_request_count"),
    )


def gates(summary: DataFrame, limits: tuple[tuple[str, float], ...]) -> DataFrame:
    """One row per gate with its value and whether it passed.

    A retrieval summary is also held to recall no worse than keyword search.
    """
    rows = [F.struct(F.lit(name).alias("gate"), F.col(name).alias("value"), (F.col(name) >= limit).alias("passed")) for name, limit in limits]
    if "bm25_recall_at_5" in summary.columns:
        better = F.col("hybrid_recall_at_5") >= F.col("bm25_recall_at_5")
        rows.append(F.struct(F.lit("hybrid_not_below_bm25").alias("gate"), F.col("hybrid_recall_at_5").alias("value"), better.alias("passed")))
    return summary.select(F.inline(F.array(*rows)))


def reconcile(orders: DataFrame, events: DataFrame, outbox: DataFrame, proposals: DataFrame) -> DataFrame:
    """Orders whose side effects do not add up.

    Every version step must have left one event and one outbox row; a replay
    leaves none. Each table is counted on its own first, then the counts meet.
    """
    key = ["tenant_id", "work_order_id"]

    def counted(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy("tenant_id", F.col(column).alias("work_order_id")).agg(F.count("*").alias(name))

    versions = orders.groupBy("tenant_id", F.col("id").alias("work_order_id")).agg(
        F.count("*").alias("orders"), F.max("version").alias("version")
    )
    joined = versions
    for df, column, name in ((events, "work_order_id", "events"), (outbox, "aggregate_id", "outbox_rows"), (proposals, "target_id", "proposals")):
        joined = joined.join(counted(df, column, name), key, "full")
    zero = F.lit(0).cast("long")
    filled = joined.select(*key, *[F.coalesce(c, zero).alias(c) for c in ("orders", "version", "events", "outbox_rows", "proposals")])
    adds_up = (
        (F.col("orders") == 1)
        & (F.col("events") == F.col("version"))
        & (F.col("outbox_rows") == F.col("version"))
        & (F.col("proposals") >= F.col("version"))
    )
    return filled.filter(~adds_up)
