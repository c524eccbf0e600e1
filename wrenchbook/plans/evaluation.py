"""Queries over evaluation, reconciliation and text scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.operators import evaluate, retrieve, scan
from wrenchbook.plans.bindings import Tables
from wrenchbook.plans.registry import query
from wrenchbook.plans.retrieval import _HYBRID, TEST_DISTANCE
from wrenchbook.session import scratch_path
from wrenchbook.sources import cases


def _cases(t: Tables) -> DataFrame:
    return t["eval_case"].select(
        "id", "kind", "answer",
        *[
            F.filter(F.split(name, r"\|"), lambda x: x != "").alias(name)
            for name in ("expected_document_ids", "expected_tools", "required_facts", "forbidden_facts")
        ],
    )


_PER_CASE = """
SELECT c.id AS case_id, c.kind, CAST(CASE WHEN c.expected_document_ids = '' THEN 0 ELSE 1 END AS BIGINT) AS expected,
       CAST(CASE WHEN EXISTS (SELECT 1 FROM {eval_citation} e WHERE e.case_id = c.id AND e.document_id = c.expected_document_ids) THEN 1 ELSE 0 END AS BIGINT) AS hits,
       (SELECT count(*) FROM {eval_citation} e WHERE e.case_id = c.id) AS citations
FROM {eval_case} c
"""
_RECALL = "SELECT *, CASE WHEN expected > 0 THEN hits = expected ELSE citations = 0 END AS hit FROM {per_case}"


@query("case_recall", "K1", "SELECT case_id, expected, hits, citations, hit FROM {recalled}", {"per_case": _PER_CASE, "recalled": _RECALL})
def case_recall(t: Tables) -> DataFrame:
    return evaluate.case_recall(_cases(t), t["eval_citation"])


@query(
    "recall_at_5", "K1 K6",
    """SELECT count(*) AS cases, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(expected) AS BIGINT) AS expected, count(*) FILTER (WHERE hit) AS hit_cases,
              round(sum(hits) / sum(expected), 4) AS recall_at_5 FROM {recalled}""",
    {"per_case": _PER_CASE, "recalled": _RECALL},
)
def recall_at_5(t: Tables) -> DataFrame:
    return evaluate.recall(evaluate.case_recall(_cases(t), t["eval_citation"]))


def _judged_citations(t: Tables) -> DataFrame:
    """Citations of generated policies: right, wrong title, wrong section and foreign quotes."""
    docs = t["documents"]
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    policy = F.concat(F.lit("Policy "), F.col("doc_id").cast("string"))
    line = F.element_at(F.split("text", "\n"), -1)
    cited = docs.select(
        F.col("lang").alias("case_id"),
        key.alias("document_id"),
        F.when(F.col("doc_id") % 5 == 1, F.lit("Other")).otherwise(policy).alias("title"),
        F.when(F.col("doc_id") % 5 == 2, F.lit("Empty")).otherwise(F.concat(F.lit("Rules of "), "source")).alias("section"),
        F.when(F.col("doc_id") % 5 == 3, F.lit("never written")).when(F.col("doc_id") % 5 == 4, F.col("lang")).otherwise(line).alias("quote"),
    )
    return evaluate.citation_validity(cited, t["markdown"])


@query(
    "citation_validity", "K2",
    """SELECT 'd' || doc_id AS document_id, doc_id % 5 IN (0, 4) AND trim(CASE WHEN doc_id % 5 = 4 THEN lang ELSE string_split(text, chr(10))[-1] END) <> '' AS valid
       FROM {documents}""",
)
def citation_validity(t: Tables) -> DataFrame:
    return _judged_citations(t).select("document_id", "valid")


_TOOLS = """
SELECT c.id, (SELECT string_agg(DISTINCT e.name, '|' ORDER BY e.name) FROM {eval_tool_call} e WHERE e.case_id = c.id AND e.status = 'success')
             IS NOT DISTINCT FROM c.expected_tools AS tools_correct FROM {eval_case} c
"""


@query("tool_accuracy", "K3", "SELECT id, tools_correct FROM {tools}", {"tools": _TOOLS})
def tool_accuracy(t: Tables) -> DataFrame:
    return evaluate.tool_accuracy(_cases(t), t["eval_tool_call"]).select("id", "tools_correct")


@query(
    "fact_accuracy", "K4",
    """SELECT id, contains(answer, 'the') AND contains(answer, 'und') AS required_facts_present, NOT contains(answer, 'zz') AS forbidden_facts_absent
       FROM {eval_case}""",
)
def fact_accuracy(t: Tables) -> DataFrame:
    return evaluate.fact_accuracy(_cases(t)).select("id", "required_facts_present", "forbidden_facts_absent")


def _answer_cases(t: Tables) -> DataFrame:
    cases = _cases(t)
    hits = evaluate.case_recall(cases, t["eval_citation"]).withColumnRenamed("case_id", "id")
    judged = evaluate.fact_accuracy(evaluate.tool_accuracy(cases, t["eval_tool_call"]))
    return judged.join(hits, "id").select(
        "kind", "hits", "expected", "citations", "tools_correct", "required_facts_present", "forbidden_facts_absent",
        (F.length("answer") > 100).alias("request_successful"), F.col("citations").alias("total_citations"), F.col("hits").alias("valid_citations"),
    )


_ANSWERS = {
    "per_case": _PER_CASE, "recalled": _RECALL, "tools": _TOOLS,
    "answers": """SELECT r.*, x.tools_correct, length(c.answer) > 100 AS ok, contains(c.answer, 'the') AND contains(c.answer, 'und') AS facts, NOT contains(c.answer, 'zz') AS clean
                  FROM {recalled} r JOIN {eval_case} c ON c.id = r.case_id JOIN {tools} x ON x.id = r.case_id""",
}


@query(
    "answer_report", "K3 K4 K6",
    """SELECT count(*) AS total_cases, count(*) FILTER (WHERE ok) AS successful_requests, round(count(*) FILTER (WHERE ok) / count(*), 4) AS successful_request_rate,
              round(sum(hits) FILTER (WHERE ok) / sum(expected), 4) AS retrieval_recall_at_5,
              round(sum(hits) FILTER (WHERE ok) / sum(citations) FILTER (WHERE ok), 4) AS citation_validity,
              round(count(*) FILTER (WHERE ok AND tools_correct) / count(*), 4) AS tool_accuracy,
              round(count(*) FILTER (WHERE ok AND facts) / count(*), 4) AS required_fact_accuracy,
              round(count(*) FILTER (WHERE ok AND clean) / count(*), 4) AS forbidden_fact_accuracy FROM {answers}""",
    _ANSWERS,
)
def answer_report(t: Tables) -> DataFrame:
    return evaluate.answer_report(_answer_cases(t))


_RETRIEVAL = """SELECT count(*) AS total_cases, round(count(*) FILTER (WHERE ok) / count(*), 4) AS successful_request_rate,
              round(sum(hits) FILTER (WHERE kind = 'positive') / sum(expected) FILTER (WHERE kind = 'positive'), 4) AS bm25_recall_at_5,
              round(sum(hits) FILTER (WHERE kind = 'positive' AND ok) / sum(expected) FILTER (WHERE kind = 'positive'), 4) AS hybrid_recall_at_5,
              round(sum(hits) FILTER (WHERE ok) / sum(citations) FILTER (WHERE ok), 4) AS citation_validity,
              round(count(*) FILTER (WHERE kind <> 'positive' AND ok AND citations = 0) / count(*) FILTER (WHERE kind <> 'positive'), 4) AS hard_negative_accuracy,
              count(*) FILTER (WHERE NOT ok) AS degraded_request_count FROM {answers}"""


def _retrieval_summary(t: Tables) -> DataFrame:
    cases = _answer_cases(t).withColumn("bm25_hits", F.col("hits")).withColumn("hybrid_hits", F.col("hits"))
    degraded = F.when(~F.col("request_successful"), "HYBRID_RETRIEVAL_DEGRADED")
    return evaluate.retrieval_report(cases.withColumn("warning", degraded))


@query("retrieval_report", "K5 K6", _RETRIEVAL, _ANSWERS)
def retrieval_report(t: Tables) -> DataFrame:
    return _retrieval_summary(t)


@query(
    "retrieval_gates", "K6",
    """SELECT 'successful_request_rate' AS gate, successful_request_rate AS value, successful_request_rate >= 1.0 AS passed FROM {summary}
       UNION ALL SELECT 'hybrid_recall_at_5', hybrid_recall_at_5, hybrid_recall_at_5 >= 0.9 FROM {summary}
       UNION ALL SELECT 'citation_validity', citation_validity, citation_validity >= 0.95 FROM {summary}
       UNION ALL SELECT 'hard_negative_accuracy', hard_negative_accuracy, hard_negative_accuracy >= 1.0 FROM {summary}
       UNION ALL SELECT 'hybrid_not_below_bm25', hybrid_recall_at_5, hybrid_recall_at_5 >= bm25_recall_at_5 FROM {summary}""",
    {**_ANSWERS, "summary": _RETRIEVAL},
)
def retrieval_gates(t: Tables) -> DataFrame:
    return evaluate.gates(_retrieval_summary(t), evaluate.RETRIEVAL_GATES)


_SEARCHES = {
    **_HYBRID,
    "cited": """SELECT f.query_id, f.document_key,
                       EXISTS (SELECT 1 FROM {published_chunk} p WHERE p.document_key = h.document_key AND p.title = h.title AND p.section = h.section AND p.text = h.text) AS valid
                FROM {fused} f JOIN {hybrid_chunk} h ON h.chunk_id = f.chunk_id""",
    "searches": """SELECT c.id AS case_id, c.kind, CAST(CASE WHEN c.expected_document_ids = '' THEN 0 ELSE len(string_split(c.expected_document_ids, '|')) END AS BIGINT) AS expected,
                          (SELECT count(DISTINCT b.document_key) FROM {bm25} b
                           WHERE b.query_id = c.id AND b.rank <= 5 AND list_contains(string_split(c.expected_document_ids, '|'), b.document_key)) AS bm25_hits,
                          (SELECT count(DISTINCT x.document_key) FROM {cited} x
                           WHERE x.query_id = c.id AND list_contains(string_split(c.expected_document_ids, '|'), x.document_key)) AS hybrid_hits,
                          (SELECT count(*) FROM {cited} x WHERE x.query_id = c.id) AS citations,
                          (SELECT count(*) FROM {cited} x WHERE x.query_id = c.id AND x.valid) AS valid_citations,
                          trim(q.query) <> '' AS request_successful,
                          CASE WHEN trim(q.query) <> '' AND q.embedding IS NULL AND NOT q.vector_disabled THEN 'HYBRID_RETRIEVAL_DEGRADED' END AS warning
                   FROM {hybrid_case} c JOIN {hybrid_query} q ON q.query_id = c.id""",
    "search_summary": """SELECT count(*) AS total_cases, round(count(*) FILTER (WHERE request_successful) / count(*), 4) AS successful_request_rate,
              round(sum(bm25_hits) FILTER (WHERE kind = 'positive') / sum(expected) FILTER (WHERE kind = 'positive'), 4) AS bm25_recall_at_5,
              round(sum(hybrid_hits) FILTER (WHERE kind = 'positive' AND request_successful) / sum(expected) FILTER (WHERE kind = 'positive'), 4) AS hybrid_recall_at_5,
              round(sum(valid_citations) FILTER (WHERE request_successful) / sum(citations) FILTER (WHERE request_successful), 4) AS citation_validity,
              round(count(*) FILTER (WHERE kind <> 'positive' AND request_successful AND citations = 0) / count(*) FILTER (WHERE kind <> 'positive'), 4) AS hard_negative_accuracy,
              count(warning) AS degraded_request_count FROM {searches}""",
}


def _search_cases(t: Tables) -> DataFrame:
    """Both routes over the same chunks: the hits of keyword search alone, and the citations of hybrid search."""
    chunks, queries = t["hybrid_chunk"], t["hybrid_query"]
    vectors = retrieve.searchable_vectors(t["vector"], chunks, "model-a")
    # Keyword hits are read alone and by the hybrid search, which is read for its modes and for its hits.
    path = scratch_path(t.spark, "searches")
    retrieve.bm25_search(queries.where("trim(query) <> ''").select("query_id", "tenant_id", "query"), chunks).write.parquet(f"{path}/keyword")
    keyword = t.spark.read.parquet(f"{path}/keyword")
    path = f"{path}/hybrid"
    retrieve.hybrid_search(queries, chunks, vectors, max_distance=TEST_DISTANCE, keyword=keyword).write.parquet(path)
    searched = t.spark.read.parquet(path)
    hits = searched.where("rank IS NOT NULL").join(chunks.select("chunk_id", "title", "section", "text"), "chunk_id")
    cited = evaluate.published_citations(retrieve.citations(hits), t["published_chunk"])
    given = t["hybrid_case"].withColumn("expected_document_ids", F.filter(F.split("expected_document_ids", r"\|"), lambda x: x != ""))
    return evaluate.search_cases(given, keyword, searched, cited)


@query(
    "search_cases", "K5",
    "SELECT case_id, kind, expected, bm25_hits, hybrid_hits, citations, valid_citations, request_successful, warning FROM {searches}", _SEARCHES,
)
def search_cases(t: Tables) -> DataFrame:
    return _search_cases(t)


@query("search_report", "K5 K6", "SELECT * FROM {search_summary}", _SEARCHES)
def search_report(t: Tables) -> DataFrame:
    return evaluate.retrieval_report(_search_cases(t))


@query(
    "search_gates", "K6",
    """SELECT 'successful_request_rate' AS gate, successful_request_rate AS value, successful_request_rate >= 1.0 AS passed FROM {search_summary}
       UNION ALL SELECT 'hybrid_recall_at_5', hybrid_recall_at_5, hybrid_recall_at_5 >= 0.9 FROM {search_summary}
       UNION ALL SELECT 'citation_validity', citation_validity, citation_validity >= 0.95 FROM {search_summary}
       UNION ALL SELECT 'hard_negative_accuracy', hard_negative_accuracy, hard_negative_accuracy >= 1.0 FROM {search_summary}
       UNION ALL SELECT 'hybrid_not_below_bm25', hybrid_recall_at_5, hybrid_recall_at_5 >= bm25_recall_at_5 FROM {search_summary}""",
    _SEARCHES,
)
def search_gates(t: Tables) -> DataFrame:
    return evaluate.gates(evaluate.retrieval_report(_search_cases(t)), evaluate.RETRIEVAL_GATES)


@query(
    "reconciliation", "K8",
    """SELECT o.tenant_id, o.id AS work_order_id, CAST(1 AS BIGINT) AS orders, o.version, coalesce(e.n, 0) AS events, coalesce(x.n, 0) AS outbox_rows, coalesce(p.n, 0) AS proposals
       FROM {run_order} o
       LEFT JOIN (SELECT work_order_id AS id, count(*) AS n FROM {run_event} GROUP BY 1) e ON e.id = o.id
       LEFT JOIN (SELECT aggregate_id AS id, count(*) AS n FROM {run_outbox} GROUP BY 1) x ON x.id = o.id
       LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM {run_proposal} GROUP BY 1) p ON p.id = o.id
       WHERE NOT (coalesce(e.n, 0) = o.version AND coalesce(x.n, 0) = o.version AND coalesce(p.n, 0) >= o.version)""",
)
def reconciliation(t: Tables) -> DataFrame:
    return evaluate.reconcile(t["run_order"], t["run_event"], t["run_outbox"], t["run_proposal"])


PATTERNS = (*scan.DEFAULT_PATTERNS, *scan.PERSONAL_PATTERNS)


def _matches() -> str:
    """All patterns as one relation. The oracle's engine lacks look-ahead, so what may follow is spelt out there."""
    follows = "(?:$|[^58]|8(?:$|[^0])|80(?:$|[^08])|80[08](?:$|[^0])|5(?:$|[^4])|54(?:$|[^3])|543(?:$|[^2]))"
    rows = []
    for category, pattern in PATTERNS:
        plain = pattern.replace("(?!8080|8000|5432)", follows)
        escaped, simple = (p.replace("'", "''").replace("{", "{{").replace("}", "}}") for p in (pattern, plain))
        rows.append(f"SELECT '{category}' AS category, '{escaped}' AS pattern, '(?i){simple}' AS tested")
    return " UNION ALL ".join(rows)


_HITS = """
SELECT l.origin, l.doc_id, l.line_no, p.category, p.pattern
FROM (SELECT origin, doc_id, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) AS INT) AS line_no
      FROM (SELECT origin, doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM {scan_text}) s) l
JOIN {patterns} p ON regexp_matches(l.line, p.tested)
"""
_SCAN = {"patterns": _matches(), "hits": _HITS}


@query("text_scan", "L1", "SELECT origin, doc_id, line_no, category, pattern FROM {hits}", _SCAN)
def text_scan(t: Tables) -> DataFrame:
    return scan.scan(t["scan_text"], PATTERNS, ("origin", "doc_id"))


@query(
    "text_scan_summary", "L1",
    """SELECT (SELECT count(*) FROM {scan_text}) AS texts, count(*) AS hits, count(DISTINCT (origin, doc_id)) AS failing_texts, count(*) = 0 AS passed FROM {hits}""",
    _SCAN,
)
def text_scan_summary(t: Tables) -> DataFrame:
    hits = scan.scan(t["scan_text"], PATTERNS, ("origin", "doc_id"))
    return scan.scan_summary(t["scan_text"], hits, ("origin", "doc_id"))


@query(
    "answer_set_checks", "A2",
    """SELECT 'blank_field' AS reason, id AS detail FROM {answer_set} WHERE category = ' ' OR message = ''
       UNION ALL SELECT 'repeated_id' AS reason, id AS detail FROM {answer_set} GROUP BY id HAVING count(*) > 1
       UNION ALL SELECT 'category_count' AS reason, coalesce(c.category, x.category) AS detail
       FROM (SELECT category, count(*) AS n FROM {answer_set} GROUP BY category) c
       FULL JOIN (SELECT unnest(['knowledge', 'work_order', 'combined']) AS category) x ON x.category = c.category
       WHERE x.category IS NULL OR coalesce(c.n, 0) <> 10""",
)
def answer_set_checks(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "answer-cases")
    t["answer_set"].write.json(path)
    return cases.check_answer_cases(cases.read_cases(t.spark, path, "answer", lines=True))


@query(
    "retrieval_set_checks", "A2",
    """SELECT 'kind' AS reason, id AS detail FROM {retrieval_set} WHERE kind = 'other'
       UNION ALL SELECT 'challenge' AS reason, id AS detail FROM {retrieval_set} WHERE challenge = 'typo'
       UNION ALL SELECT 'kind_and_challenge' AS reason, id AS detail FROM {retrieval_set} WHERE (kind = 'positive') <> (challenge <> 'hard_negative')
       UNION ALL SELECT 'expectation' AS reason, id AS detail FROM {retrieval_set} WHERE (kind = 'positive') <> (expected_document_ids <> '')
       UNION ALL SELECT 'unknown_document' AS reason, id AS detail FROM {retrieval_set}
       WHERE expected_document_ids <> '' AND expected_document_ids NOT IN (SELECT document_key FROM {known_document})
       UNION ALL SELECT 'uncovered_challenge' AS reason, x.challenge AS detail
       FROM (SELECT unnest(['synonym', 'conversational', 'keyword_absent', 'hard_negative']) AS challenge) x
       WHERE x.challenge NOT IN (SELECT challenge FROM {retrieval_set})
       UNION ALL SELECT 'too_few_cases' AS reason, CAST(count(*) AS VARCHAR) AS detail FROM {retrieval_set} HAVING count(*) < 30
       UNION ALL SELECT 'repeated_id' AS reason, id AS detail FROM {retrieval_set} GROUP BY id HAVING count(*) > 1""",
)
def retrieval_set_checks(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "retrieval-cases")
    written = t["retrieval_set"].withColumn("expected_document_ids", F.filter(F.split("expected_document_ids", r"\|"), lambda x: x != ""))
    written.write.json(path)
    return cases.check_retrieval_cases(cases.read_cases(t.spark, path, "retrieval", lines=True), t["known_document"])
