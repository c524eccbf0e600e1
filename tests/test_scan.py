"""Scans: what a pattern requires, and that lines without it are the only ones left out. Retrieval evaluation by hand."""

import re

import pytest

from wrenchbook.operators import evaluate, scan

CASES = {
    r"sk-[a-z]{20,}": "sk-", r"colou?r": "colo", r"ab+c": "ab", r"a{0}bc": "bc", r"x(yz)+w": "x", r"one|two": None, r"[ab\]]cd": "cd", r"[^]x]yz": "yz",
    r"A\.B\\C": "a.b\\c", r"\d+\s*": None, r"\x41bc": None, r"(?x)a b": None, r"^Key$": "key", r"[a-z&&[^b]]c": None, r"(a|b)cd*e": "c",
}


@pytest.mark.parametrize("pattern", CASES)
def test_required_text(pattern):
    assert scan.required_text(pattern) == CASES[pattern]


def test_guarded_patterns_find_what_they_found(spark):
    patterns = (*scan.DEFAULT_PATTERNS, *scan.PERSONAL_PATTERNS, ("Keys", "id|key"))
    lines = [
        "localhost:12345", "localhost:80808080", "LOCALHOST:99998080x", "localhost:1234", "localhost:12345432", "localhost:123454321 and 10.0.0.1",
        "password : 'longenough'", "PASSWORD='short'", "SK-" + "a" * 20, "/home/me/.ssh/id", r"C:\Users\me\Documents\x", "mail a.b@c.org", "卓越 key", "", "4111 1111 1111 1111", "172.20.1.2",
    ]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "x\r\nsecret = \"abcdefgh\"\r")], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"], r["pattern"]) for r in scan.scan(docs, patterns).collect()}
    by_hand = {(1, n, p) for n, line in enumerate(lines, 1) for _, p in patterns if re.search(p, line, re.IGNORECASE)}
    assert got == by_hand | {(4, 2, p) for _, p in patterns if p.startswith("secret")}
    assert scan.scan(docs.limit(0), patterns).count() == 0


def test_search_cases(spark):
    cases = spark.createDataFrame([("a", "positive", ["d1", "d2"]), ("b", "hard_negative", []), ("c", "positive", ["d1"]), ("d", "positive", ["d9"])], "id string, kind string, expected_document_ids array<string>")
    keyword = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 6), ("c", "d1", 5), ("b", "d1", 1)], "query_id string, document_key string, rank int")
    searched = spark.createDataFrame([("a", "hybrid", None), ("a", "hybrid", None), ("b", "bm25", "HYBRID_RETRIEVAL_DEGRADED"), ("c", "none", None)], "query_id string, mode string, warning string")
    quotes = [("a", 1, "d1", "T", "S", "one"), ("a", 2, "d2", "T", "S", "two"), ("b", 1, "d1", "other", "S", "one")]
    published = spark.createDataFrame([("d1", "T", "S", "one"), ("d1", "T", "S", "one"), ("d2", "T", "S", "two, changed")], "document_key string, title string, section string, text string")
    cited = evaluate.published_citations(spark.createDataFrame(quotes, "query_id string, rank int, document_id string, title string, section string, quote string"), published)
    found = evaluate.search_cases(cases, keyword, searched, cited)
    got = {r["case_id"]: tuple(r)[2:] for r in found.select("case_id", "kind", "expected", "bm25_hits", "hybrid_hits", "citations", "valid_citations", "request_successful", "warning").collect()}
    assert got == {
        "a": (2, 1, 2, 2, 1, True, None), "b": (0, 0, 0, 1, 0, True, "HYBRID_RETRIEVAL_DEGRADED"), "c": (1, 1, 0, 0, 0, False, None), "d": (1, 0, 0, 0, 0, False, None),
    }
    gates = {r["gate"]: r["passed"] for r in evaluate.gates(evaluate.retrieval_report(found), evaluate.RETRIEVAL_GATES).collect()}
    assert gates == {"successful_request_rate": False, "hybrid_recall_at_5": False, "citation_validity": False, "hard_negative_accuracy": False, "hybrid_not_below_bm25": True}
