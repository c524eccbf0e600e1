"""Rules, verdicts, model answers, snapshots, cases and text scans on small fixtures."""

import json
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.scalars import json_keys_at_any_depth, utc_timestamp
from wrenchbook.operators import quality, rectify, scan

T0 = datetime(2026, 7, 18, 8)


def rule_rows(spark, summary="done", created=T0, completed=T0, due=T0, attachments=((True,),)):
    listed = None if attachments is None else [("a", "image/png", 1, a[0]) for a in attachments]
    df = spark.createDataFrame(
        [("j", summary, created, completed, due, listed)],
        "job_id string, completion_summary string, created_at timestamp_ntz, completed_at timestamp_ntz, due_at timestamp_ntz, "
        f"attachments array<{schemas.ATTACHMENT.simpleString()}>",
    )
    size, present = quality.counts_of(F.col("attachments"))
    rows = quality.evaluate_rules(df.withColumn("attachment_count", size).withColumn("present_count", present)).orderBy("ordinal").collect()
    assert [r.rule_code for r in rows] == list(schemas.RULE_TEXTS)
    assert all(r.confidence == 1.0 and r.source == "RULE" and r.policy_chunk_id is None for r in rows)
    return [(r.label, json.loads(r.evidence)) for r in rows]


@pytest.mark.parametrize("summary", [None, "", "   ", "　\t"])
def test_summary_must_not_be_blank(spark, summary):
    assert rule_rows(spark, summary=summary)[0] == ("FAIL", {"present": False, "length": 0})


def test_boundaries_pass(spark):
    got = rule_rows(spark, summary=" ok ")
    assert [label for label, _ in got] == ["PASS"] * 4
    assert got[0][1] == {"present": True, "length": 2}
    assert got[1][1] == {"created_at": "2026-07-18T08:00:00+00:00", "completed_at": "2026-07-18T08:00:00+00:00", "completed_not_before_created": True}
    assert got[2][1]["overdue_seconds"] == 0.0


def test_times(spark):
    assert rule_rows(spark, completed=T0 - timedelta(seconds=1))[1][0] == "FAIL"
    late = rule_rows(spark, completed=T0 + timedelta(microseconds=1))[2]
    assert late[0] == "FAIL" and late[1]["overdue_seconds"] == 0.000001
    assert late[1]["completed_at"] == "2026-07-18T08:00:00.000001+00:00"
    missing = rule_rows(spark, completed=None)
    assert [missing[1][0], missing[2][0]] == ["FAIL", "FAIL"]
    assert missing[2][1] == {"completed_at": None, "due_at": "2026-07-18T08:00:00+00:00", "overdue_seconds": None}


@pytest.mark.parametrize("attachments,counts", [(None, (0, 0)), ((), (0, 0)), (((False,),), (1, 0)), (((False,), (True,)), (2, 1))])
def test_attachments(spark, attachments, counts):
    label, evidence = rule_rows(spark, attachments=attachments)[3]
    assert evidence == {"attachment_count": counts[0], "present_count": counts[1]}
    assert label == ("PASS" if counts[1] else "FAIL")


@pytest.mark.parametrize(
    "labels,verdict",
    [
        (["FAIL", "PASS"], "FAIL"),
        (["PASS", "SKIP", "UNCERTAIN"], "UNCERTAIN"),
        (["PASS", "SKIP"], "SKIP"),
        (["PASS", "PASS"], "PASS"),
        (["UNCERTAIN", "FAIL", "SKIP"], "FAIL"),
    ],
)
def test_verdict_order(spark, labels, verdict):
    df = spark.createDataFrame([("j", x) for x in labels], "job_id string, label string")
    assert quality.verdicts(df).first().verdict == verdict


def test_inspection(spark):
    inputs = spark.createDataFrame(
        [(j, "done" if j != "rule" else " ", T0, T0, T0, 1, 0 if j == "skip" else 1) for j in ("pass", "rule", "skip", "ground", "model", "wait")],
        "job_id string, completion_summary string, created_at timestamp_ntz, completed_at timestamp_ntz, due_at timestamp_ntz, attachment_count long, present_count long",
    )
    outputs = spark.createDataFrame(
        [("pass", "PASS", 0.8), ("rule", "PASS", 0.8), ("ground", "PASS", 0.7), ("model", "PASS", 0.66666), ("skip", "FAIL", 0.9)],
        "job_id string, verdict string, confidence double",
    )
    findings = spark.createDataFrame(
        [("pass", 0, "PASS", "c1"), ("ground", 0, "PASS", "c9"), ("model", 0, "FAIL", "c1"), ("skip", 0, "FAIL", "c1")],
        "job_id string, ordinal int, label string, policy_chunk_id string",
    )
    findings = findings.withColumn("severity", F.lit("LOW"))
    hits = spark.createDataFrame([(j, "c1") for j in ("pass", "ground", "model", "skip")], "job_id string, chunk_id string")
    done = quality.inspect(inputs, outputs, findings, hits)
    got = {r.job_id: (r.verdict, r.confidence) for r in done.results.collect()}
    assert got == {"pass": ("PASS", 0.8), "rule": ("FAIL", 1.0), "skip": ("SKIP", 1.0), "ground": ("UNCERTAIN", 0.7), "model": ("FAIL", 0.6667)}
    kept = done.findings.filter("job_id = 'skip'").orderBy("ordinal").collect()
    assert [(r.ordinal, r.label) for r in kept] == [(0, "PASS"), (1, "PASS"), (2, "PASS"), (3, "FAIL")]
    moved = done.findings.filter("job_id = 'ground' AND source = 'MODEL'").first()
    assert (moved.ordinal, moved.label, moved.policy_chunk_id) == (4, "UNCERTAIN", None)


CHUNK = str(uuid.UUID(int=5))


def finding(**changes):
    base = {"rule_code": "POLICY_A", "severity": "LOW", "label": "PASS", "evidence": "seen", "policy_chunk_id": CHUNK, "recommendation": "none", "confidence": 0.5}
    return {**base, **changes}


def answer(findings=None, **changes):
    return {"verdict": "PASS", "confidence": 1, "findings": [finding()] if findings is None else findings, **changes}


GOOD = [answer(), answer([]), answer([finding(policy_chunk_id=None)]), answer([finding(), finding(rule_code="POLICY_B")]), answer([finding(evidence="x" * 4000)])]
BAD = [
    answer(verdict="GOOD"), answer(confidence=1.1), answer(confidence=None), answer(note="x"), {"verdict": "PASS", "confidence": 1},
    answer([finding(), finding()]), answer([finding(rule_code="policy_a")]), answer([finding(rule_code="POLICY_Z")]),
    answer([finding(severity="CRITICAL")]), answer([finding(label="OK")]), answer([finding(evidence="  ")]),
    answer([finding(evidence=5)]), answer([finding(evidence={"a": 1})]), answer([finding(recommendation=["x"])]), answer([finding(evidence=None)]),
    answer([finding(recommendation="x" * 4001)]), answer([finding(policy_chunk_id="c1")]), answer([finding(confidence=-0.1)]),
    answer([{k: v for k, v in finding().items() if k != "evidence"}]), answer([finding(extra=1)]),
    answer([finding(rule_code=f"POLICY_{chr(65 + n)}") for n in range(21)]), "not an object",
]


def test_model_answers(spark):
    good = json.dumps(GOOD[0])
    behind = [good + more for more in (" x", " {}", "x}", ", {}", "] {}", ', "end"] }')]
    payloads = [json.dumps(x) for x in GOOD + BAD] + behind + [None, "", "{broken"]
    outputs = spark.createDataFrame([(f"j{n:02d}", p) for n, p in enumerate(payloads)], "job_id string, payload string")
    codes = [f"POLICY_{chr(65 + n)}" for n in range(21)]
    allowed = outputs.select("job_id", F.explode(F.array(*[F.lit(c) for c in codes])).alias("rule_code"))
    rows = quality.validate_outputs(outputs, allowed).orderBy("job_id").collect()
    assert [r.error_code for r in rows[: len(GOOD)]] == [None] * len(GOOD)
    assert {r.error_code for r in rows[len(GOOD) :]} == {quality.OUTPUT_INVALID}
    assert rows[0].output.findings[0].asDict() == finding() and rows[-1].output is None


def test_codes_are_checked_per_answer(spark):
    # A second answer of the job with a code that was not retrieved had made the first one invalid too.
    good, bad = json.dumps(GOOD[0]), json.dumps(answer([finding(rule_code="POLICY_OTHER")]))
    outputs = spark.createDataFrame([("j", good), ("j", bad), ("none", good)], "job_id string, payload string")
    allowed = spark.createDataFrame([("j", "POLICY_A"), ("j", "POLICY_B"), ("j", "POLICY_A")], "job_id string, rule_code string")
    checked = quality.validate_outputs(outputs, allowed)
    assert {(r.job_id, r.payload): r.error_code for r in checked.collect()} == {
        ("j", good): None, ("j", bad): quality.OUTPUT_INVALID, ("none", good): quality.OUTPUT_INVALID,
    }
    # The answers are read, and so taken apart, once.
    assert checked.select("job_id", "error_code")._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_policy_codes(spark):
    df = spark.createDataFrame([(CHUNK,), (uuid.UUID(CHUNK).hex.upper(),), ("sla-policy:0:0",)], "c string")
    got = [r[0] for r in df.select(quality.policy_rule_code(F.col("c"))).collect()]
    named = uuid.uuid5(uuid.UUID(schemas.POLICY_CHUNK_NAMESPACE), "sla-policy:0:0")
    assert got == [f"POLICY_{uuid.UUID(CHUNK).hex.upper()}"] * 2 + [f"POLICY_{named.hex.upper()}"]


def test_policy_versions(spark):
    hits = spark.createDataFrame([("j", "b", 1), ("j", "a", 2), ("j", "b", 3)], "job_id string, document_key string, document_version int")
    assert quality.policy_versions(hits).first().policy_versions == {"a": 2, "b": 3}


def test_safe_snapshot(spark):
    payload = json.dumps({"id": "o", "version": 3, "secret_note": "x", "status": "COMPLETED", "title": None})
    df = spark.createDataFrame([(payload,)], "p string")
    kept = json.loads(df.select(quality.safe_snapshot(F.col("p"), schemas.CALLBACK_FIELDS)).first()[0])
    assert kept == {"id": "o", "version": 3, "status": "COMPLETED"}


def test_keys_are_found_at_any_depth(spark):
    payload = json.dumps({"a": [{"Attachment_URL ": {"b\"c": 1}}], "note": 'text with "token": inside'})
    df = spark.createDataFrame([(payload,)], "p string")
    keys = df.select(json_keys_at_any_depth(F.col("p"))).first()[0]
    assert "attachment_url" in keys and "token" not in keys
    assert df.select(quality.forbidden_keys(F.col("p"))).first()[0] == ["attachment_url"]


@pytest.mark.parametrize(
    "change,reason",
    [
        ({}, None),
        ({"tenant_id": "other"}, "tenant"),
        ({"id": "x"}, "identity"),
        ({"status": "CLOSED"}, "status"),
        ({"inspection_round": 0}, "round"),
        ({"version": -1}, "version"),
        ({"version": None}, "version"),
        ({"nested": {"list": [{"photo_uri": 1}]}}, "forbidden_key"),
        ({"credential": 1}, "forbidden_key"),
    ],
)
def test_event_boundary(spark, change, reason):
    payload = {"id": "o", "tenant_id": "t", "version": 2, "status": "COMPLETED", **change}
    df = spark.createDataFrame([("t", "o", json.dumps(payload))], "tenant_id string, aggregate_id string, payload string")
    row = quality.check_events(df).first()
    assert row.reasons == ([] if reason is None else [reason])
    if reason is None:
        assert (row.work_order_version, row.inspection_round) == (2, 1)


def test_timestamps(spark):
    texts = ["2026-07-18T08:00:00Z", "2026-07-18T10:00:00+02:00", " 2026-07-18T08:00:00 ", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(utc_timestamp(F.col("t"))).collect()] == [T0, T0, T0, None, None]


def results(spark, *rows):
    return spark.createDataFrame(
        [("t", *r) for r in rows],
        "tenant_id string, id string, work_order_id string, work_order_version long, inspection_round int, verdict string, generated_at timestamp_ntz",
    )


def test_cases(spark):
    orders = spark.createDataFrame([("t", "o1", 3, "COMPLETED"), ("t", "o2", 3, "CLOSED"), ("t", "o3", 1, "COMPLETED")], "tenant_id string, id string, version long, status string")
    stored = spark.createDataFrame([("t", "r0", "o1", 1)], "tenant_id string, current_quality_result_id string, original_work_order_id string, inspection_round int")
    h = [T0 + timedelta(hours=n) for n in range(9)]
    batch = results(
        spark,
        ("r0", "o1", 3, 1, "FAIL", h[0]), ("r1", "o1", 3, 1, "FAIL", h[1]), ("r2", "o1", 3, 2, "PASS", h[3]), ("r3", "o1", 3, 2, "FAIL", h[2]),
        ("r4", "o1", 2, 3, "FAIL", h[4]), ("r5", "o2", 3, 1, "FAIL", h[5]), ("r6", "zz", 3, 1, "FAIL", h[6]),
        ("r7", "o3", 1, 1, "SKIP", h[1]), ("r8", "o3", 1, 1, "UNCERTAIN", h[2]), ("r9", "o3", 1, 1, "SKIP", h[3]),
    )
    got = {r.id: r.outcome for r in rectify.open_cases(batch, orders, stored).collect()}
    assert got == {
        "r0": "EXISTING", "r1": "CONFLICT", "r2": "CONFLICT", "r3": "CREATED", "r4": "INVALID", "r5": "INVALID", "r6": "NOT_FOUND",
        "r7": "SKIPPED", "r8": "CREATED", "r9": "CONFLICT",
    }


def test_repeated_deliveries(spark):
    orders = spark.createDataFrame([("t", "o1", 3, "COMPLETED"), ("t", "o2", 3, "COMPLETED")], "tenant_id string, id string, version long, status string")
    stored = spark.createDataFrame([("t", "r9", "o2", 1)] * 2, "tenant_id string, current_quality_result_id string, original_work_order_id string, inspection_round int")
    h = [T0 + timedelta(hours=n) for n in range(4)]
    batch = results(spark, ("r1", "o1", 3, 1, "FAIL", h[0]), ("r1", "o1", 3, 1, "FAIL", h[0]), ("r1", "o1", 3, 1, "FAIL", h[2]), ("r2", "o1", 3, 1, "FAIL", h[1]), ("r9", "o2", 3, 1, "FAIL", h[0]))
    got = sorted((r.id, r.outcome) for r in rectify.open_cases(batch, orders, stored).collect())
    assert got == [("r1", "CREATED"), ("r1", "EXISTING"), ("r1", "EXISTING"), ("r2", "CONFLICT"), ("r9", "EXISTING")]


def test_rework_order(spark):
    result = str(uuid.UUID(int=2**100 + 7))
    cases = spark.createDataFrame([("t", "c", "o1", result, "FAIL"), ("t", "d", "o1", "r-pass", "PASS"), ("t", "e", "o1", "r-none", "UNCERTAIN")],
                                  "tenant_id string, id string, original_work_order_id string, current_quality_result_id string, current_verdict string")
    orders = spark.createDataFrame([("t", "o1", "x" * 250, "p", "P", "s", "WO-1", None, None)],
                                   "tenant_id string, id string, title string, project_id string, project_name string, space_path string, work_order_no string, root_work_order_id string, root_work_order_no string")
    findings = spark.createDataFrame(
        [("t", result, "f1", 0, "PASS", "fine"), ("t", result, "f2", 2, "FAIL", "later"), ("t", result, "f3", 1, "UNCERTAIN", " " + "y" * 400)],
        "tenant_id string, quality_result_id string, id string, ordinal int, label string, recommendation string",
    )
    got = {r.case_id: r for r in rectify.rework_orders(cases, orders, findings, "2026-07-18 08:00:00").collect()}
    assert set(got) == {"c", "e"}
    assert got["c"].work_order_no == "RW-" + result.replace("-", "")[:20]
    assert len(got["c"].title) == 200 and got["c"].title.startswith("Rectification: x")
    assert got["c"].rework_reason == "y" * 300 and got["e"].rework_reason == "Review and rectify quality result r-none"
    assert (got["c"].root_work_order_id, got["c"].root_work_order_no) == ("o1", "WO-1")
    assert got["c"].due_at == T0 + timedelta(days=2)


def test_scan_reports_each_line_and_pattern_once(spark):
    text = "ok\nkey AKIA" + "A" * 16 + " and akia" + "b" * 16 + "\r\nPASSWORD = 'longenough'\nhost 192.168.0.1 at app.internal.example\n生产环境"
    docs = spark.createDataFrame([("d", text), ("e", "clean")], "doc_id string, text string")
    hits = scan.scan(docs)
    got = sorted((r.line_no, r.category) for r in hits.collect())
    assert got == [(2, "API keys/tokens"), (3, "API keys/tokens"), (4, "Private hostnames"), (4, "Private hostnames"), (5, "Company identifiers")]
    assert scan.scan_summary(docs, hits).first().asDict() == {"texts": 2, "hits": 5, "failing_texts": 1, "passed": False}
    clean = docs.filter("doc_id = 'e'")
    assert scan.scan_summary(clean, scan.scan(clean)).first().passed


def test_callbacks_are_the_oldest(spark):
    rows = results(spark, *[(f"r{n}", "o", 1, n, "PASS", T0 + timedelta(hours=-n)) for n in range(5)])
    sent = spark.createDataFrame([("t", "r4")], "tenant_id string, id string")
    assert [r.id for r in rectify.pending_callbacks(rows, sent, 2).orderBy("position").collect()] == ["r3", "r2"]
    with pytest.raises(ValueError):
        rectify.pending_callbacks(rows, sent, 21)


def test_an_execution_that_does_not_fit_hides_none(spark):
    cases = spark.createDataFrame(
        [("t", "fail", "FAIL", "PROPOSED", None, None), ("t", "pass", "PASS", "PROPOSED", None, None), ("t", "idle", "FAIL", "PROPOSED", None, None)],
        "tenant_id string, id string, current_verdict string, status string, closed_at timestamp_ntz, rectification_work_order_id string",
    )
    later = T0 + timedelta(hours=1)
    runs = [(c, a, f"w{c}{a[:2]}", at) for c in ("fail", "pass") for a, at in (("CLOSE", T0 if c == "fail" else later), ("CREATE_RECTIFICATION", later if c == "fail" else T0))]
    executions = spark.createDataFrame([("t", *r) for r in [*runs, ("idle", "CLOSE", "w", T0)]], "tenant_id string, case_id string, action string, work_order_id string, executed_at timestamp_ntz")
    got = {r.id: (r.status, r.closed_at, r.rectification_work_order_id) for r in rectify.advance_cases(cases, executions).collect()}
    assert got == {"fail": ("RECTIFYING", None, "wfailCR"), "pass": ("CLOSED", later, None), "idle": ("PROPOSED", None, None)}
