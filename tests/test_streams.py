"""Streams over several micro-batches against the batch operators and brute force."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.operators import commands, events, jobs
from wrenchbook.session import scratch_path
from wrenchbook.sources import sinks
from wrenchbook.sources.outbox import read_outbox
from wrenchbook.streaming import runs, state

T0 = datetime(2026, 7, 18, 8)


def in_files(spark, df, folder, order, parts):
    """Writes ``df`` as ``parts`` files in time order, one per micro-batch."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // parts)
    for n in range(parts):
        path = f"{folder}/part{n}"
        spark.createDataFrame(rows[n * size : (n + 1) * size], df.schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.link(f"{path}/{name}", f"{folder}/{n}.parquet")
                os.utime(f"{folder}/{n}.parquet", (1_800_000_000 + n, 1_800_000_000 + n))
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", False).parquet(str(folder))
    )


def run(stream, spark):
    folder = scratch_path(spark, "test")
    return runs.run_to_table(stream, f"{folder}/rows", f"{folder}/checkpoint")


def test_replay_stream_equals_the_batch(spark, tables, tmp_path):
    log = tables["order_event"]
    stream = in_files(spark, log, tmp_path, ["occurred_at", "event_id"], 4)
    got = run(state.replay_stream(stream), spark)
    columns = ["event_id", "legal", "status_before", "status_after"]
    expected = events.replay(log)[0].select(*columns)
    assert got.filter("late").count() == 0
    assert got.select(*columns).exceptAll(expected).count() == 0 and expected.exceptAll(got.select(*columns)).count() == 0


def test_replay_stream_marks_late_events(spark, tmp_path):
    def rows(*items):
        return spark.createDataFrame(
            [("t", "o", n, a, None, T0 + timedelta(minutes=m)) for n, a, m in items],
            "tenant_id string, work_order_id string, event_id long, action string, reason string, occurred_at timestamp_ntz",
        )

    df = rows((1, "ASSIGN", 1), (2, "START", 3), (3, "ACCEPT", 2), (4, "START", 4))
    ordered = df.withColumn("arrival", F.col("event_id"))
    stream = in_files(spark, ordered, tmp_path, ["arrival"], 4).drop("arrival")
    got = {r.event_id: (r.legal, r.late) for r in run(state.replay_stream(stream), spark).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True), 4: (False, False)}


def test_classification_across_batches(spark, tables, tmp_path):
    requests = tables["request"]
    stream = in_files(spark, requests, tmp_path, ["arrived_at", "request_id"], 3)
    folder = scratch_path(spark, "classes")
    runs.start_classification(stream, f"{folder}/out", f"{folder}/checkpoint", days_kept=400).awaitTermination()
    got = spark.read.parquet(f"{folder}/out").select("request_id", F.col("outcome").cast("string").alias("outcome"))
    expected = commands.classify_requests(requests).select("request_id", "outcome")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_classification_forgets_old_keys(spark, tmp_path):
    rows = [("t", "op", "k", "h1", 1, T0), ("t", "op", "k", "h2", 2, T0 + timedelta(hours=24)), ("t", "op", "k", "h2", 3, T0 + timedelta(hours=25)), ("t", "op", "k", "h2", 4, T0 + timedelta(hours=26))]
    df = spark.createDataFrame(rows, "tenant_id string, operation string, key string, request_hash string, request_id long, arrived_at timestamp_ntz")
    folder = scratch_path(spark, "ttl")
    runs.start_classification(in_files(spark, df, tmp_path, ["request_id"], 4), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = {r.request_id: r.outcome for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: "EXECUTE", 2: "CONFLICT", 3: "EXECUTE", 4: "REPLAY"}


def test_intake_stream_equals_the_batch(spark, tables, tmp_path):
    completed = tables["completed_event"]
    stream = in_files(spark, completed, tmp_path, ["occurred_at", "event_id"], 3)
    folder = scratch_path(spark, "intake")
    runs.start_intake(runs.deduplicated(stream), f"{folder}/jobs", f"{folder}/checkpoint").awaitTermination()
    got, expected = spark.read.parquet(f"{folder}/jobs"), jobs.intake(completed)
    assert got.count() == expected.count()
    assert expected.join(got, "business_key", "left_anti").count() == 0
    assert got.groupBy("business_key").count().filter("count > 1").count() == 0


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "jobs")
    write = sinks.insert_only_writer(path, ["k"], lambda rows: rows.dropDuplicates(["k"]))
    first = spark.createDataFrame([("a",), ("b",)], "k string")
    second = spark.createDataFrame([("b",), ("c",)], "k string")
    for _ in range(2):
        write(first, 0)
    for _ in range(2):
        write(second, 1)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_append_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "tenant_id string, n int")
    assert sinks.read_or_empty(df, path).count() == 0
    sinks.append(df, path)
    sinks.append(df.filter("n = 1"), path)
    assert sinks.read_or_empty(df, path).count() == 3
    assert sorted(n for n in os.listdir(path) if n.startswith("tenant")) == ["tenant_id=A", "tenant_id=B"]


def test_outbox_reader_filters(spark, tmp_path):
    rows = [
        ("e1", "t", "WORK_ORDER", "o", "WORK_ORDER_COMPLETED", "{}", "PENDING", T0, T0, 0),
        ("e2", "t", "WORK_ORDER", "o", "WORK_ORDER_COMPLETED", "{}", "PENDING", T0, T0 + timedelta(seconds=1), 0),
        ("e3", "t", "WORK_ORDER", "o", "WORK_ORDER_CLOSED", "{}", "PENDING", T0, T0, 0),
        ("e4", "t", "WORK_ORDER", "o", "WORK_ORDER_COMPLETED", "{}", "PUBLISHED", T0, T0, 0),
        ("e5", "t", "OTHER", "o", "WORK_ORDER_COMPLETED", "{}", "PENDING", T0, T0, 0),
    ]
    spark.createDataFrame(rows, schemas.OUTBOX).write.parquet(str(tmp_path / "outbox"))
    got = run(read_outbox(spark, str(tmp_path / "outbox"), str(T0)), spark)
    assert [r.event_id for r in got.collect()] == ["e1"]


ATTEMPT = "tenant_id string, job_id string, seq long, at timestamp_ntz, kind string, attempt int, verdict string"


def job_run(spark, rows, folder, parts=1, delay="0 seconds"):
    df = spark.createDataFrame([("t", j, n, T0 + timedelta(minutes=m), k, a, v) for n, (j, m, k, a, v) in enumerate(rows)], ATTEMPT)
    stream = in_files(spark, df, folder, ["seq"], parts).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    out = run(state.job_stream(stream), spark).collect()
    return sorted(((r.job_id, (r.at - T0) // timedelta(minutes=1), r.cause, r.changed, r.status, r.attempts) for r in out), key=lambda r: (r[0], r[1], r[2]))


def test_job_lifecycle(spark, tmp_path):
    rows = [
        ("a", 0, "CLAIM", None, None), ("a", 1, "CLAIM", None, None), ("a", 2, "RETRYABLE", 1, None), ("a", 6, "CLAIM", None, None), ("a", 7, "CLAIM", None, None),
        ("a", 8, "OK", 1, "PASS"), ("a", 9, "OK", 2, "SKIP"), ("a", 10, "CLAIM", None, None),
        ("b", 0, "CLAIM", None, None), ("b", 15, "OK", 1, "PASS"),
    ]
    assert job_run(spark, rows, tmp_path) == [
        ("a", 0, "CLAIM", True, "RUNNING", 1), ("a", 1, "CLAIM", False, "RUNNING", 1), ("a", 2, "RETRYABLE", True, "RETRY_WAIT", 1),
        ("a", 6, "CLAIM", False, "RETRY_WAIT", 1), ("a", 7, "CLAIM", True, "RUNNING", 2), ("a", 8, "OK", False, "RUNNING", 2),
        ("a", 9, "OK", True, "SKIPPED", 2), ("a", 10, "CLAIM", False, "SKIPPED", 2),
        ("b", 0, "CLAIM", True, "RUNNING", 1), ("b", 15, "LEASE_END", True, "RETRY_WAIT", 1), ("b", 15, "OK", False, "RETRY_WAIT", 1),
    ]


def test_lease_timer_fires_without_a_report(spark, tmp_path):
    rows = [("a", 0, "CLAIM", None, None), ("z", 30, "CLAIM", None, None), ("z", 31, "CLAIM", None, None)]
    got = job_run(spark, rows, tmp_path, parts=3)
    assert ("a", 15, "LEASE_END", True, "RETRY_WAIT", 1) in got


def test_three_attempts_are_the_limit(spark, tmp_path):
    rows = [("a", m, "CLAIM", None, None) for m in (0, 15, 30, 45)]
    got = job_run(spark, rows, tmp_path)
    assert [r[2:5] for r in got if r[3]] == [
        ("CLAIM", True, "RUNNING"), ("CLAIM", True, "RUNNING"), ("LEASE_END", True, "RETRY_WAIT"),
        ("CLAIM", True, "RUNNING"), ("LEASE_END", True, "RETRY_WAIT"), ("LEASE_END", True, "FAILED"),
    ]


@pytest.mark.parametrize("parts", [1, 3])
def test_job_stream_does_not_depend_on_batches(spark, tmp_path, parts):
    rng = random.Random(31)
    rows, minute = [], 0
    for _ in range(150):
        minute += rng.randrange(0, 6)
        kind = rng.choice(["CLAIM", "CLAIM", "OK", "RETRYABLE", "FATAL", "UNKNOWN"])
        rows.append((rng.choice("abcdefgh"), minute, kind, rng.randrange(1, 4), rng.choice(["PASS", "SKIP"])))
    folds, expected = {}, []
    for job, at, kind, attempt, verdict in rows:
        fold = folds.setdefault(job, state.JobFold())
        now = at * 60_000_000
        end = fold.lease_end()
        if fold.expire(now):
            expected.append((job, end // 60_000_000, "LEASE_END", True, fold.status, fold.attempts))
        changed = fold.claim(now) if kind == "CLAIM" else fold.report(now, attempt, kind, verdict)
        expected.append((job, at, kind, changed, fold.status, fold.attempts))
    got = job_run(spark, rows, tmp_path, parts, delay="1 day")
    assert sorted(got) == sorted(expected)


def state_rows(stream, spark):
    """Rows of state after each micro-batch of a run."""
    folder, rows = scratch_path(spark, "state"), []
    query = (
        stream.writeStream.foreachBatch(lambda df, batch: sinks.append_batch(df, f"{folder}/rows", batch))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return rows, spark.read.parquet(f"{folder}/rows")


def test_final_orders_leave_the_state(spark, tmp_path):
    schema = "tenant_id string, work_order_id string, event_id long, action string, reason string, occurred_at timestamp_ntz"
    rows = []
    for part in range(4):
        for n in range(20):
            action, reason = ("ASSIGN", None) if n == 0 else ("CANCEL", "mistake")
            rows.append(("t", f"o{part}-{n}", len(rows), action, reason, T0 + timedelta(minutes=len(rows))))
    log = spark.createDataFrame(rows, schema)
    counts, out = state_rows(state.replay_stream(in_files(spark, log, tmp_path, ["event_id"], 4), kept=timedelta(milliseconds=1)), spark)
    assert out.count() == 80 and out.where("legal").count() == 80
    # Of 80 orders four are open; at most those of the last batch are still waiting to be forgotten.
    assert counts[-1] <= 4 + 19 and max(counts) <= 4 + 2 * 19
    (tmp_path / "kept").mkdir()
    counts, _ = state_rows(state.replay_stream(in_files(spark, log, tmp_path / "kept", ["event_id"], 4)), spark)
    assert counts[-1] == 80


def test_ended_jobs_leave_the_state(spark, tmp_path):
    rows = []
    for part in range(4):
        for n in range(10):
            at = T0 + timedelta(days=2 * part, minutes=n)
            rows.append(("t", f"j{part}-{n}", len(rows), at, "CLAIM", None, None))
            if n:
                rows.append(("t", f"j{part}-{n}", len(rows), at + timedelta(minutes=1), "OK", 1, "PASS"))
    stream = in_files(spark, spark.createDataFrame(rows, ATTEMPT), tmp_path, ["seq"], 4).withColumn("at", F.col("at").cast("timestamp"))
    counts, out = state_rows(state.job_stream(stream.withWatermark("at", "0 seconds"), kept=timedelta(hours=1)), spark)
    assert out.where("status = 'SUCCEEDED'").count() == 36
    assert counts[-1] <= 4 + 9


def test_a_job_that_was_forgotten_starts_anew(spark, tmp_path):
    rows = [("a", 0, "CLAIM", None, None), ("a", 1, "OK", 1, "PASS"), ("a", 60, "CLAIM", None, None), ("a", 30 * 24 * 60 + 61, "CLAIM", None, None)]
    assert [r[2:] for r in job_run(spark, rows, tmp_path)] == [
        ("CLAIM", True, "RUNNING", 1), ("OK", True, "SUCCEEDED", 1), ("CLAIM", False, "SUCCEEDED", 1), ("CLAIM", True, "RUNNING", 1),
    ]


def test_few_columns_go_through_python(spark, tmp_path):
    # Every column of a key is taken apart by itself, which had cost more than the rules.
    schema = "tenant_id string, work_order_id string, event_id long, action string, reason string, occurred_at timestamp_ntz"
    replayed = state.replay_stream(spark.readStream.schema(schema).parquet(str(tmp_path)))
    attempts = spark.readStream.schema(ATTEMPT.replace("timestamp_ntz", "timestamp")).parquet(str(tmp_path)).withWatermark("at", "0 seconds")
    for stream in (replayed, state.job_stream(attempts)):
        node = stream._jdf.queryExecution().analyzed()
        while node.nodeName() != "FlatMapGroupsInPandasWithState":
            node = node.children().apply(0)
        assert node.children().apply(0).output().size() <= 4


def test_texts_and_nulls_pass_a_replay(spark, tmp_path):
    odd = 'é "q"\\ \n☃ 𝄞'
    schema = "tenant_id string, work_order_id string, event_id long, action string, reason string, occurred_at timestamp_ntz"
    rows = [(odd, odd, 1, odd, None, T0), (odd, odd, 2, None, None, T0 + timedelta(microseconds=1)), (odd, odd, 3, "ASSIGN", "x", T0 + timedelta(microseconds=2))]
    got = run(state.replay_stream(in_files(spark, spark.createDataFrame(rows, schema), tmp_path, ["event_id"], 1)), spark).orderBy("event_id").collect()
    assert [(r.tenant_id, r.work_order_id, r.event_id, r.action, r.occurred_at, r.legal) for r in got] == [
        (odd, odd, n, action, at, legal) for (_, _, n, action, _, at), legal in zip(rows, (False, False, True))
    ]


def test_a_report_without_a_number_is_refused(spark, tmp_path):
    rows = [("a", 0, "CLAIM", None, None), ("a", 1, "OK", None, "PASS"), ("a", 2, "OK", 1, "PASS")]
    assert [r[2:] for r in job_run(spark, rows, tmp_path)] == [("CLAIM", True, "RUNNING", 1), ("OK", False, "RUNNING", 1), ("OK", True, "SUCCEEDED", 1)]
