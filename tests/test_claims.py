"""Claims against a plain loop: quotas, fair shares of a capacity, repeated claims, one tenant with nearly all jobs."""

import random
from datetime import datetime, timedelta

import pytest

from wrenchbook.operators import claims

NOW = datetime(2026, 7, 1, 12)
JOB = (
    "tenant_id string, id string, status string, priority int, retry_count int, max_retry_count int, next_retry_at timestamp_ntz, "
    "started_at timestamp_ntz, created_at timestamp_ntz, error_code string, finished_at timestamp_ntz"
)


@pytest.fixture(scope="module")
def jobs(spark):
    rng, rows = random.Random(3), []
    for n in range(1500):
        status = rng.choice(["PENDING", "RETRY_WAIT", "RETRY_WAIT", "RUNNING", "SUCCEEDED"])
        retry = NOW + timedelta(minutes=rng.randrange(-20, 20)) if status == "RETRY_WAIT" and rng.random() < 0.9 else None
        rows.append((f"t{n % 7 if n % 9 == 0 else 0}", f"j{n}", status, rng.randrange(3), rng.randrange(4), 3, retry, None, NOW - timedelta(minutes=rng.randrange(300)), "OLD", NOW))
    return rows, spark.createDataFrame(rows, JOB).repartition(5)


def ready(row, attempts=True):
    return (not attempts or row[4] < row[5]) and (row[2] == "PENDING" or (row[2] == "RETRY_WAIT" and row[6] is not None and row[6] <= NOW))


def queues(rows, attempts, order):
    out = {}
    for row in sorted((r for r in rows if ready(r, attempts)), key=order):
        out.setdefault(row[0], []).append(row[1])
    return out


def test_quota_per_tenant(spark, jobs):
    rows, table = jobs
    quota = {"t0": 200, "t1": 3, "t2": 0}
    after = claims.claim_jobs(table, NOW, spark.createDataFrame(list(quota.items()), "tenant_id string, quota int"))
    got = {r["id"]: r for r in after.collect()}
    expected = {j: at + 1 for t, own in queues(rows, True, lambda r: (r[3], r[8], r[1])).items() for at, j in enumerate(own[: quota.get(t, 0)])}
    assert {j: r["position"] for j, r in got.items() if r["claimed"]} == expected and len(got) == len(rows) and len(expected) == 203
    for row in rows:
        now = got[row[1]]
        if row[1] in expected:
            assert (now["status"], now["retry_count"], now["next_retry_at"], now["started_at"], now["error_code"], now["finished_at"]) == ("RUNNING", row[4] + 1, None, NOW, None, None)
        else:
            assert tuple(now[c] for c in ("status", "retry_count", "next_retry_at", "error_code", "finished_at")) == (row[2], row[4], row[6], "OLD", NOW)
    # What runs is not claimed again.
    again = claims.claim_jobs(after.drop("claimed", "position"), NOW, 10**6)
    assert again.where("claimed").select("id").intersect(after.where("claimed").select("id")).isEmpty()


@pytest.mark.parametrize("capacity", [0, 1, 6, 50, 10**6])
def test_capacity_is_shared_fairly(jobs, capacity):
    rows, table = jobs
    after = claims.claim_embeddings(table, NOW, 30, capacity)
    own = queues(rows, False, lambda r: (r[6] or r[8], r[8], r[1]))
    seats = sorted((at, t, j) for t, queue in own.items() for at, j in enumerate(queue[:30]))
    assert {r["id"] for r in after.where("claimed").collect()} == {j for _, _, j in seats[:capacity]}


def test_events_are_leased(spark):
    rows = [(f"t{n % 2}", f"e{n:02}", "WORK_ORDER", "WORK_ORDER_COMPLETED" if n % 5 else "WORK_ORDER_UPDATED", "PENDING" if n % 4 else "PUBLISHED", NOW - timedelta(minutes=n), NOW + timedelta(minutes=n - 15), n % 3) for n in range(30)]
    table = spark.createDataFrame(rows, "tenant_id string, event_id string, aggregate_type string, event_type string, status string, occurred_at timestamp_ntz, available_at timestamp_ntz, attempts int")
    after = {r["event_id"]: r for r in claims.claim_events(table, NOW, 3).collect()}
    fit = [r for r in rows if r[3].endswith("COMPLETED") and r[4] == "PENDING" and r[6] <= NOW]
    expected = {r[1] for t in ("t0", "t1") for r in sorted((r for r in fit if r[0] == t), key=lambda r: (r[6], r[5], r[1]))[:3]}
    assert {e for e, r in after.items() if r["claimed"]} == expected and len(expected) == 6
    assert all((r["available_at"], r["attempts"]) == ((NOW + timedelta(minutes=5), row[7] + 1) if row[1] in expected else (row[6], row[7])) for row in rows for r in [after[row[1]]])
    assert claims.claim_events(table.limit(0), NOW, 3).count() == 0
