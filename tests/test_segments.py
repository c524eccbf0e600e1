"""Positions and replay in segments of equal size, with one key that has nearly all rows of a day."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchbook.functions.ordering import SEGMENT, in_segments, with_positions
from wrenchbook.operators import events

T0 = datetime(2026, 7, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for n in range(4000):
        order = "hot" if n % 10 else f"o{n % 70}"
        action = rng.choices([*events.ACTIONS, "NOTE"], [3, 3, 3, 0.05, 0.05, 0.01, 2])[0]
        rows.append(("t", order, n, action, rng.choice([None, "why"]), T0 + timedelta(seconds=rng.randrange(20_000))))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "tenant_id string, work_order_id string, event_id long, action string, reason string, occurred_at timestamp_ntz").repartition(4)


def test_segments_are_bounded_and_ordered(log):
    _, df = log
    cut = in_segments(df, ["tenant_id", "work_order_id"], ["occurred_at", "event_id"], bits=5)
    assert cut.groupBy("work_order_id", SEGMENT).count().agg(F.max("count")).first()[0] <= 32
    hot = [(r["occurred_at"], r["event_id"], r[SEGMENT]) for r in cut.where("work_order_id = 'hot'").collect()]
    assert [s for _, _, s in sorted(hot)] == sorted(s for _, _, s in hot) and len({s for _, _, s in hot}) >= 3600 / 32


@pytest.mark.parametrize("bits", [3, 12])
def test_positions(log, bits):
    rows, df = log
    got = {r["event_id"]: r["position"] for r in with_positions(df, ["work_order_id"], ["occurred_at", "event_id"], bits=bits).collect()}
    expected = {}
    for order in {r[1] for r in rows}:
        for at, row in enumerate(sorted((r for r in rows if r[1] == order), key=lambda r: (r[5], r[2]))):
            expected[row[2]] = at + 1
    assert got == expected
    assert with_positions(df.limit(0), ["work_order_id"], ["occurred_at", "event_id"]).count() == 0


@pytest.mark.parametrize(("bits", "fan"), [(3, 4), (12, 1024)])
def test_replay_does_not_depend_on_segments(log, bits, fan):
    _, df = log
    steps, finals = events.replay(df, bits=bits, fan=fan)
    by_day, ends = events.replay(df, grain="year")
    columns = ["work_order_id", "event_id", "legal", "reason", "status_before", "status_after"]
    assert sorted(map(str, steps.select(*columns).collect())) == sorted(map(str, by_day.select(*columns).collect()))
    assert sorted(map(str, finals.collect())) == sorted(map(str, ends.collect()))
