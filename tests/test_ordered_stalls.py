"""Stall state in event time against the batch result, whatever the order of delivery."""

import random
from datetime import datetime, timedelta

import pytest

from assize.operators.stalls import stall_runs
from assize.streaming import events as streams


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def events(seed, n=60):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(minutes=rng.randint(0, 3000)), rng.choice([1, 1, 2]), rng.choice(["a", "a", "b", ""]), 0.0, "") for i in range(n)]


def result(rows):
    return sorted((r.user_id, r.event_id, r.run) for r in rows.collect())


def test_shuffled_deliveries(spark):
    """All events lie within the watermark's delay, so any order gives the batch result; the state goes on between deliveries."""
    rows = events(3)
    want = result(stall_runs(frame(spark, rows), "user_id", ["ts", "event_id"], "event_type", 2).where("stalled"))
    random.Random(1).shuffle(rows)
    parts = [frame(spark, rows[i::3]) for i in range(3)]
    got = streams.delivered([*parts, streams.end_mark(spark)], lambda e: streams.ordered_stalls(e, "3 days"), streams.STATE_STORE)
    assert result(got) == want and want


def test_events_wait_for_the_watermark_and_late_ones_are_dropped(spark):
    day = lambda i, d, kind="a": (i, datetime(2024, 1, d), 1, kind, 0.0, "")
    parts = [frame(spark, [day(1, 1), day(2, 3)]), frame(spark, [day(3, 2), day(4, 9)]), frame(spark, [day(5, 4)]), streams.end_mark(spark)]
    # The second comes before the third in delivery and after it in time; the fifth comes a week behind the newest.
    got = streams.delivered(parts, lambda e: streams.ordered_stalls(e, "2 days"), streams.STATE_STORE)
    assert result(got) == [(1, 2, 3), (1, 3, 2), (1, 4, 4)]


@pytest.mark.parametrize("forget, want", [(None, [(1, 2, 2), (1, 3, 3)]), ("3 days", [(1, 2, 2)])])
def test_idle_keys_are_forgotten(spark, forget, want):
    rows = lambda *x: frame(spark, [(i, datetime(2024, 1, d), u, "a", 0.0, "") for i, d, u in x])
    parts = [rows((1, 1, 1), (2, 2, 1)), rows((9, 12, 7)), rows((3, 13, 1)), streams.end_mark(spark)]
    got = streams.delivered(parts, lambda e: streams.ordered_stalls(e, "1 hour", forget=forget), streams.STATE_STORE)
    assert result(got) == want


def test_the_callers_settings_stay(spark):
    name = next(iter(streams.STATE_STORE))
    before = spark.conf.get(name, None)
    streams.delivered([frame(spark, events(1, 3))], streams.ordered_stalls, streams.STATE_STORE)
    assert spark.conf.get(name, None) == before
