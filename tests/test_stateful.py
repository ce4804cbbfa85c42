"""Keyed state with timers over several waves of files."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lakemoor.session import scratch_path
from lakemoor.streaming.stateful import (
    _merged,
    open_sessions,
    run_keyed,
    sessions_by_timer,
    state_of,
    totals_until_silence,
)
from lakemoor.streaming.tables import event_time, stream_table

SCHEMA = "ts timestamp_ntz, k bigint, v double"
START = datetime.datetime(2024, 1, 1)
MINUTE = 60_000
US = 1_000_000


def ms(minutes):
    return int(minutes * MINUTE) + int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


class Feed:
    """A folder that rows (minute, key, value) land in; each landing is one run of the stream."""

    def __init__(self, spark, made):
        self.spark, self.made, self.path = spark, made, scratch_path(spark, "feed")

    def land(self, rows):
        data = [(START + datetime.timedelta(minutes=m), k, v) for m, k, v in rows]
        self.spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/landed")
        stream = stream_table(self.spark, f"{self.path}/landed", SCHEMA)
        return run_keyed(self.made(event_time(stream, "ts", "10 minutes")), "feed", self.path)


def told(found):
    return {(r.kind, r.k, r.last_ms, r.n, r.total) for r in found.collect()}


def test_totals_end_by_timer_and_late_rows_are_told(spark):
    feed = Feed(spark, lambda s: totals_until_silence(s, "k", "v", "ts", MINUTE, 30 * MINUTE))
    feed.land([(0, 1, 1.0), (5, 1, 2.0), (100, 2, 4.0), (3, None, 7.0)])
    left = {(r.k, r.n) for r in state_of(spark, feed.path, "totals").collect()}
    assert left == {(2, 1)}  # the watermark, at minute 90, is past minute 35
    found = feed.land([(1, 1, 8.0), (1.5, 1, 8.0), (89.99, 2, 16.0), (90.5, 2, 32.0), (95, 1, None)])
    assert told(found) == {
        ("total", 1, ms(5), 2, 3.0), ("closed", 1, ms(5), 2, 3.0), ("total", None, ms(3), 1, 7.0), ("closed", None, ms(3), 1, 7.0),
        ("total", 2, ms(100), 1, 4.0),
        ("late", 1, ms(1.5), 2, 16.0), ("late", 2, ms(89.99), 1, 16.0),
        ("total", 2, ms(100), 2, 36.0), ("total", 1, ms(95), 1, 0.0),
    }
    found = feed.land([(500, 3, 1.0)])
    assert {(r.k, r.n) for r in state_of(spark, feed.path, "totals").collect()} == {(3, 1)}
    assert {("closed", 1, ms(95), 1, 0.0), ("closed", 2, ms(100), 2, 36.0)} <= told(found)


def test_sessions_join_close_and_come_late(spark):
    feed = Feed(spark, lambda s: sessions_by_timer(s, "k", "v", "ts", 5 * 60 * US))
    feed.land([(0, 1, 1.0), (4, 1, 1.0), (20, 1, 1.0), (28, 1, 1.0), (5, 2, 1.0)])  # watermark 18
    still = {(r.first // US % 86400 // 60, r.n) for r in open_sessions(spark, feed.path, "k").collect()}
    assert still == {(20, 1), (28, 1)}
    found = feed.land([(24, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0), (30, 2, 1.0)])  # 24 joins 20 and 28
    rows = {(r.kind, r.k, r.first // US % 86400 // 60, r["last"] // US % 86400 // 60, r.n) for r in found.collect()}
    assert rows == {("closed", 1, 0, 4, 2), ("closed", 2, 5, 5, 1), ("late", 1, 2, 2, 1), ("late", 2, 2, 2, 1)}
    still = {(r.k, r.first // US % 86400 // 60, r.n) for r in open_sessions(spark, feed.path, "k").collect()}
    assert still == {(1, 20, 3), (2, 30, 1)}
    found = feed.land([(300, 9, 1.0)])
    assert [r.k for r in open_sessions(spark, feed.path, "k").collect()] == [9]
    assert found.where("kind = 'closed'").count() == 4  # each once


@pytest.mark.parametrize("waves", [1, 3])
def test_sessions_of_a_hot_key(spark, waves):
    """Two fifths of the rows in one key; waves in order of time give the sessions of all rows."""
    rnd = random.Random(waves)
    rows = sorted((round(rnd.random() * 3000, 2), 0 if rnd.random() < 0.4 else rnd.randrange(50), 1.0) for _ in range(3000))
    feed = Feed(spark, lambda s: sessions_by_timer(s, "k", "v", "ts", 5 * 60 * US))
    for at in range(waves):
        found = feed.land(rows[len(rows) * at // waves : len(rows) * (at + 1) // waves])
    assert found.where("kind = 'late'").count() == 0
    both = found.where("kind = 'closed'").drop("batch").unionByName(open_sessions(spark, feed.path, "k"))
    by_key = {}
    for m, k, v in rows:
        at = round(m * 60 * US)
        by_key.setdefault(k, []).append((at, at, 1, v))
    want = sorted((k, n, total) for k, own in by_key.items() for _, _, n, total in _merged(own, 5 * 60 * US))
    assert sorted((r.k, r.n, r.total) for r in both.collect()) == want


def test_merging():
    assert _merged([(5, 6, 1, 1.0), (0, 4, 2, 2.0), (16, 20, 1, 1.0), (17, 18, 1, 1.0)], 2) == [(0, 6, 3, 3.0), (16, 20, 2, 2.0)]
    assert _merged([(0, 0, 1, 1.0), (2, 2, 1, 1.0)], 2) == [(0, 0, 1, 1.0), (2, 2, 1, 1.0)]  # exactly the gap apart
    assert _merged([], 2) == []


def test_no_rows(spark):
    for made in (
        lambda s: sessions_by_timer(s, "k", "v", "ts", US),
        lambda s: totals_until_silence(s, "k", "v", "ts", MINUTE, MINUTE),
    ):
        feed = Feed(spark, made)
        assert feed.land([]).count() == 0
        assert feed.land([(1, 1, 1.0)]).where(F.col("kind") != "total").count() == 0
