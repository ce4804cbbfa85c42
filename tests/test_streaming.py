import datetime

import pytest
from pyspark.sql import functions as F

from lakemoor.streaming.events import first_of_copies, running_totals, sessions, windowed
from lakemoor.streaming.tables import (
    event_time,
    last_batch,
    newest_rows,
    run_available,
    run_batches,
    stream_table,
)

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def land(spark, directory, number, rows):
    """One more file, later than those before it."""
    data = [(i, at(m), u, v) for i, m, u, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(directory))
    import os
    import time

    newest = max(directory.glob("*.parquet"), key=lambda p: p.stat().st_ctime_ns)
    stamp = time.time() - 1000 + number * 10
    os.utime(newest, (stamp, stamp))


@pytest.fixture
def late(spark, tmp_path):
    """On-time files, then one whose first row is behind the watermark of the batch before."""
    directory = tmp_path / "events"
    land(spark, directory, 0, [(1, 1, 7, 1.0), (2, 30, 7, 2.0), (3, 61, 8, 4.0)])
    land(spark, directory, 1, [(4, 125, 7, 8.0), (5, 185, 8, 16.0)])
    land(spark, directory, 2, [(6, 186, 8, 0.0)])
    land(spark, directory, 3, [(7, 2, 7, 100.0), (8, 190, 7, 32.0)])
    return stream_table(spark, str(directory), SCHEMA, files_per_batch=1)


def counted():
    return [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")]


def test_late_rows_are_left_out_of_closed_windows(spark, late):
    stream = event_time(late, "ts", "10 minutes")
    found = run_available(windowed(stream, "ts", "1 hour", [], counted()), "late").orderBy("window_start").collect()
    assert [(r.window_start, r.n, r.value) for r in found] == [
        (at(0), 2, 3.0),  # event 7 came after this window was written
        (at(60), 1, 4.0),
        (at(120), 1, 8.0),
    ]


def test_complete_mode_keeps_late_rows(spark, late):
    stream = late.withColumn("ts", F.col("ts").cast("timestamp"))
    found = last_batch(run_batches(windowed(stream, "ts", "1 hour", [], counted()), "all", "complete"))
    assert {(r.window_start, r.n, r.value) for r in found.collect()} == {
        (at(0), 3, 103.0),
        (at(60), 1, 4.0),
        (at(120), 1, 8.0),
        (at(180), 3, 48.0),
    }


def test_sliding_windows(spark, tmp_path):
    land(spark, tmp_path / "e", 0, [(1, 31, 1, 1.0), (2, 500, 1, 1.0)])
    stream = event_time(stream_table(spark, str(tmp_path / "e"), SCHEMA), "ts", "1 minute")
    found = run_available(windowed(stream, "ts", "1 hour", ["user_id"], counted(), slide="30 minutes"), "sliding")
    starts = sorted(r.window_start for r in found.where("n = 1").collect())
    assert starts[:2] == [at(0), at(30)]


def test_sessions_across_batches(spark, tmp_path):
    directory = tmp_path / "e"
    land(spark, directory, 0, [(1, 0, 1, 1.0), (2, 3, 1, 1.0), (3, 1, 2, 1.0)])
    land(spark, directory, 1, [(4, 6, 1, 1.0), (5, 60, 3, 1.0)])
    stream = event_time(stream_table(spark, str(directory), SCHEMA, files_per_batch=1), "ts", "10 minutes")
    found = run_available(sessions(stream, "ts", "5 minutes", ["user_id"], counted()), "sessions").collect()
    assert {(r.user_id, r.window_start, r.window_end, r.n) for r in found} == {
        (1, at(0), at(11), 3),
        (2, at(1), at(6), 1),
    }


def test_copies_are_dropped(spark, tmp_path):
    directory = tmp_path / "e"
    hot = [(1, 0, 1, 1.0)] * 50
    land(spark, directory, 0, hot + [(2, 1, 1, 1.0)])
    land(spark, directory, 1, hot + [(3, 2, 1, 1.0), (2, 1, 1, 1.0)])
    stream = event_time(stream_table(spark, str(directory), SCHEMA, files_per_batch=1), "ts", "1 hour")
    found = run_available(first_of_copies(stream, ["event_id"]), "copies").collect()
    assert sorted(r.event_id for r in found) == [1, 2, 3]


def test_totals_over_batches(spark, late):
    state = running_totals(late, "user_id", "value", "ts")
    newest = newest_rows(run_batches(state, "totals", "update"), ["user_id"])
    found = {r.user_id: (r.n, r.total) for r in newest.collect()}
    assert found == {7: (5, 143.0), 8: (3, 20.0)}


def test_join_per_batch(spark, late):
    names = spark.createDataFrame([(7, "seven"), (9, "nine")], "user_id bigint, name string")
    found = run_batches(late, "join", each=lambda batch: batch.join(names, "user_id"))
    assert found.count() == 5 and found.select("batch").distinct().count() == 3  # one batch has no partner


def test_only_matching_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    stream = stream_table(spark, str(tmp_path / "t"), "id bigint", only="nothing-*")
    assert run_available(stream, "nothing").count() == 0
