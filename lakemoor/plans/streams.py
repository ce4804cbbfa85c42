"""The events table as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemoor.plans.registry import QUERIES, SUFFIX, Mounted, query
from lakemoor.session import scratch_path
from lakemoor.streaming.events import first_of_copies, interval_pairs, running_totals, sessions, windowed
from lakemoor.streaming.stateful import (
    open_sessions,
    run_keyed,
    sessions_by_timer,
    state_of,
    totals_until_silence,
)
from lakemoor.streaming.tables import (
    event_time,
    last_batch,
    newest_rows,
    run_available,
    run_batches,
    stream_table,
)


def _events(at: Mounted) -> DataFrame:
    return stream_table(at.spark, f"{at.root}/events{SUFFIX}", at.table("events").schema)


def _counted() -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value")]


@query("P80", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_rows(at: Mounted) -> DataFrame:
    return run_available(_events(at).drop("props"), "stream_rows")


@query(
    "P81 P82",
    """
    SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
           event_type, count(*) AS events, round(sum(value), 2) AS value
    FROM events GROUP BY 1, 2, 3
    """,
)
def stream_tumbling(at: Mounted) -> DataFrame:
    stream = event_time(_events(at), "ts", "10 minutes")
    found = windowed(stream, "ts", "1 hour", ["event_type"], _counted())
    return newest_rows(run_batches(found, "stream_tumbling", "update"), ["window_start", "event_type"])


@query(
    "P82",
    """
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
           count(*) AS events, round(sum(value), 2) AS value
    FROM events GROUP BY 1, 2
    """,
)
def stream_days_complete(at: Mounted) -> DataFrame:
    stream = event_time(_events(at), "ts", "10 minutes")
    return last_batch(run_batches(windowed(stream, "ts", "1 day", [], _counted()), "stream_days", "complete"))


@query(
    "P83",
    """
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS events,
           round(sum(value), 2) AS value
    FROM (SELECT value, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start
          FROM events CROSS JOIN (VALUES (0), (1), (2), (3)) v(k))
    GROUP BY window_start
    """,
)
def stream_sliding(at: Mounted) -> DataFrame:
    stream = event_time(_events(at), "ts", "10 minutes")
    found = windowed(stream, "ts", "1 hour", [], _counted(), slide="15 minutes")
    return newest_rows(run_batches(found, "stream_sliding", "update"), ["window_start"])


@query(
    "P84",
    """
    WITH marked AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), numbered AS (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked
    )
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 5 MINUTE AS window_end, user_id,
           count(*) AS events, round(sum(value), 2) AS value
    FROM numbered GROUP BY user_id, session
    """,
)
def stream_sessions(at: Mounted) -> DataFrame:
    stream = event_time(_events(at), "ts", "10 minutes")
    # Sessions have no update mode: complete mode gives the open ones as well.
    found = sessions(stream, "ts", "5 minutes", ["user_id"], _counted())
    return last_batch(run_batches(found, "stream_sessions", "complete"))


@query("P84", QUERIES["stream_sessions"].oracle)
def stream_sessions_appended(at: Mounted) -> DataFrame:
    # Each batch writes what it closed; the sessions still open at the end come from the state.
    path = scratch_path(at.spark, "stream_sessions_appended")
    stream = event_time(_events(at), "ts", "10 minutes")
    gap = 5 * 60 * 1_000_000
    closed = run_keyed(sessions_by_timer(stream, "user_id", "value", "ts", gap), "sessions", path).drop("batch")
    told = closed.where("kind = 'closed'").unionByName(open_sessions(at.spark, path, "user_id"))
    return told.select(
        F.timestamp_micros("first").cast("timestamp_ntz").alias("window_start"),
        F.timestamp_micros(F.col("last") + gap).cast("timestamp_ntz").alias("window_end"),
        "user_id",
        F.col("n").alias("events"),
        F.round("total", 2).alias("value"),
    )


@query("P85", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_without_copies(at: Mounted) -> DataFrame:
    doubled = _events(at).unionByName(_events(at)).drop("props")
    kept = first_of_copies(event_time(doubled, "ts", "10 minutes"), ["event_id"])
    return run_available(kept.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "stream_without_copies")


@query(
    "P86",
    """
    SELECT event_id, user_id, event_type, c_name, c_mktsegment
    FROM events JOIN customer ON user_id = c_custkey
    """,
)
def stream_with_customers(at: Mounted) -> DataFrame:
    # Joined per batch, as frames, so that AQE sizes the sides and splits hot users.
    customers = at.table("customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    events = _events(at).select("event_id", "user_id", "event_type")
    return run_batches(events, "stream_join", each=lambda batch: batch.join(customers, "user_id")).drop("batch")


@query(
    "P87",
    """
    SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, max(epoch_us(ts) // 1000) AS last_ms
    FROM events GROUP BY user_id
    """,
)
def stream_totals(at: Mounted) -> DataFrame:
    state = running_totals(_events(at), "user_id", "value", "ts")
    newest = newest_rows(run_batches(state, "stream_totals", "update"), ["user_id"])
    return newest.withColumn("total", F.round("total", 2))


_SILENCE_MS = 12 * 3600 * 1000


@query(
    "P81 P87",
    f"""
    WITH cut AS (SELECT max(ts) - INTERVAL 1 DAY AS day FROM events),
    waves AS (
        SELECT user_id, value, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'error' AND ts < day THEN 1 ELSE 2 END AS wave
        FROM events, cut
    ),
    marks AS (
        SELECT max(ms) FILTER (wave = 1) - 600000 AS first_mark, max(ms) - 600000 AS last_mark FROM waves
    ),
    told AS (
        SELECT waves.*, first_mark, last_mark, wave = 2 AND (ms // 60000 + 1) * 60000 <= first_mark AS late FROM waves, marks
    ),
    first AS (
        SELECT user_id, max(ms) AS last_ms, count(*) AS n, sum(value) AS total,
               max(ms) + {_SILENCE_MS} <= any_value(first_mark) AS over
        FROM told WHERE wave = 1 GROUP BY user_id
    ),
    carried AS (
        SELECT user_id, last_ms, n, total FROM first WHERE NOT over
        UNION ALL SELECT user_id, ms, 1, value FROM told WHERE wave = 2 AND NOT late
    ),
    second AS (
        SELECT user_id, max(last_ms) AS last_ms, sum(n)::BIGINT AS n, sum(total) AS total FROM carried GROUP BY user_id
    )
    SELECT 'closed' AS kind, user_id, last_ms, n, round(total, 2) AS total FROM first WHERE over
    UNION ALL
    SELECT CASE WHEN last_ms + {_SILENCE_MS} <= last_mark THEN 'closed' ELSE 'open' END, user_id, last_ms, n, round(total, 2)
    FROM second, marks
    UNION ALL
    SELECT 'late', user_id, max(ms), count(*), round(sum(value), 2) FROM told WHERE late GROUP BY user_id, ms // 60000
    """,
)
def stream_late_totals(at: Mounted) -> DataFrame:
    # Errors are delivered late: they land, with the last day, behind all other events.
    path = scratch_path(at.spark, "stream_late_totals")
    events = at.table("events").drop("props")
    last = events.agg(F.max("ts").alias("ts")).first()["ts"]
    in_time = (F.col("event_type") != "error") & (F.col("ts") < F.lit(last) - F.expr("INTERVAL 1 DAY"))
    for wave in (in_time, ~in_time):
        events.where(wave).write.mode("append").parquet(f"{path}/landed")
        stream = event_time(stream_table(at.spark, f"{path}/landed", events.schema), "ts", "10 minutes")
        totals = totals_until_silence(stream, "user_id", "value", "ts", 60_000, _SILENCE_MS)
        told = run_keyed(totals, "totals", path)
    over = told.where("kind = 'closed'").select("kind", "user_id", "last_ms", "n", "total")
    still = state_of(at.spark, path, "totals").select(F.lit("open").alias("kind"), F.col("k").alias("user_id"), "last_ms", "n", "total")
    late = told.where("kind = 'late'").groupBy("kind", "user_id", "until_ms")
    late = late.agg(F.max("last_ms").alias("last_ms"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("until_ms")
    return over.unionByName(still).unionByName(late).withColumn("total", F.round("total", 2))


@query(
    "P81",
    """
    SELECT e.event_id AS error_id, p.event_id, p.event_type, p.value, e.user_id
    FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type <> 'error'
         AND p.ts BETWEEN e.ts - INTERVAL 10 MINUTE AND e.ts
    WHERE e.event_type = 'error'
    """,
)
def stream_interval_pairs(at: Mounted) -> DataFrame:
    errors = _events(at).where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("failed_at"))
    others = _events(at).where("event_type <> 'error'").select("event_id", "event_type", "value", "user_id", "ts")
    pairs = interval_pairs(
        event_time(others, "ts", "10 minutes"), "ts", event_time(errors, "failed_at", "10 minutes"), "failed_at",
        "user_id", 10 * 60 * 1_000_000,
    )
    return run_available(pairs.select("error_id", "event_id", "event_type", "value", "user_id"), "stream_interval_pairs")
