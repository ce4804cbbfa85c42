"""Window computations, through operators that hold for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.operators.ordered import (
    top_per_group,
    with_neighbours,
    with_ranks,
    with_running,
    with_trailing_range,
    with_trailing_rows,
)
from lakemoor.plans.registry import Mounted, query


@query(
    "P30",
    """
    SELECT o_custkey, o_orderkey,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS row_number,
           rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
           round(percent_rank() OVER w, 9) AS percent_rank,
           CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS ntile
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC)
    """,
)
def ranks_per_customer(at: Mounted) -> DataFrame:
    orders = at.table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ranked = with_ranks(orders, ["o_custkey"], "o_orderdate", "o_orderkey", descending=True)
    return ranked.drop("o_orderdate").withColumn("percent_rank", F.round("percent_rank", 9))


@query(
    "P31",
    """
    SELECT event_id, user_id, coalesce(lag(value) OVER w, -1) AS previous, coalesce(lead(value) OVER w, -1) AS next,
           first_value(value) OVER f AS first, last_value(value) OVER f AS last,
           coalesce(nth_value(value, 2) OVER f, -1) AS nth
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
           f AS (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def neighbours_per_user(at: Mounted) -> DataFrame:
    events = at.table("events").select("user_id", "event_id", "ts", "value")
    found = with_neighbours(events, ["user_id"], [F.col("ts"), F.col("event_id")], "value")
    return found.drop("ts", "value").na.fill(-1.0, ["previous", "next", "nth"])


@query(
    "P32",
    """
    SELECT event_id, user_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running,
           count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS place
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def running_sums(at: Mounted) -> DataFrame:
    events = at.table("events").select("user_id", "event_id", "ts", "value")
    sums = {"running": F.col("value"), "place": F.lit(1)}
    found = with_running(events, ["user_id"], [F.col("ts"), F.col("event_id")], sums)
    return found.select("event_id", "user_id", F.round("running", 2).alias("running"), "place")


@query(
    "P32",
    """
    SELECT o_orderkey, o_custkey,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (
               PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three
    FROM orders
    """,
)
def trailing_rows(at: Mounted) -> DataFrame:
    orders = at.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    exact = F.col("o_totalprice").cast("decimal(18,2)")
    found = with_trailing_rows(orders, ["o_custkey"], order, exact, "last_three", rows=2)
    return found.select("o_orderkey", "o_custkey", F.col("last_three").cast("double").alias("last_three"))


@query(
    "P32",
    """
    SELECT event_id, user_id, count(*) OVER w AS events,
           CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER w AS DOUBLE) AS value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts
                             RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
    """,
)
def trailing_day(at: Mounted) -> DataFrame:
    events = at.table("events").select(
        "user_id",
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
    )
    day = 24 * 60 * 60 * 1_000_000
    sums = {"events": F.lit(1), "value": F.col("amount")}
    found = with_trailing_range(events, ["user_id"], "at", "event_id", day, sums)
    return found.select("event_id", "user_id", "events", F.col("value").cast("double").alias("value"))


@query(
    "P33",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, place FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER)
                  AS place FROM orders)
    WHERE place <= 3
    """,
)
def largest_orders(at: Mounted) -> DataFrame:
    orders = at.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
