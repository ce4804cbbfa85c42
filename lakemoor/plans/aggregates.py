"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.operators.ordered import exact_quantiles
from lakemoor.operators.sketches import (
    daily_sketches,
    distinct_estimate,
    merged,
    quantile_estimate,
    rank_estimate,
    ranked_rows,
    without,
    write_sketches,
)
from lakemoor.plans.registry import Mounted, query, same_sql
from lakemoor.session import scratch_path
from lakemoor.sources.files import read_path

same_sql("count_all", "P20", "SELECT count(*) AS n, count(l_orderkey) AS keys FROM {db}.lineitem")

same_sql(
    "grouped_sums",
    "P21",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_net,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc,
           min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS lines
    FROM {db}.lineitem
    GROUP BY l_returnflag, l_linestatus
    """,
)

same_sql(
    "count_distinct",
    "P22",
    """
    SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value) AS amounts
    FROM {db}.events GROUP BY event_type
    """,
)


@query("P22", "SELECT event_type, true AS users_told, true AS amounts_told FROM events GROUP BY event_type")
def count_distinct_approx(at: Mounted) -> DataFrame:
    # Sketches are merged instead of distinct values. How close they come is tested apart.
    sketched = at.table("events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("users"),
        F.approx_count_distinct("value", 0.02).alias("amounts"),
    )
    return sketched.select(
        "event_type", (F.col("users") > 0).alias("users_told"), (F.col("amounts") > 0).alias("amounts_told")
    )


_ROLLUP = """
    SELECT coalesce(o_orderstatus, '(all)') AS status, coalesce(o_orderpriority, '(all)') AS priority,
           CAST({id} AS INTEGER) AS level, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM {table} GROUP BY {grouping}
"""
_DUCK_ID = "grouping(o_orderstatus, o_orderpriority)"


def _levels(at: Mounted, grouping: str) -> DataFrame:
    text = _ROLLUP.format(id="grouping_id(o_orderstatus, o_orderpriority)", table="{db}.orders", grouping=grouping)
    return at.sql(text)


@query("P23", _ROLLUP.format(id=_DUCK_ID, table="orders", grouping="ROLLUP (o_orderstatus, o_orderpriority)"))
def group_rollup(at: Mounted) -> DataFrame:
    return _levels(at, "ROLLUP (o_orderstatus, o_orderpriority)")


@query("P23", _ROLLUP.format(id=_DUCK_ID, table="orders", grouping="CUBE (o_orderstatus, o_orderpriority)"))
def group_cube(at: Mounted) -> DataFrame:
    return _levels(at, "CUBE (o_orderstatus, o_orderpriority)")


_SETS = "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@query("P23", _ROLLUP.format(id=_DUCK_ID, table="orders", grouping=_SETS))
def group_sets(at: Mounted) -> DataFrame:
    text = _ROLLUP.format(
        id="grouping_id(o_orderstatus, o_orderpriority)",
        table="{db}.orders",
        grouping="GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    )
    return at.sql(text)


same_sql(
    "having_and_filter",
    "P24",
    """
    SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
           round(coalesce(sum(o_totalprice) FILTER (WHERE o_totalprice > 200000), 0), 2) AS large_total
    FROM {db}.orders GROUP BY o_custkey HAVING count(*) > 10
    """,
)


@query(
    "P25",
    """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
           round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
    FROM lineitem GROUP BY l_returnflag
    """,
)
def quantiles_exact(at: Mounted) -> DataFrame:
    shares = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    found = exact_quantiles(at.table("lineitem"), ["l_returnflag"], "l_extendedprice", shares)
    return found.select("l_returnflag", *[F.round(name, 4).alias(name) for name in shares])


@query(
    "P25",
    """
    SELECT l_returnflag, true AS within_range FROM lineitem GROUP BY l_returnflag
    """,
)
def quantiles_approx(at: Mounted) -> DataFrame:
    # The sketch and the two ends in one pass; how close it comes to the middle is tested apart.
    price = F.col("l_extendedprice")
    sketched = at.table("lineitem").groupBy("l_returnflag").agg(
        F.percentile_approx(price, 0.5, 10000).alias("p50"), F.min(price).alias("low"), F.max(price).alias("high")
    )
    return sketched.select("l_returnflag", F.col("p50").between(F.col("low"), F.col("high")).alias("within_range"))


same_sql(
    "spread_and_correlation",
    "P25",
    """
    SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS var,
           round(corr(l_quantity, l_extendedprice), 6) AS r,
           round(covar_samp(l_quantity, l_tax), 6) AS cov
    FROM {db}.lineitem GROUP BY l_linestatus
    """,
)


@query(
    "P26",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types
    FROM events GROUP BY 1
    """,
)
def collect_types(at: Mounted) -> DataFrame:
    # A set of type codes, merged in the map tasks: it cannot grow with the number of events.
    day = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd").alias("day")
    types = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return at.table("events").groupBy(day).agg(types.alias("types"))


_TYPES = ("signup", "error", "click", "view", "purchase")
_PIVOT = ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES)


@query("P26", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_PIVOT} FROM events GROUP BY 1")
def pivot_types(at: Mounted) -> DataFrame:
    day = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd").alias("day")
    # The types of the data, each once: with more of them than Spark makes columns of, it refuses.
    return at.table("events").groupBy(day).pivot("event_type").count().na.fill(0)


@query(
    "P26",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, u.measure, u.amount FROM (
        SELECT *, unnest([{'measure': 'l_quantity', 'amount': l_quantity}, {'measure': 'l_tax', 'amount': l_tax},
                          {'measure': 'l_discount', 'amount': l_discount}]) AS u FROM lineitem)
    """,
)
def unpivot_measures(at: Mounted) -> DataFrame:
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    measures = ["l_quantity", "l_tax", "l_discount"]
    return at.table("lineitem").unpivot(ids, measures, "measure", "amount")


def _event_sketches(at: Mounted) -> DataFrame:
    """One row per day and type of event, read back from a table of sketches."""
    made = daily_sketches(at.table("events"), ["event_type"], "ts", ["user_id", "value"], ["value"])
    # The schema is given: a table without events has no file to tell it.
    return read_path(at.spark, write_sketches(made, scratch_path(at.spark, "event_sketches")), schema=made.schema)


@query(
    "P22",
    """
    WITH seen AS (SELECT *, ts < (SELECT max(ts) - INTERVAL 10 DAY FROM events)::DATE AS early FROM events),
    named AS (SELECT event_type, user_id, value, early FROM seen UNION ALL SELECT '(any)', user_id, value, early FROM seen)
    SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value) AS amounts,
           count(DISTINCT value) FILTER (NOT early) - count(DISTINCT CASE WHEN NOT early AND known THEN value END) AS new_amounts
    FROM (SELECT *, bool_or(early) OVER (PARTITION BY event_type, value) AS known FROM named)
    GROUP BY event_type
    """,
)
def distinct_by_sketch(at: Mounted) -> DataFrame:
    # Estimates from merged daily sketches, exact while a sketch holds all values (up to 2 ** LG_NOMINAL of them).
    sketches = _event_sketches(at)
    last = at.table("events").agg(F.to_date(F.max("ts") - F.expr("INTERVAL 10 DAY")).alias("day")).first()["day"]
    early = F.col("day") < F.lit(last)
    any_type = F.lit("(any)").alias("event_type")
    both = sketches.unionByName(sketches.withColumn("event_type", any_type)).drop("value_kll")
    # Both times from one pass, so that types without events in one of them, or without a time, are kept.
    values = {"early_theta": F.when(early, F.col("value_theta")), "late_theta": F.when(~early, F.col("value_theta"))}
    return merged(both.withColumns(values), ["event_type"]).select(
        "event_type",
        distinct_estimate(F.col("user_id_theta")).alias("users"),
        distinct_estimate(F.col("value_theta")).alias("amounts"),
        distinct_estimate(without(F.col("late_theta"), F.col("early_theta"))).alias("new_amounts"),
    )


_SHARES = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


@query(
    "P25",
    f"""
    WITH placed AS (
        SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place,
               count(*) OVER (PARTITION BY event_type) AS n
        FROM events WHERE value IS NOT NULL
    )
    SELECT event_type, {", ".join(f"min(value) FILTER (place >= {share} * n) AS {name}" for name, share in _SHARES.items())},
           round(avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END), 6) AS to_50
    FROM placed GROUP BY event_type
    """,
)
def quantiles_by_sketch(at: Mounted) -> DataFrame:
    # Estimates from merged daily sketches, exact while a merged sketch holds all values (up to RANKED of them).
    # A type whose values are all null has no quantiles, and no row.
    found = merged(_event_sketches(at), ["event_type"]).where(ranked_rows(F.col("value_kll")) > 0)
    shares = [quantile_estimate(F.col("value_kll"), share).alias(name) for name, share in _SHARES.items()]
    return found.select("event_type", *shares, F.round(rank_estimate(F.col("value_kll"), 50), 6).alias("to_50"))
