"""Joins of the mounted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.operators.joins import (
    asof_join,
    count_below,
    count_dominated,
    dense_grid,
    having_partner,
    interval_join,
    outer_join,
    sized_join,
)
from lakemoor.plans.registry import Mounted, query, same_sql

same_sql(
    "join_inner",
    "P10",
    """
    SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
    FROM {db}.orders JOIN {db}.customer ON o_custkey = c_custkey
    """,
)


@query(
    "P11",
    """
    SELECT c_custkey, c_name, coalesce(n, 0) AS orders, coalesce(spent, 0.0) AS spent
    FROM customer LEFT JOIN (
        SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders
        GROUP BY o_custkey) ON o_custkey = c_custkey
    """,
)
def join_left(at: Mounted) -> DataFrame:
    # Orders are reduced to one row per customer before the join.
    per_customer = (
        at.table("orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    )
    customers = at.table("customer").select("c_custkey", "c_name")
    return customers.join(per_customer, "c_custkey", "left").na.fill({"orders": 0, "spent": 0.0})


@query(
    "P11",
    """
    SELECT coalesce(p_name, '(no part)') AS p_name, l_orderkey, l_linenumber, l_partkey, l_quantity
    FROM (SELECT * FROM part WHERE p_size > 30) RIGHT JOIN lineitem ON p_partkey = l_partkey
    """,
)
def join_right(at: Mounted) -> DataFrame:
    parts = at.table("part").where("p_size > 30").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = at.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return outer_join(parts, lines, ["l_partkey"], "right").na.fill("(no part)", ["p_name"])


@query(
    "P11",
    """
    SELECT coalesce(c_custkey, o_custkey) AS custkey, coalesce(c_name, '(none)') AS c_name,
           coalesce(o_orderkey, -1) AS o_orderkey
    FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN
         (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey
    """,
)
def join_full(at: Mounted) -> DataFrame:
    customers = at.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), "c_name")
    orders = at.table("orders").where("o_totalprice > 300000")
    orders = orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    joined = outer_join(customers, orders, ["custkey"], "full")
    return joined.na.fill("(none)", ["c_name"]).na.fill(-1, ["o_orderkey"])


_LARGE = "SELECT o_custkey FROM orders WHERE o_totalprice > 450000"


@query("P12", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({_LARGE})")
def join_semi(at: Mounted) -> DataFrame:
    large = at.table("orders").where("o_totalprice > 450000")
    return having_partner(at.table("customer"), large, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("P12", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({_LARGE})")
def join_anti(at: Mounted) -> DataFrame:
    large = at.table("orders").where("o_totalprice > 450000")
    without = having_partner(at.table("customer"), large, "c_custkey", "o_custkey", found=False)
    return without.select("c_custkey", "c_name")


@query(
    "P13",
    """
    SELECT c_acctbal, (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) AS suppliers_below
    FROM (SELECT DISTINCT c_acctbal FROM customer)
    """,
)
def join_inequality(at: Mounted) -> DataFrame:
    return count_below(at.table("customer"), at.table("supplier"), "c_acctbal", "s_acctbal", "suppliers_below")


@query(
    "P13",
    """
    SELECT a.o_orderkey, count(b.o_orderkey) AS earlier_and_cheaper
    FROM orders a LEFT JOIN orders b ON b.o_orderdate < a.o_orderdate AND b.o_totalprice < a.o_totalprice
    GROUP BY a.o_orderkey
    """,
)
def join_two_inequalities(at: Mounted) -> DataFrame:
    return count_dominated(at.table("orders"), "o_orderkey", "o_orderdate", "o_totalprice", "earlier_and_cheaper")


@query(
    "P13",
    """
    SELECT n.n_nationkey, y.range AS year, count(o_orderkey) AS orders
    FROM nation n CROSS JOIN (
        SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS range FROM orders) y
    LEFT JOIN (SELECT c_nationkey, year(o_orderdate) AS yr, o_orderkey
               FROM orders JOIN customer ON o_custkey = c_custkey) o
           ON o.c_nationkey = n.n_nationkey AND o.yr = y.range
    GROUP BY n.n_nationkey, y.range
    """,
)
def join_every_year(at: Mounted) -> DataFrame:
    facts = at.sql(
        """
        SELECT c_nationkey AS n_nationkey, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS orders
        FROM {db}.orders JOIN {db}.customer ON o_custkey = c_custkey GROUP BY 1, 2
        """
    )
    span = at.sql("SELECT min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last FROM {db}.orders").first()
    years = F.sequence(F.lit(span["first"]).cast("bigint"), F.lit(span["last"]).cast("bigint"))
    return dense_grid(facts, at.table("nation"), "n_nationkey", "year", years, "orders")


_STRATEGIES = ("broadcast", "merge", "shuffle_hash")


@query(
    "P14",
    f"""
    SELECT strategy, s_nationkey, lines, quantity FROM (
        SELECT s_nationkey, count(*) AS lines, sum(l_quantity) AS quantity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey)
    CROSS JOIN (VALUES {", ".join(f"('{s}')" for s in _STRATEGIES)}) v(strategy)
    """,
)
def join_strategies(at: Mounted) -> DataFrame:
    lines = at.table("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    suppliers = at.table("supplier").select("s_suppkey", "s_nationkey")
    out = None
    for strategy in _STRATEGIES:
        joined = sized_join(lines, suppliers, ["s_suppkey"], strategy=strategy)
        one = joined.groupBy("s_nationkey").agg(
            F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")
        )
        one = one.select(F.lit(strategy).alias("strategy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_TEN_MINUTES = 10 * 60 * 1_000_000


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    "P15",
    """
    SELECT e.event_id AS error_id, count(*) AS events, round(sum(p.value), 2) AS value
    FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type <> 'error'
         AND p.ts BETWEEN e.ts - INTERVAL 10 MINUTE AND e.ts
    WHERE e.event_type = 'error' GROUP BY e.event_id
    """,
)
def join_interval(at: Mounted) -> DataFrame:
    events = _micros(at.table("events"))
    points = events.where("event_type <> 'error'").select("user_id", "at", "value")
    errors = events.where("event_type = 'error'").select(
        "user_id",
        F.col("event_id").alias("error_id"),
        (F.col("at") - _TEN_MINUTES).alias("from_at"),
        F.col("at").alias("to_at"),
    )
    pairs = interval_join(points, errors, ["user_id"], "at", "from_at", "to_at", _TEN_MINUTES)
    return pairs.groupBy("error_id").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value")
    )


@query(
    "P16",
    """
    SELECT e.event_id, e.user_id, coalesce(p.value, -1.0) AS last_value
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') p
        ON p.user_id = e.user_id AND p.ts <= e.ts
    """,
)
def join_asof(at: Mounted) -> DataFrame:
    events = at.table("events").select("user_id", "ts", "event_id", "event_type", "value")
    errors = events.where("event_type = 'error'").select("user_id", "ts", "event_id", "event_type")
    known = events.where("event_type <> 'error'")
    joined = asof_join(errors, known, ["user_id"], "ts", "event_id", "value", "last_value")
    return joined.select("event_id", "user_id", F.coalesce("last_value", F.lit(-1.0)).alias("last_value"))


same_sql(
    "join_star",
    "P17",
    """
    SELECT n_name, p_brand, CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS lines,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM {db}.lineitem
    JOIN {db}.part ON l_partkey = p_partkey
    JOIN {db}.orders ON l_orderkey = o_orderkey
    JOIN {db}.customer ON o_custkey = c_custkey
    JOIN {db}.nation ON c_nationkey = n_nationkey
    GROUP BY n_name, p_brand, year(o_orderdate)
    """,
)
