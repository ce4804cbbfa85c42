"""Sorts, limits, set operations, subqueries and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.plans.registry import Mounted, query, same_sql

same_sql(
    "sorted_orders",
    "P40",
    """
    SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM {db}.orders
    ORDER BY status ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey
    """,
)

same_sql(
    "top_orders",
    "P41",
    "SELECT o_orderkey, o_totalprice FROM {db}.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)

same_sql(
    "order_page",
    "P42",
    "SELECT o_orderkey, o_custkey FROM {db}.orders ORDER BY o_orderkey LIMIT 100 OFFSET 200",
)

_CUSTOMERS = "SELECT c_nationkey AS nation FROM {db}.customer"
_SUPPLIERS = "SELECT s_nationkey AS nation FROM {db}.supplier"

same_sql("union_all", "P43", f"{_CUSTOMERS} UNION ALL {_SUPPLIERS}")
same_sql("union_distinct", "P43", f"{_CUSTOMERS} UNION {_SUPPLIERS}")
# Few nations are spread over many rows: both sides are made distinct before they meet.
same_sql(
    "intersect_distinct",
    "P44",
    f"SELECT DISTINCT nation FROM ({_CUSTOMERS}) c INTERSECT SELECT DISTINCT nation FROM ({_SUPPLIERS}) s",
)
same_sql(
    "except_distinct",
    "P44",
    f"SELECT DISTINCT nation FROM ({_CUSTOMERS}) c EXCEPT SELECT DISTINCT nation FROM ({_SUPPLIERS}) s",
)
same_sql("intersect_all", "P44", f"{_CUSTOMERS} INTERSECT ALL {_SUPPLIERS}")


@query("P44", f"{_CUSTOMERS} EXCEPT ALL {_SUPPLIERS}".replace("{db}.", ""))
def except_all(at: Mounted) -> DataFrame:
    return at.sql(_CUSTOMERS).exceptAll(at.sql(_SUPPLIERS))


same_sql(
    "with_tables",
    "P50 C1",
    """
    WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {db}.orders GROUP BY o_custkey),
         named AS (SELECT c_mktsegment, c_acctbal, total FROM {db}.customer JOIN spent ON o_custkey = c_custkey)
    SELECT c_mktsegment, count(*) AS customers, round(sum(total), 2) AS total, round(avg(c_acctbal), 4) AS balance
    FROM named GROUP BY c_mktsegment
    """,
)

same_sql(
    "above_brand_average",
    "P51",
    """
    SELECT p_partkey, p_brand, p_retailprice FROM {db}.part p
    WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM {db}.part q WHERE q.p_brand = p.p_brand)
    """,
)

same_sql(
    "subquery_exists",
    "P51",
    """
    SELECT s_suppkey, s_name FROM {db}.supplier
    WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT l_suppkey FROM {db}.lineitem WHERE l_quantity >= 50) q
                  WHERE q.l_suppkey = s_suppkey)
    """,
)

same_sql(
    "subquery_in",
    "P51",
    """
    SELECT o_orderkey, o_totalprice FROM {db}.orders
    WHERE o_custkey IN (SELECT c_custkey FROM {db}.customer WHERE c_mktsegment = 'BUILDING')
      AND o_totalprice > (SELECT avg(o_totalprice) FROM {db}.orders)
    """,
)


@query(
    "P52",
    """
    SELECT r_name, c_mktsegment, count(*) AS customers FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, c_mktsegment
    """,
)
def over_views(at: Mounted) -> DataFrame:
    for name in ("nation", "region"):
        at.lake.mount(at.db, name)
    at.spark.sql("CREATE DATABASE IF NOT EXISTS lakemoor_scratch")
    view = f"lakemoor_scratch.`{at.db}_nation_region`"
    at.spark.sql(
        f"""
        CREATE VIEW IF NOT EXISTS {view} AS
        SELECT n_nationkey, r_name FROM `{at.db}`.nation JOIN `{at.db}`.region ON n_regionkey = r_regionkey
        """
    )
    located = at.sql(f"SELECT c_mktsegment, r_name FROM {{db}}.customer JOIN {view} ON c_nationkey = n_nationkey")
    located.createOrReplaceTempView("lakemoor_located_customers")
    counted = at.spark.table("lakemoor_located_customers").groupBy("r_name", "c_mktsegment")
    return counted.agg(F.count(F.lit(1)).alias("customers"))


_NEAR_NATIONS = """
    WITH RECURSIVE {linked} AS (
        SELECT DISTINCT s.s_nationkey AS a, c.c_nationkey AS b
        FROM {db}lineitem JOIN {db}supplier s ON l_suppkey = s.s_suppkey
        JOIN {db}orders ON l_orderkey = o_orderkey JOIN {db}customer c ON o_custkey = c.c_custkey
        WHERE l_quantity >= 50 AND l_extendedprice > 90000
    ), reached(nation, steps) AS (
        SELECT n_nationkey, 0 FROM {db}nation WHERE n_regionkey = 0
        UNION {all} SELECT b, steps + 1 FROM reached JOIN {linked} ON nation = a WHERE steps < 3
    )
    SELECT nation, CAST(min(steps) AS INTEGER) AS steps FROM reached GROUP BY nation
"""


@query("P50", _NEAR_NATIONS.format(linked="linked", db="", all=""))
def reachable_nations(at: Mounted) -> DataFrame:
    # Steps along large sales, three at most. The recursive part names tables that are mounted as the rest are.
    return at.sql(_NEAR_NATIONS.format(linked="linked", db="{db}.", all="ALL"))
