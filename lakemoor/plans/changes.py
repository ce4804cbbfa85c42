"""Creating, filling and changing tables in a scratch database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.operators.changes import (
    delete_rows,
    delete_touched,
    latest_per_key,
    update_rows,
    upsert,
    upsert_touched,
)
from lakemoor.plans.registry import Mounted, query
from lakemoor.session import scratch_path
from lakemoor.sources.files import read_path, write_path
from lakemoor.sources.names import quote, quote_text


@query(
    "P70",
    """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
    """,
)
def create_and_insert(at: Mounted) -> DataFrame:
    at.spark.sql("CREATE DATABASE IF NOT EXISTS lakemoor_scratch")
    path = scratch_path(at.spark, "accounts")
    target = f"lakemoor_scratch.{quote(path.rsplit('/', 1)[-1].replace('-', '_'))}"
    at.lake.sql(
        f"""
        CREATE TABLE {target} USING parquet LOCATION {quote_text(path)} AS
        SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM `{at.db}`.customer
        """
    )
    at.lake.sql(f"INSERT INTO {target} SELECT s_suppkey, s_name, s_acctbal FROM `{at.db}`.supplier")
    return at.spark.table(target)


@query(
    "P71 A8",
    """
    WITH newest AS (
        SELECT o_custkey, max(o_orderkey) AS version FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey
    ), patch AS (
        SELECT newest.o_custkey AS c_custkey, o_totalprice AS c_acctbal FROM orders JOIN newest ON o_orderkey = version
        UNION ALL SELECT s_suppkey + 1000000000, s_acctbal FROM supplier
    )
    SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM patch)
    UNION ALL SELECT c_custkey, c_acctbal FROM patch
    """,
)
def upsert_balances(at: Mounted) -> DataFrame:
    offered = at.table("orders").where("o_totalprice > 300000")
    offered = offered.selectExpr("o_custkey AS c_custkey", "o_totalprice AS c_acctbal", "o_orderkey AS version")
    known = latest_per_key(offered, ["c_custkey"], "version").drop("version")
    added = at.table("supplier").selectExpr("s_suppkey + 1000000000 AS c_custkey", "s_acctbal AS c_acctbal")
    target = at.table("customer").select("c_custkey", "c_acctbal")
    changed = upsert(target, known.unionByName(added), ["c_custkey"])
    return read_path(at.spark, write_path(changed, scratch_path(at.spark, "balances")))


@query(
    "P72",
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderpriority = '1-URGENT' THEN round(o_totalprice + 100.25, 2) ELSE o_totalprice END
               AS o_totalprice
    FROM orders
    """,
)
def update_orders(at: Mounted) -> DataFrame:
    orders = at.table("orders")
    changes = {"o_orderstatus": F.lit("X"), "o_totalprice": F.round(F.col("o_totalprice") + 100.25, 2)}
    changed = update_rows(orders, F.col("o_orderpriority") == "1-URGENT", changes)
    return changed.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("P72", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete_orders(at: Mounted) -> DataFrame:
    return delete_rows(at.table("orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000))


_BY_YEAR = "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"


@query(
    "P70 P71 P72",
    f"""
    WITH old AS ({_BY_YEAR}), span AS (SELECT max(year) AS last FROM old),
    patch AS (
        SELECT o_orderkey, 'U' AS o_orderstatus, round(o_totalprice + 1, 2) AS o_totalprice, last AS year
        FROM old, span WHERE year = last AND o_orderstatus = 'O'
        UNION ALL SELECT o_orderkey, 'M', o_totalprice, last + 1 FROM old, span WHERE year = last - 1 AND o_totalprice > 300000
    )
    SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM patch)
        AND NOT (year = (SELECT last - 2 FROM span) AND o_totalprice < 200000)
    UNION ALL SELECT * FROM patch
    """,
)
def rewrite_order_years(at: Mounted) -> DataFrame:
    # A copy by year: a patch of the last two years, some of it moved to a new one, and a delete in the year before.
    path = scratch_path(at.spark, "order_years")
    orders = at.sql(_BY_YEAR.replace("FROM orders", "FROM {db}.orders"))
    write_path(orders, path, partition_by=["year"])
    target = read_path(at.spark, path)
    last = target.agg(F.max("year")).first()[0]
    raised = target.where((F.col("year") == last) & (F.col("o_orderstatus") == "O")).select(
        "o_orderkey", F.lit("U").alias("o_orderstatus"), F.round(F.col("o_totalprice") + 1, 2).alias("o_totalprice"), "year"
    )
    moved = target.where((F.col("year") == last - 1) & (F.col("o_totalprice") > 300000)).select(
        "o_orderkey", F.lit("M").alias("o_orderstatus"), "o_totalprice", F.lit(last + 1).alias("year")
    )
    upsert_touched(target, path, raised.unionByName(moved), ["o_orderkey"], ["year"])
    few = (F.col("year") == last - 2) & (F.col("o_totalprice") < 200000)
    delete_touched(read_path(at.spark, path), path, few, ["year"])
    return read_path(at.spark, path).select(*target.columns)
