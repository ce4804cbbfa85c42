"""Scans, projections, filters, and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.operators.clustering import write_clustered
from lakemoor.plans.registry import Mounted, query, same_sql
from lakemoor.session import scratch_path
from lakemoor.sources.files import read_path, read_with_damage, write_path

same_sql("scan_all", "P1", "SELECT * FROM {db}.lineitem")

same_sql(
    "project_expressions",
    "P2",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(l_extendedprice * (1 - l_discount), 4) AS net_price,
           round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
    FROM {db}.lineitem
    """,
)

same_sql(
    "filter_predicates",
    "P3",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM {db}.lineitem
    WHERE l_quantity BETWEEN 10 AND 20 AND (l_returnflag IN ('A', 'R') OR l_discount >= 0.09)
      AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_linestatus IS NOT NULL
    """,
)

same_sql(
    "filter_like",
    "P3",
    """
    SELECT p_partkey, p_name FROM {db}.part
    WHERE p_name LIKE '%ring' AND p_type NOT LIKE 'S%' AND NOT p_size > 40
    """,
)

same_sql(
    "case_buckets",
    "P4",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS bucket,
           CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code
    FROM {db}.orders
    """,
)


@query("P5", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(at: Mounted) -> DataFrame:
    return at.table("orders").select("o_orderstatus", "o_orderpriority").distinct()


# A text format stores no types, so the reader is told them; inference would scan the data twice.
_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query(
    "P6",
    " UNION ALL ".join(
        f"SELECT '{fmt}' AS format, * FROM customer" for fmt in ("parquet", "orc", "json", "csv")
    ),
)
def file_formats(at: Mounted) -> DataFrame:
    out = None
    for fmt in ("parquet", "orc", "json", "csv"):
        path = write_path(at.table("customer"), scratch_path(at.spark, fmt), fmt)
        schema = _CUSTOMER if fmt in ("json", "csv") else None
        df = read_path(at.spark, path, fmt, schema=schema).select(F.lit(fmt).alias("format"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "P7",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
    """,
)
def partitioned_read(at: Mounted) -> DataFrame:
    kept = at.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    path = write_path(kept, scratch_path(at.spark, "orders"), partition_by=["o_orderstatus"])
    return read_path(at.spark, path).where(F.col("o_orderstatus") == "F")


@query(
    "P7",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31' AND l_extendedprice BETWEEN 20000 AND 30000
    """,
)
def clustered_read(at: Mounted) -> DataFrame:
    # Files are ranges of a curve through both columns: either condition, and both, leave most of them out.
    lines = at.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    path = write_clustered(lines, scratch_path(at.spark, "clustered"), ["l_shipdate", "l_extendedprice"], 16)
    return read_path(at.spark, path).where(
        "l_shipdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1996-03-31' AND l_extendedprice BETWEEN 20000 AND 30000"
    )


@query(
    "P6",
    """
    SELECT 'json' AS format, CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
           CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
           CASE WHEN event_type = 'error' THEN '{"event_id": ' || event_id || ', "user_id": ' END AS damaged
    FROM events
    UNION ALL
    SELECT 'csv', CASE WHEN event_type <> 'error' THEN event_id END, CASE WHEN event_type <> 'error' THEN user_id END,
           CASE WHEN event_type = 'error' THEN event_id || ',no number' END
    FROM events
    """,
)
def damaged_rows(at: Mounted) -> DataFrame:
    # Errors are written as rows that break off, or hold no number: they come back as text.
    events, out = at.table("events"), []
    broken = {
        "json": F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "user_id": ')),
        "csv": F.concat("event_id", F.lit(",no number")),
    }
    whole = {
        "json": F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "user_id": '), "user_id", F.lit("}")),
        "csv": F.concat_ws(",", "event_id", "user_id"),
    }
    for fmt in ("json", "csv"):
        line = F.when(F.col("event_type") == "error", broken[fmt]).otherwise(whole[fmt])
        path = scratch_path(at.spark, f"damaged_{fmt}")
        events.select(line.alias("value")).write.text(path)
        found = read_with_damage(at.spark, path, fmt, "event_id bigint, user_id bigint")
        out.append(found.select(F.lit(fmt).alias("format"), "event_id", "user_id", F.col("_damaged").alias("damaged")))
    return out[0].unionByName(out[1])
