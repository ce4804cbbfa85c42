"""Mounting, listing, name resolution and the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.functions.values import normalise
from lakemoor.operators.bounded import bounded
from lakemoor.operators.inventory import flatten_pages, mount_report, table_probe, table_sample
from lakemoor.operators.matching import exclude_names, lookup_name, resolve_unique_name
from lakemoor.plans.registry import SUFFIX, TABLES, Mounted, query
from lakemoor.session import scratch_path
from lakemoor.sources.catalog import Lake
from lakemoor.sources.files import range_source, read_path, register_path, rows_source, write_path

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in TABLES)


# -- registering and mounting ------------------------------------------------------------


def _rows_per_database(at: Mounted) -> DataFrame:
    counted = at.lake.tables(at.db).join(table_probe(at.lake, at.db), "table")
    return counted.groupBy("database").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("stored_rows")
    )


@query(
    "A1 B2",
    f"SELECT true AS registered, {len(TABLES)} AS tables, CAST(sum(n) AS BIGINT) AS stored_rows FROM ({_COUNTS})",
)
def registered_databases(at: Mounted) -> DataFrame:
    inside = _rows_per_database(at).withColumn("tables", F.col("tables").cast("int"))
    mine = exclude_names(at.lake.databases(), "database", ["default"]).where("registered")
    return mine.join(inside, "database").select("registered", "tables", "stored_rows")


@query("A3", "SELECT * FROM supplier")
def mount_table(at: Mounted) -> DataFrame:
    at.lake.mount(at.db, "supplier")
    return at.spark.table(f"{at.db}.supplier")


_REQUESTED = ("customer", "no_such_table", "orders", "Lineitems", "part")


@query(
    "A4",
    f"""
    WITH asked(position, tbl) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_REQUESTED))})
    SELECT position, asked.tbl AS "table",
           CASE WHEN c.n IS NULL THEN 'failed' ELSE 'mounted' END AS status,
           CASE WHEN c.n IS NULL THEN 'MissingTable' ELSE '' END AS error_type,
           coalesce(c.n, -1) AS row_count
    FROM asked LEFT JOIN ({_COUNTS}) c ON c.tbl = asked.tbl
    """,
)
def mount_tables(at: Mounted) -> DataFrame:
    report = at.lake.mount_many(at.db, _REQUESTED)
    counts = table_probe(at.lake, at.db, ["customer", "orders", "part"])
    return report.join(counts, "table", "left").select(
        "position",
        "table",
        "status",
        F.coalesce(F.substring_index("error", ":", 1), F.lit("")).alias("error_type"),
        F.coalesce("row_count", F.lit(-1)).alias("row_count"),
    )


@query("A5", f"""SELECT tbl AS "table", 'mounted' AS status, n AS row_count FROM ({_COUNTS})""")
def mount_database(at: Mounted) -> DataFrame:
    report = at.lake.mount_all(at.db)
    return report.join(table_probe(at.lake, at.db), "table").select("table", "status", "row_count")


@query(
    "B7",
    f"""
    WITH listed AS (SELECT tbl, n, row_number() OVER (ORDER BY tbl) AS place FROM ({_COUNTS}))
    SELECT {len(TABLES)} AS mounted_count,
           string_agg(tbl, ', ' ORDER BY place) FILTER (place <= 10) || ', … (+{len(TABLES) - 10} more)' AS mounted,
           2 AS failed_count,
           'nowhere: MissingTable' || chr(10) || 'nothing: MissingTable' AS failed,
           CAST(sum(n) AS BIGINT) AS stored_rows
    FROM listed
    """,
)
def mount_summary(at: Mounted) -> DataFrame:
    asked = ["nowhere", *sorted(TABLES), "nothing"]
    report = mount_report(at.lake.mount_many(at.db, asked), max_listed=10)
    return report.join(_rows_per_database(at), "database").select(
        F.col("mounted_count").cast("int").alias("mounted_count"),
        "mounted",
        F.col("failed_count").cast("int").alias("failed_count"),
        F.regexp_replace("failed", ": table [^\n]*", "").alias("failed"),
        "stored_rows",
    )


# -- sources and sinks -------------------------------------------------------------------


@query("A7", "SELECT * FROM part")
def read_by_path(at: Mounted) -> DataFrame:
    return read_path(at.spark, f"{at.root}/part{SUFFIX}")


@query("A8", "SELECT * FROM customer")
def write_and_read_back(at: Mounted) -> DataFrame:
    path = write_path(at.table("customer"), scratch_path(at.spark, "customer"))
    return read_path(at.spark, path)


@query("A9", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def register_written_path(at: Mounted) -> DataFrame:
    at.spark.sql("CREATE DATABASE IF NOT EXISTS lakemoor_scratch")
    path = scratch_path(at.spark, "supplier")
    write_path(at.table("supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    target = register_path(at.spark, ("lakemoor_scratch", name), path, exist_ok=False)
    return at.spark.table(target)


_PRIORITIES = ((1, "1-URGENT"), (2, "2-HIGH"), (3, "3-MEDIUM"), (4, "4-NOT SPECIFIED"), (5, "5-LOW"))


@query(
    "A10",
    f"""
    WITH codes(code, label) AS (VALUES {", ".join(f"({c}, '{t}')" for c, t in _PRIORITIES)})
    SELECT code, label, count(o_orderkey) AS orders
    FROM codes LEFT JOIN orders ON o_orderpriority = label GROUP BY code, label
    """,
)
def rows_as_table(at: Mounted) -> DataFrame:
    codes = rows_source(at.spark, _PRIORITIES, "code int, label string")
    per_label = at.table("orders").groupBy(F.col("o_orderpriority").alias("label")).count()
    return codes.join(per_label, "label", "left").select(
        "code", "label", F.coalesce("count", F.lit(0)).alias("orders")
    )


@query(
    "A11",
    """
    SELECT r.range AS line, count(l_linenumber) AS lines
    FROM range(0, 10) r LEFT JOIN lineitem ON l_linenumber = r.range GROUP BY r.range
    """,
)
def range_as_table(at: Mounted) -> DataFrame:
    per_line = at.table("lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("id")).count()
    return range_source(at.spark, 0, 10).join(per_line, "id", "left").select(
        F.col("id").alias("line"), F.coalesce("count", F.lit(0)).alias("lines")
    )


@query("A12", "SELECT * FROM orders")
def table_by_name(at: Mounted) -> DataFrame:
    at.lake.mount(at.db, "orders")
    return at.spark.table(f"`{at.db}`.`orders`")


# -- names and listings ------------------------------------------------------------------


@query(
    "B1",
    """
    SELECT p_partkey, p_brand FROM part
    WHERE lower(p_brand) NOT IN ('brand#1', 'brand#2', 'brand#25')
    """,
)
def exclude_listed_names(at: Mounted) -> DataFrame:
    parts = at.table("part").select("p_partkey", "p_brand")
    return exclude_names(parts, "p_brand", ["BRAND#1", " brand#2 ", "", "Brand#25"])


@query(
    "B1",
    """
    SELECT c_custkey, c_mktsegment FROM customer
    WHERE lower(c_name) NOT IN (
        SELECT lower(replace(s_name, 'Supplier', 'CUSTOMER')) FROM supplier)
    """,
)
def exclude_names_of_frame(at: Mounted) -> DataFrame:
    barred = at.table("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER")).alias("name"))
    return exclude_names(at.table("customer"), "c_name", barred).select("c_custkey", "c_mktsegment")


@query(
    "B3",
    f"""
    SELECT c.tbl AS "table", true AS mounted, c.n AS row_count, d.columns AS column_count
    FROM ({_COUNTS}) c
    JOIN (SELECT table_name, CAST(count(*) AS INTEGER) AS columns
          FROM information_schema.columns GROUP BY table_name) d ON d.table_name = c.tbl
    """,
)
def list_tables(at: Mounted) -> DataFrame:
    probe = table_probe(at.lake, at.db)
    return at.lake.tables(at.db).join(probe, "table").select("table", "mounted", "row_count", "column_count")


@query(
    "B4",
    """
    WITH known AS (
        SELECT c_name AS name, c_custkey AS id FROM customer
        UNION ALL SELECT p_name, p_partkey FROM part
    ), asked AS (
        SELECT 'customer' AS kind, c_custkey AS n, upper(c_name) AS name, CAST(NULL AS BIGINT) AS id FROM customer
        UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part
        UNION ALL SELECT 'supplier', s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN s_suppkey END FROM supplier
    ), entries AS (
        SELECT lower(name) AS folded, count(*) AS matches, min(id) AS first_id FROM known GROUP BY 1
    )
    SELECT kind, n,
           CASE WHEN id IS NOT NULL THEN id WHEN matches = 1 THEN first_id ELSE -1 END AS resolved_id,
           CASE WHEN id IS NOT NULL THEN 'given' WHEN matches IS NULL THEN 'not found'
                WHEN matches = 1 THEN 'resolved'
                ELSE 'ambiguous (' || CAST(matches AS VARCHAR) || ')' END AS status
    FROM asked LEFT JOIN entries ON lower(name) = folded
    """,
)
def resolve_names(at: Mounted) -> DataFrame:
    customer, part, supplier = at.table("customer"), at.table("part"), at.table("supplier")
    known = customer.selectExpr("c_name AS name", "c_custkey AS id").unionByName(
        part.selectExpr("p_name AS name", "p_partkey AS id")
    )
    none = "CAST(NULL AS BIGINT) AS id"
    asked = (
        customer.selectExpr("'customer' AS kind", "c_custkey AS n", "upper(c_name) AS name", none)
        .unionByName(part.selectExpr("'part' AS kind", "p_partkey AS n", "p_name AS name", none))
        .unionByName(
            supplier.selectExpr(
                "'supplier' AS kind", "s_suppkey AS n", "s_name AS name", "IF(s_acctbal < 0, s_suppkey, NULL) AS id"
            )
        )
    )
    found = resolve_unique_name(asked, known)
    return found.select("kind", "n", F.coalesce("resolved_id", F.lit(-1)).alias("resolved_id"), "status")


@query(
    "B5",
    """
    WITH known AS (
        SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS place FROM part
    ), asked AS (
        SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name)
                               WHEN p_size > 5 THEN p_name ELSE p_name || '!' END AS name FROM part
    ), folded AS (SELECT lower(name) AS f, arg_min(name, place) AS first_name FROM known GROUP BY 1),
    exact AS (SELECT DISTINCT name AS e FROM known)
    SELECT p_partkey, name, coalesce(e, first_name, '(none)') AS found
    FROM asked LEFT JOIN exact ON name = e LEFT JOIN folded ON lower(name) = f
    """,
)
def lookup_names(at: Mounted) -> DataFrame:
    part = at.table("part")
    known = part.selectExpr("IF(p_size > 25, upper(p_name), p_name) AS name", "p_partkey AS place")
    spelled = "CASE WHEN p_size > 40 THEN upper(p_name) WHEN p_size > 5 THEN p_name ELSE p_name || '!' END AS name"
    found = lookup_name(part.selectExpr("p_partkey", spelled), known, "place")
    return found.select("p_partkey", "name", F.coalesce("found", F.lit("(none)")).alias("found"))


@query(
    "B6",
    f"""
    SELECT d.table_name AS "table", CAST(d.ordinal_position - 1 AS INTEGER) AS position,
           d.column_name AS "column",
           CASE d.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END AS type,
           c.n AS row_count
    FROM information_schema.columns d JOIN ({_COUNTS}) c ON c.tbl = d.table_name
    """,
)
def catalog_columns(at: Mounted) -> DataFrame:
    counts = table_probe(at.lake, at.db).select("table", "row_count")
    return at.lake.columns(at.db).join(counts, "table").select("table", "position", "column", "type", "row_count")


@query(
    "B6",
    f"""
    SELECT key, CASE key WHEN 'default_limit' THEN '100' WHEN 'stored_rows' THEN CAST(stored AS VARCHAR)
                         ELSE 'given' END AS value
    FROM (VALUES ('spark_version'), ('master'), ('app_id'), ('current_database'), ('default_limit'),
                 ('databases'), ('registered'), ('stored_rows')) v(key),
         (SELECT sum(n) AS stored FROM ({_COUNTS}))
    """,
)
def session_snapshot(at: Mounted) -> DataFrame:
    total = table_probe(at.lake, at.db).agg(F.sum("row_count").cast("string").alias("value"))
    entries = at.lake.snapshot().unionByName(total.select(F.lit("stored_rows").alias("key"), "value"))
    # What depends on the session is only checked to be there.
    fixed = F.col("key").isin("default_limit", "stored_rows")
    return entries.select("key", F.when(fixed, F.col("value")).when(F.col("value") != "", "given").alias("value"))


@query(
    "B8",
    """
    SELECT event_id // 100 AS seq,
           CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS pos,
           CAST(event_id AS VARCHAR) AS id, event_type AS "displayName"
    FROM events
    """,
)
def flatten_listing_pages(at: Mounted) -> DataFrame:
    # A page holds the events of a hundred consecutive ids, so no page grows with the table.
    item = F.struct(
        F.col("event_id").alias("place"),
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("displayName"),
    )
    landed = (
        at.table("events")
        .groupBy(F.floor(F.col("event_id") / 100).alias("seq"))
        .agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("value"))).alias("body"))
    )
    return flatten_pages(landed, "id string, displayName string")


@query(
    "B9 P20",
    f"""
    SELECT c.tbl AS "table", c.n AS row_count, d.columns AS column_count
    FROM ({_COUNTS}) c
    JOIN (SELECT table_name, CAST(count(*) AS INTEGER) AS columns
          FROM information_schema.columns GROUP BY table_name) d ON d.table_name = c.tbl
    """,
)
def probe_tables(at: Mounted) -> DataFrame:
    return table_probe(at.lake, at.db).select("table", "row_count", "column_count")


_SAMPLE = ("doc_id", "text", "lang", "source", "n_chars")
_SAMPLE_CELLS = ", ".join(
    f"CASE WHEN length(CAST({c} AS VARCHAR)) > 40 THEN left(CAST({c} AS VARCHAR), 39) || '…' "
    f"ELSE CAST({c} AS VARCHAR) END AS {c}"
    for c in _SAMPLE
)
_SAMPLE_WIDTHS = ", ".join(f"greatest({len(c)}, max(length({c}))) AS w_{c}" for c in _SAMPLE)
_SAMPLE_PADS = ", ".join(f"rpad({c}, CAST(w_{c} AS INTEGER), ' ')" for c in _SAMPLE)


@query(
    "B9",
    f"""
    WITH cells AS (SELECT {_SAMPLE_CELLS} FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5)),
         widths AS (SELECT {_SAMPLE_WIDTHS} FROM cells)
    SELECT concat_ws(' | ', {_SAMPLE_PADS}) AS line FROM cells, widths
    """,
)
def sample_table(at: Mounted) -> DataFrame:
    return table_sample(at.lake, at.db, "documents", order_by=["doc_id"]).lines


# -- SQL surface -------------------------------------------------------------------------

STAR_REVENUE = """
    SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM {db}.lineitem
    JOIN {db}.orders ON l_orderkey = o_orderkey
    JOIN {db}.customer ON o_custkey = c_custkey
    JOIN {db}.nation ON c_nationkey = n_nationkey
    JOIN {db}.region ON n_regionkey = r_regionkey
    GROUP BY r_name
    ORDER BY r_name
"""


@query("C1 P17", STAR_REVENUE.replace("{db}.", ""))
def star_revenue(at: Mounted) -> DataFrame:
    return at.sql(STAR_REVENUE)


@query(
    "C2 P41",
    """
    SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
    """,
)
def bounded_rows(at: Mounted) -> DataFrame:
    df = at.sql(
        "SELECT o_orderkey, o_totalprice, o_orderdate FROM {db}.orders ORDER BY o_totalprice DESC, o_orderkey"
    )
    return bounded(normalise(df), 25).rows()


@query(
    "C2",
    f"""SELECT tbl AS "table", least(n, 100) AS row_count, n > 100 AS truncated, 100 AS "limit" FROM ({_COUNTS})""",
)
def bounded_summaries(at: Mounted) -> DataFrame:
    out = None
    for name in TABLES:
        one = bounded(at.table(name), at.lake.default_limit).summary().select(F.lit(name).alias("table"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "C4",
    """
    SELECT * FROM (VALUES
        (0, true, true, '', 5, false), (1, true, true, '', 10, true),
        (2, false, false, 'TABLE_OR_VIEW_NOT_FOUND', -1, false),
        (3, true, false, '', 0, false), (4, false, false, 'DIVIDE_BY_ZERO', -1, false),
        (5, false, false, 'UNRESOLVED_COLUMN.WITH_SUGGESTION', -1, false), (6, true, true, '', 1, false)
    ) t(seq, ok, has_result, error_condition, row_count, truncated)
    """,
)
def statement_outcomes(at: Mounted) -> DataFrame:
    texts = [
        "SELECT * FROM {db}.region ORDER BY r_regionkey",
        "SELECT * FROM {db}.lineitem ORDER BY l_orderkey, l_linenumber",
        "SELECT * FROM {db}.no_such_table",
        "CREATE DATABASE IF NOT EXISTS lakemoor_scratch",
        "SELECT sum(o_totalprice) / (count(*) - count(*)) AS x FROM {db}.orders",
        "SELECT no_such_column FROM {db}.orders",
        "SELECT count(*) AS n FROM {db}.orders",
    ]
    outcomes = at.lake.outcomes([t.replace("{db}", f"`{at.db}`") for t in texts], limit=10)
    return outcomes.select(
        "seq",
        "ok",
        "has_result",
        F.coalesce("error_condition", F.lit("")).alias("error_condition"),
        F.coalesce("row_count", F.lit(-1)).cast("int").alias("row_count"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


@query(
    "C5",
    f"""SELECT tbl AS "table", true AS mounted_before, false AS mounted_after, n AS stored_rows FROM ({_COUNTS})""",
)
def reset_lake(at: Mounted) -> DataFrame:
    # In a session of its own, so that the caller's temporary views survive.
    lake = Lake(at.spark.newSession())
    name = lake.add_database(at.root, name=f"{at.db}_reset", suffix=SUFFIX)
    lake.mount_all(name)
    before = {r["table"]: r["mounted"] for r in lake.tables(name).collect()}
    lake.reset()
    rows = [(t, was, lake.is_mounted(name, t)) for t, was in before.items()]
    states = at.spark.createDataFrame(rows, "table string, mounted_before boolean, mounted_after boolean")
    stored = None
    for t in before:
        one = read_path(at.spark, f"{at.root}/{t}{SUFFIX}").agg(F.count(F.lit(1)).alias("stored_rows"))
        one = one.select(F.lit(t).alias("table"), "stored_rows")
        stored = one if stored is None else stored.unionByName(one)
    return states.join(stored, "table")
