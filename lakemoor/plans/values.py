"""Plain values, cells, widths and text lines over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.functions.cells import elide, text_rows, widths_by_column
from lakemoor.functions.values import normalise, truncate_text
from lakemoor.plans.registry import Mounted, query

_ISO = """strftime({c}, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END"""


@query("D1", f"SELECT event_id, {_ISO.format(c='ts')} AS ts, user_id, event_type, value, props FROM events")
def plain_events(at: Mounted) -> DataFrame:
    return normalise(at.table("events"))


@query(
    "D1",
    """
    SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(embedding[pos] AS DOUBLE) AS value
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
    """,
)
def plain_vectors(at: Mounted) -> DataFrame:
    plain = normalise(at.table("embeddings"))
    return plain.select("vec_id", F.posexplode("embedding").alias("pos", "value"))


@query(
    "D1",
    """
    SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS price,
           strftime(o_orderdate, '%Y-%m-%d') AS day, lower(hex(encode(o_orderpriority))) AS code,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS nested_at, o_totalprice > 250000 AS large,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS map_key,
           CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS map_value
    FROM orders
    """,
)
def plain_types(at: Mounted) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(12,2)")
    typed = at.table("orders").select(
        "o_orderkey",
        price.alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").cast("binary").alias("code"),
        F.struct(F.col("o_orderdate").alias("at"), (F.col("o_totalprice") > 250000).alias("large")).alias("nested"),
        F.create_map("o_orderdate", price).alias("by_date"),
    )
    return normalise(typed).select(
        "o_orderkey",
        "price",
        "day",
        "code",
        F.col("nested.at").alias("nested_at"),
        F.col("nested.large").alias("large"),
        F.map_keys("by_date")[0].alias("map_key"),
        F.map_values("by_date")[0].alias("map_value"),
    )


@query(
    "D2",
    """
    SELECT doc_id,
           CASE WHEN length(text) > 4000 THEN left(text, 4000) || '…' ELSE text END AS cell,
           CASE WHEN length(text) > 4000
                THEN left(text, 4000) || chr(10) || '… [truncated, ' || length(text) || ' chars total]'
                ELSE text END AS stream
    FROM documents
    """,
)
def cut_texts(at: Mounted) -> DataFrame:
    text = F.col("text")
    return at.table("documents").select(
        "doc_id", truncate_text(text).alias("cell"), truncate_text(text, style="stream").alias("stream")
    )


@query(
    "D3",
    """
    SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' WHEN length(text) > 60 THEN left(text, 59) || '…'
                        ELSE text END AS cell
    FROM documents
    """,
)
def elided_cells(at: Mounted) -> DataFrame:
    return at.table("documents").select("doc_id", elide(F.col("text")).alias("cell"))


_PART_CELLS = """
    SELECT CAST(p_partkey AS VARCHAR) AS c0, p_name AS c1, p_brand AS c2, p_type AS c3,
           CAST(p_size AS VARCHAR) AS c4, CAST(p_retailprice AS VARCHAR) AS c5 FROM part
"""
_PART_NAMES = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    "D4",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS \"column\", "
        f"CAST(greatest({len(n)}, max(length(c{i}))) AS INTEGER) AS width FROM ({_PART_CELLS})"
        for i, n in enumerate(_PART_NAMES)
    ),
)
def widths_of_columns(at: Mounted) -> DataFrame:
    return widths_by_column(at.table("part"))


_RPADS = ", ".join(f"rpad(c{i}, CAST(w{i} AS INTEGER), ' ')" for i in range(6))
_HEADS = ", ".join(f"rpad('{n}', CAST(w{i} AS INTEGER), ' ')" for i, n in enumerate(_PART_NAMES))
_RULES = ", ".join(f"repeat('-', CAST(w{i} AS INTEGER))" for i in range(6))
_WIDTHS = ", ".join(f"greatest({len(n)}, max(length(c{i}))) AS w{i}" for i, n in enumerate(_PART_NAMES))


@query(
    "D5",
    f"""
    WITH cells AS ({_PART_CELLS}), w AS (SELECT count(*) AS n, {_WIDTHS} FROM cells)
    SELECT 'row' AS kind, concat_ws(' | ', {_RPADS}) AS line FROM cells, w
    UNION ALL SELECT 'header', concat_ws(' | ', {_HEADS}) FROM w
    UNION ALL SELECT 'rule', concat_ws('-+-', {_RULES}) FROM w
    UNION ALL SELECT 'footer', '[' || n || ' row(s)]' FROM w
    """,
)
def text_table(at: Mounted) -> DataFrame:
    table = text_rows(at.table("part"))
    edges = [("header", table.header), ("rule", table.rule), ("footer", table.footer)]
    frame = at.spark.createDataFrame(edges, "kind string, line string")
    return table.lines.select(F.lit("row").alias("kind"), "line").unionByName(frame)
