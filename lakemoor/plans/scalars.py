"""Scalar, nested and JSON functions, and casts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.plans.registry import Mounted, query, same_sql
from lakemoor.sources.files import spread

same_sql(
    "part_strings",
    "P60",
    """
    SELECT p_partkey, upper(p_name) AS upper_name, CAST(length(p_name) AS INTEGER) AS size,
           substring(p_brand, 7, 2) AS brand_no,
           concat_ws('/', lower(p_type), p_brand) AS label, replace(p_name, ' ', '_') AS slug,
           trim(concat('  ', p_type, ' ')) AS trimmed, lpad(CAST(p_size AS STRING), 4, '0') AS padded,
           reverse(p_type) AS reversed, p_name LIKE 'small%' AS is_small
    FROM {db}.part
    """,
)


@query(
    "P60",
    """
    SELECT doc_id, len(string_split(text, ' ')) AS pieces, string_split(text, ' ')[1] AS first_piece,
           regexp_replace(text, '[0-9]+', '#', 'g') AS masked, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word,
           len(regexp_extract_all(text, '[A-Z]')) AS capitals, md5(text) AS digest
    FROM documents
    """,
)
def document_strings(at: Mounted) -> DataFrame:
    pieces = F.split("text", " ")
    return spread(at.table("documents").select("doc_id", "text")).select(
        "doc_id",
        F.size(pieces).cast("bigint").alias("pieces"),
        pieces[0].alias("first_piece"),
        F.regexp_replace("text", "[0-9]+", "#").alias("masked"),
        F.regexp_extract("text", "([A-Za-z]+)", 1).alias("first_word"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("capitals"),
        F.md5("text").alias("digest"),
    )


@query(
    "P61",
    """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q,
           dayofyear(o_orderdate) AS doy, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
           date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS days,
           strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due,
           strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS later,
           strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end
    FROM orders
    """,
)
def order_dates(at: Mounted) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return at.table("orders").select(
        "o_orderkey",
        F.year(day).cast("bigint").alias("y"),
        F.month(day).cast("bigint").alias("m"),
        F.quarter(day).cast("bigint").alias("q"),
        F.dayofyear(day).cast("bigint").alias("doy"),
        F.trunc(day, "month").cast("string").alias("month_start"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"),
        F.date_add(day, 45).cast("string").alias("due"),
        F.add_months(day, 2).cast("string").alias("later"),
        F.last_day(day).cast("string").alias("month_end"),
    )


@query(
    "P61",
    """
    SELECT event_id, hour(ts) AS h, minute(ts) AS mi, CAST(second(ts) AS BIGINT) AS s,
           date_trunc('hour', ts) AS hour_start, epoch_us(ts) AS micros, isodow(ts) AS weekday
    FROM events
    """,
)
def event_times(at: Mounted) -> DataFrame:
    return at.table("events").select(
        "event_id",
        F.hour("ts").cast("bigint").alias("h"),
        F.minute("ts").cast("bigint").alias("mi"),
        F.second("ts").cast("bigint").alias("s"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        (F.weekday(F.col("ts").cast("date")) + 1).cast("bigint").alias("weekday"),
    )


same_sql(
    "line_math",
    "P62",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands,
           CAST(ceil(l_extendedprice / l_quantity) AS BIGINT) AS unit_price, round(sqrt(l_extendedprice), 4) AS root,
           round(pow(l_discount, 2), 6) AS squared, round(ln(l_extendedprice), 6) AS log_price,
           coalesce(nullif(l_discount, 0), -1) AS discount_or, greatest(l_discount, l_tax) AS larger,
           least(l_discount, l_tax) AS smaller, abs(l_tax - l_discount) AS apart,
           CAST(sign(l_discount - l_tax) AS INTEGER) AS side
    FROM {db}.lineitem
    """,
)


@query(
    "P63",
    """
    SELECT vec_id, len(embedding) AS size,
           round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm,
           round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)),
                                         lambda p: CAST(p[1] AS DOUBLE) * p[2])), 5) AS mirrored,
           len(list_filter(embedding, lambda x: x > 0)) AS positive,
           CAST(list_max(embedding) AS DOUBLE) AS largest
    FROM embeddings
    """,
)
def vector_arrays(at: Mounted) -> DataFrame:
    vector = F.transform("embedding", lambda x: x.cast("double"))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda sum_so_far, x: sum_so_far + x)

    products = F.zip_with(vector, F.reverse(vector), lambda a, b: a * b)
    return at.table("embeddings").select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("size"),
        F.round(F.sqrt(total(F.transform(vector, lambda x: x * x))), 5).alias("norm"),
        F.round(total(products), 5).alias("mirrored"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positive"),
        F.array_max("embedding").cast("double").alias("largest"),
    )


@query(
    "P63",
    """
    SELECT label, pos - 1 AS pos, count(*) AS vectors, round(avg(CAST(x AS DOUBLE)), 6) AS mean
    FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
    GROUP BY 1, 2
    """,
)
def vector_means(at: Mounted) -> DataFrame:
    items = at.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = F.round(F.avg(F.col("x").cast("double")), 6)
    return items.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(
        F.count(F.lit(1)).alias("vectors"), mean.alias("mean")
    )


@query(
    "P64 P65",
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind,
           CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS tenfold, 2 AS entries,
           '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS packed
    FROM events
    """,
)
def event_props(at: Mounted) -> DataFrame:
    props = F.from_json("props", "map<string, bigint>")
    scaled = F.transform_values(
        F.map_concat(props, F.map_from_arrays(F.array(F.lit("user")), F.array(F.col("user_id")))),
        lambda name, v: v * 10,
    )
    packed = F.struct(F.col("event_type").alias("type"), props["k"].alias("k"))
    return at.table("events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        packed.getField("type").alias("kind"),
        scaled["k"].alias("tenfold"),
        F.size(scaled).alias("entries"),
        F.to_json(packed).alias("packed"),
    )


@query(
    "P66",
    """
    SELECT p_partkey, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no,
           coalesce(TRY_CAST(p_name AS INTEGER), -1) AS not_a_number,
           CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) AS price_text,
           CAST(p_size AS DOUBLE) AS size_double, CAST(CAST(p_partkey AS VARCHAR) AS BIGINT) AS there_and_back
    FROM part
    """,
)
def casts(at: Mounted) -> DataFrame:
    return at.table("part").select(
        "p_partkey",
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("brand_no"),
        F.coalesce(F.col("p_name").try_cast("int"), F.lit(-1)).alias("not_a_number"),
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price_text"),
        F.col("p_size").cast("double").alias("size_double"),
        F.col("p_partkey").cast("string").cast("bigint").alias("there_and_back"),
    )
