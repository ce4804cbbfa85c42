"""Python functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.functions.udfs import Streaks, WordTable, elide_batch
from lakemoor.operators.digests import weighted_quantiles
from lakemoor.plans.registry import Mounted, query
from lakemoor.sources.files import spread

PARTS_PER_TASK = 64  # partitions of a table function for each task, so that tasks get about as many rows


@query(
    "P90",
    """
    SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS cell FROM documents
    """,
)
def elided_by_function(at: Mounted) -> DataFrame:
    return at.table("documents").select("doc_id", elide_batch("text").alias("cell"))


@query(
    "P91",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS weight,
           round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def weighted_prices(at: Mounted) -> DataFrame:
    # A weighted mean needs no function of its own.
    price, weight = F.col("l_extendedprice"), F.col("l_quantity")
    both = F.when(price.isNotNull(), weight)
    found = at.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(both).alias("weight"), F.round(F.try_divide(F.sum(price * weight), F.sum(both)), 4).alias("weighted_mean")
    )
    return found.where("weight IS NOT NULL")


@query(
    "P91",
    """
    WITH summed AS (
        SELECT l_returnflag, l_linestatus, l_discount, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL
    ), ran AS (
        SELECT *, sum(weight) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_discount) AS upto,
               sum(weight) OVER (PARTITION BY l_returnflag, l_linestatus) AS whole
        FROM summed
    )
    SELECT l_returnflag, l_linestatus, min(l_discount) FILTER (upto >= 0.5 * whole) AS median,
           min(l_discount) FILTER (upto >= 0.9 * whole) AS p90
    FROM ran GROUP BY l_returnflag, l_linestatus
    """,
)
def weighted_discounts(at: Mounted) -> DataFrame:
    # A digest holds these few different values exactly; what it does with many is tested apart.
    return weighted_quantiles(
        at.table("lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity", {"median": 0.5, "p90": 0.9}
    )


@query(
    "P92",
    """
    SELECT lang, word, count(*) AS uses, CAST(min(place) AS INTEGER) AS first_place FROM (
        SELECT lang, unnest(words) AS word, unnest(range(len(words))) AS place
        FROM (SELECT lang, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS words FROM documents))
    GROUP BY lang, word
    """,
)
def words_of_texts(at: Mounted) -> DataFrame:
    documents = spread(at.table("documents").select("lang", "text"))
    words = WordTable(documents.asTable())
    return words.groupBy("lang", "word").agg(
        F.sum("uses").alias("uses"), F.min("first_place").cast("int").alias("first_place")
    )


@query(
    "P92",
    """
    WITH marked AS (
        SELECT user_id, ts::DATE AS day, event_type, event_id, row_number() OVER w AS place,
               row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts, event_id) AS own
        FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)
    )
    SELECT user_id, day, event_type AS kind, arg_min(event_id, place) AS first_id, arg_max(event_id, place) AS last_id,
           count(*) AS events
    FROM marked GROUP BY user_id, day, event_type, place - own
    """,
)
def streaks_of_users(at: Mounted) -> DataFrame:
    # A partition holds many users' days, by a hash: a user with very many events is spread over as many as there are days.
    events = at.table("events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "ts")
    parts = PARTS_PER_TASK * int(at.spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("user_id", "day"), F.lit(parts)).cast("int")
    return Streaks(events.withColumn("part", part).asTable().partitionBy("part").orderBy("user_id", "day", "ts", "event_id"))
