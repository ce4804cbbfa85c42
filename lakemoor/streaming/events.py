"""Stateful work on event streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

# Parts that the copies of a key are spread over before they meet.
SHARDS = 16


def windowed(stream: DataFrame, at: str, size: str, keys: Sequence[str], aggregates: Sequence[Column],
             slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``: ``window_start, window_end, keys…``."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return _with_bounds(stream.groupBy(window.alias("window"), *keys).agg(*aggregates), keys)


def sessions(stream: DataFrame, at: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Sessions per key: stretches without a pause of ``gap`` or longer.

    Events are merged to sessions in the map tasks, before they are shuffled by key.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    window = F.session_window(at, gap).alias("window")
    return _with_bounds(stream.groupBy(window, *keys).agg(*aggregates), keys)


def _with_bounds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != "window" and c not in keys]
    return df.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        *keys,
        *rest,
    )


def first_of_copies(stream: DataFrame, keys: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """Drop repeated keys that arrive within the watermark of each other.

    Copies are first dropped per input split, so that a key with very many copies does not
    arrive whole at one task; the second step sees at most ``shards`` rows of a key.
    """
    spread = stream.withColumn("_shard", F.spark_partition_id() % shards)
    once_each = spread.dropDuplicatesWithinWatermark([*keys, "_shard"]).drop("_shard")
    return once_each.dropDuplicatesWithinWatermark(list(keys))


def interval_pairs(
    points: DataFrame, point_at: str, spans: DataFrame, span_at: str, on: str, before_us: int
) -> DataFrame:
    """Pairs of two streams with equal ``on`` and ``span_at - before_us <= point_at <= span_at``.

    Both have a watermark on their time. They meet by key and by cell of ``before_us``, a span in the two cells that it
    touches, so that the rows of a hot key are spread over time. Rows that can have no more partner leave the state
    when both watermarks have passed them. Column names of the two sides must differ, except for ``on``.
    """

    def cell(at: Column) -> Column:
        micros = F.unix_micros(at)
        return F.call_function("div", micros - F.pmod(micros, F.lit(before_us)), F.lit(before_us))

    left = points.withColumn("_cell", cell(F.col(point_at))).withColumnRenamed(on, "_point_key")
    touched = F.array(cell(F.col(span_at)) - 1, cell(F.col(span_at)))
    right = spans.withColumn("_span_cell", F.explode(touched))
    met = left.join(
        right,
        (F.col("_point_key") == F.col(on))
        & (F.col("_cell") == F.col("_span_cell"))
        & (F.col(point_at) >= F.col(span_at) - F.expr(f"INTERVAL {before_us} MICROSECONDS"))
        & (F.col(point_at) <= F.col(span_at)),
    )
    return met.drop("_point_key", "_cell", "_span_cell")


def _reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key and Arrow batch."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by("k")
        reduced = sums.aggregate([("n", "sum"), ("total", "sum"), ("last_ms", "max")])
        ordered = reduced.select(["k", "n_sum", "total_sum", "last_ms_max"])
        yield from ordered.rename_columns(["k", "n", "total", "last_ms"]).to_batches()


def _count_up(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total, last_ms = state.get if state.exists else (0, 0.0, 0)
    for rows in chunks:
        n += int(rows["n"].sum())
        total += float(rows["total"].sum())
        last_ms = max(last_ms, int(rows["last_ms"].max()))
    state.update((n, total, last_ms))
    yield pd.DataFrame({"k": [key[0]], "n": [n], "total": [total], "last_ms": [last_ms]})


def running_totals(stream: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Totals per key, kept as state and emitted anew (update mode) when rows arrive.

    Input batches are reduced to one row per key before the shuffle, so the task that keeps a hot
    key sees a small part of its rows, and sees them in chunks.
    """
    rows = stream.select(
        F.col(key).alias("k"),
        F.lit(1).cast("bigint").alias("n"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("total"),
        F.unix_millis(F.col(at).cast("timestamp")).alias("last_ms"),
    )
    key_type = rows.schema["k"].dataType.simpleString()
    totals = "n bigint, total double, last_ms bigint"
    reduced = rows.mapInArrow(_reduce_batches, f"k {key_type}, {totals}")
    counted = reduced.groupBy("k").applyInPandasWithState(
        _count_up, f"k {key_type}, {totals}", totals, "update", "NoTimeout"
    )
    return counted.withColumnRenamed("k", key)
