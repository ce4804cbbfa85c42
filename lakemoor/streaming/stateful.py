"""Keyed state with event-time timers: what a key has open is state, what is over is written once.

Rows are reduced in the map tasks before they are shuffled by key, so that the task of a hot key
sees few rows of it and sees them in chunks. The processors decide themselves what is late, from
the watermark and times that carry no watermark: late rows come out as rows of their own instead
of vanishing. State needs the RocksDB store, which these streams are run with (:func:`run_keyed`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakemoor.streaming.tables import run_batches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

TOTAL, CLOSED, LATE = "total", "closed", "late"


def run_keyed(
    stream: DataFrame, label: str, path: str | None = None, each: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> DataFrame:
    """:func:`run_batches` in update mode with the state store that keyed processors need.

    With the ``path`` of an earlier run the stream goes on from that run's progress and state.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, ROCKSDB)
    try:
        return run_batches(stream, label, "update", each, path)
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


def state_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The state variable ``name`` after the last batch of a stream run under ``path``: key and value columns."""
    found = spark.read.format("statestore").option("stateVarName", name).load(f"{path}/progress")
    return found.select("key.*", "value.*")


class _Keyed(StatefulProcessor):
    """One timer a key at most, which moves when the state does."""

    def _set_timer(self, at_ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != at_ms:
                self.handle.deleteTimer(old)
            else:
                at_ms = None
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class _SilentTotals(_Keyed):
    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n bigint, total double, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        n, total, last_ms = self.totals.get() if self.totals.exists() else (0, 0.0, 0)
        before = n
        for chunk in rows:
            late = chunk[chunk["until_ms"] <= watermark]
            if len(late):
                yield _told(key, LATE, late["last_ms"], late["n"], late["total"], late["until_ms"])
            fresh = chunk[chunk["until_ms"] > watermark]
            if len(fresh):
                n, total = n + int(fresh["n"].sum()), total + float(fresh["total"].sum())
                last_ms = max(last_ms, int(fresh["last_ms"].max()))
        if n > before:
            self.totals.update((n, total, last_ms))
            self._set_timer(last_ms + self.silence_ms)
            yield _told(key, TOTAL, [last_ms], [n], [total], [last_ms + self.silence_ms])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, last_ms = self.totals.get()
        self.totals.clear()
        yield _told(key, CLOSED, [last_ms], [n], [total], [last_ms + self.silence_ms])


def _told(key, kind: str, last_ms, n, total, until_ms) -> pd.DataFrame:
    columns = {"last_ms": last_ms, "n": n, "total": total, "until_ms": until_ms}
    told = pd.DataFrame({name: np.asarray(column) for name, column in columns.items()})
    told.insert(0, "kind", kind)
    told.insert(0, "k", pd.Series([key[0]] * len(told), dtype=object))
    return told


def totals_until_silence(stream: DataFrame, key: str, value: str, at: str, grain_ms: int, silence_ms: int) -> DataFrame:
    """Running totals of each key until it is silent, with late rows told apart.

    ``stream`` has a watermark on ``at``. Rows of one key and ``grain_ms`` of event time are one. ``kind`` is ``total``
    where a key's totals changed, ``closed`` where the watermark passed ``silence_ms`` behind its last row
    (its state is dropped then; a later row begins anew), and ``late`` for rows whose grain was over at the watermark,
    which are in no total. ``until_ms`` is when the totals end, or the late grain did.
    """
    rows = stream.select(
        F.col(key).alias("k"),
        F.unix_millis(F.col(at)).alias("last_ms"),
        F.lit(1).cast("bigint").alias("n"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("total"),
    )

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            grain = np.floor_divide(table["last_ms"].to_numpy(), grain_ms)
            table = table.append_column("until_ms", pa.array((grain + 1) * grain_ms))
            sums = table.group_by(["k", "until_ms"]).aggregate([("n", "sum"), ("total", "sum"), ("last_ms", "max")])
            sums = sums.select(["k", "last_ms_max", "n_sum", "total_sum", "until_ms"])
            yield from sums.rename_columns(["k", "last_ms", "n", "total", "until_ms"]).to_batches()

    kind = rows.schema["k"].dataType.simpleString()
    columns = "last_ms bigint, n bigint, total double, until_ms bigint"
    reduced = rows.where(F.col("last_ms").isNotNull()).mapInArrow(reduce_batches, f"k {kind}, {columns}")
    kept = reduced.groupBy("k").transformWithStateInPandas(
        _SilentTotals(silence_ms), f"k {kind}, kind string, {columns}", "update", "EventTime"
    )
    return kept.withColumnRenamed("k", key)


_SESSIONS = "first array<bigint>, last array<bigint>, n array<bigint>, total array<double>"


def _merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions (first, last, n, total) joined where less than ``gap`` lies between them."""
    out: list[tuple] = []
    for first, last, n, total in sorted(sessions):
        if out and first - out[-1][1] < gap:
            start, end, rows, value = out[-1]
            out[-1] = (start, max(end, last), rows + n, value + total)
        else:
            out.append((first, last, n, total))
    return out


class _OpenSessions(_Keyed):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _SESSIONS)

    def _keep(self, sessions: list[tuple]) -> None:
        if sessions:
            self.open.update(tuple(map(list, zip(*sessions))))
            self._set_timer(-(-(min(one[1] for one in sessions) + self.gap) // 1000))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(zip(*self.open.get())) if self.open.exists() else []
        for chunk in rows:
            held = _merged(held + list(zip(*(chunk[name].tolist() for name in ("first", "last", "n", "total")))), self.gap)
        # An open session ends behind the watermark, so what ends before it has met no open one.
        late = [one for one in held if one[1] + self.gap <= watermark]
        self._keep([one for one in held if one[1] + self.gap > watermark])
        if late:
            yield _sessions(key, LATE, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(zip(*self.open.get()))
        self._keep([one for one in held if one[1] + self.gap > watermark])
        yield _sessions(key, CLOSED, [one for one in held if one[1] + self.gap <= watermark])


def _sessions(key, kind: str, sessions: list[tuple]) -> pd.DataFrame:
    told = pd.DataFrame(sessions, columns=["first", "last", "n", "total"])
    told.insert(0, "kind", kind)
    told.insert(0, "k", pd.Series([key[0]] * len(told), dtype=object))
    return told


def sessions_by_timer(stream: DataFrame, key: str, value: str, at: str, gap_us: int) -> DataFrame:
    """Sessions per key (rows less than ``gap_us`` apart), each told once: when it is closed, or too late.

    ``stream`` has a watermark on ``at``. Open sessions are intervals in state that join as rows come in between
    them; a timer closes them when the watermark has passed their end. A stretch of rows that ends
    before the watermark and meets no open session is ``late``. ``first`` and ``last`` are micros. The open
    sessions after the last batch are :func:`open_sessions`.
    """
    rows = stream.select(
        F.col(key).alias("k"),
        F.unix_micros(F.col(at)).alias("at"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"),
    )

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per stretch of a key's rows in an Arrow batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by([("k", "ascending"), ("at", "ascending")])
            key_of, when = table["k"].combine_chunks(), table["at"].to_numpy()
            same = pc.fill_null(pc.equal(key_of[1:], key_of[:-1]), False).to_numpy(zero_copy_only=False)
            same |= pc.and_(pc.is_null(key_of[1:]), pc.is_null(key_of[:-1])).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, ~same | (np.diff(when) >= gap_us)))
            ends = np.append(begins[1:], len(when))
            columns = [when[begins], when[ends - 1], ends - begins, np.add.reduceat(table["value"].to_numpy(), begins)]
            arrays = [key_of.take(pa.array(begins)), *map(pa.array, columns)]
            yield pa.record_batch(arrays, names=["k", "first", "last", "n", "total"])

    kind = rows.schema["k"].dataType.simpleString()
    columns = "first bigint, last bigint, n bigint, total double"
    reduced = rows.where(F.col("at").isNotNull()).mapInArrow(reduce_batches, f"k {kind}, {columns}")
    kept = reduced.groupBy("k").transformWithStateInPandas(
        _OpenSessions(gap_us), f"k {kind}, kind string, {columns}", "append", "EventTime"
    )
    return kept.withColumnRenamed("k", key)


def open_sessions(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The sessions that a run of :func:`sessions_by_timer` under ``path`` has left open."""
    state = state_of(spark, path, "open")
    rows = state.select(F.col("k").alias(key), F.explode(F.arrays_zip("first", "last", "n", "total")).alias("one"))
    return rows.select(key, F.lit("open").alias("kind"), "one.*")
