"""Weighted quantiles by t-digests: states of bounded size that tasks make and later steps merge.

A digest is a row of centroids (mean and weight), finest at both ends. Each task keeps one per group that it meets
and hands on states, not rows; states meet by group and a share of the tasks, then by group, so the rows of a hot key are
never in one place. While a group has no more different values than a digest has centroids, the digest holds each value
with its whole weight and quantiles are exact; beyond, the rank of a quantile is off by about
``2 / CENTROIDS`` of the weight in the middle, and by less towards the ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemoor.sources.names import quote

CENTROIDS = 400
SHARES = 256  # of tasks, whose states meet first
HELD = 2_000_000  # centroids and waiting values a task holds before it hands on what it has
WAITING = 4096  # values of a group that are held before they are made centroids

_STATE = "means array<double>, weights array<double>"


def compressed(means: np.ndarray, weights: np.ndarray, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``centroids`` centroids (and two) for these; as they are if they have no more different means."""
    means, which = np.unique(means, return_inverse=True)
    weights = np.bincount(which.ravel(), weights, len(means))
    if len(means) <= centroids:
        return means, weights
    middle = (np.cumsum(weights) - weights / 2) / weights.sum()
    cell = np.floor(centroids * (np.arcsin(np.clip(2 * middle - 1, -1, 1)) / np.pi + 0.5)).astype(np.int64)
    begins = np.flatnonzero(np.diff(cell, prepend=-1))
    summed = np.add.reduceat(weights, begins)
    centre = np.add.reduceat(means * (weights / np.repeat(summed, np.diff(np.append(begins, len(means))))), begins)
    return centre, summed


def quantile(means: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The least mean that has at least ``share`` of the weight at or below it."""
    order = np.argsort(means, kind="stable")
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, share * upto[-1] * (1 - 1e-15), side="left")
    return float(means[order][min(at, len(order) - 1)])


def weighted_digests(df: DataFrame, keys: Sequence[str], value: str, weight: str, centroids: int = CENTROIDS) -> DataFrame:
    """``keys`` (columns of simple types) and the digest of each group: ``means`` and ``weights``.

    Rows whose value or weight is null or NaN, or whose weight is not above zero, are in no digest; a group of such rows alone has none.
    """
    names = [f"k{at}" for at in range(len(keys))]
    number = [F.col(quote(one)).cast("double") for one in (value, weight)]
    rows = df.select(*[F.col(quote(key)).alias(name) for key, name in zip(keys, names)], number[0].alias("v"), number[1].alias("w"))
    rows = rows.where("v IS NOT NULL AND NOT isnan(v) AND w > 0 AND NOT isnan(w)")
    kinds = rows.schema[: len(keys)]
    columns = "".join(f"{name} {kind.dataType.simpleString()}, " for name, kind in zip(names, kinds))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = TaskContext.get().partitionId() % SHARES
        states: dict[tuple, list[np.ndarray]] = {}
        waiting: dict[tuple, int] = {}
        held = 0
        for batch in batches:
            schema = batch.schema
            for key, v, w in _groups(batch, names):
                mine = states.setdefault(key, [np.empty(0), np.empty(0)])
                states[key] = [np.append(mine[0], v), np.append(mine[1], w)]
                waiting[key] = waiting.get(key, 0) + len(v)
                held += len(v)
                if waiting[key] > WAITING:
                    before = len(states[key][0])
                    states[key] = list(compressed(*states[key], centroids))
                    held -= before - len(states[key][0])
                    waiting[key] = 0
            if held > HELD:
                yield _told(states, schema, names, share, centroids)
                states, waiting, held = {}, {}, 0
        if states:
            yield _told(states, schema, names, share, centroids)

    def meet(group: pa.Table) -> pa.Table:
        means = group["means"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        weights = group["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((weights, means))  # states come in any order
        means, weights = compressed(means[order], weights[order], centroids)
        lists = [pa.array([one.tolist()], pa.list_(pa.float64())) for one in (means, weights)]
        own = group.slice(0, 1).drop_columns(["means", "weights"])
        return pa.table([*own.columns, *lists], names=[*own.column_names, "means", "weights"])

    states = rows.mapInArrow(partial, f"{columns}share int, {_STATE}")
    states = states.groupBy(*names, "share").applyInArrow(meet, f"{columns}share int, {_STATE}").drop("share")
    merged = states.groupBy(*names).applyInArrow(meet, f"{columns}{_STATE}")
    return merged.toDF(*keys, "means", "weights")


def _groups(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Keys, values and weights of each group in a batch."""
    if not batch.num_rows:
        return
    table = pa.Table.from_batches([batch])
    if not names:
        yield (), table["v"].to_numpy(), table["w"].to_numpy()
        return
    found = table.group_by(names).aggregate([("v", "list"), ("w", "list")]).to_pydict()
    for key, v, w in zip(zip(*(found[name] for name in names)), found["v_list"], found["w_list"]):
        yield key, np.array(v), np.array(w)


def _told(states: dict, schema: pa.Schema, names: list[str], share: int, centroids: int) -> pa.RecordBatch:
    made = [compressed(*one, centroids) for one in states.values()]
    keys = list(zip(*states)) if names else []
    columns = [pa.array(list(key), schema.field(name).type) for key, name in zip(keys, names)]
    columns.append(pa.array([share] * len(made), pa.int32()))
    columns += [pa.array([one[at].tolist() for one in made], pa.list_(pa.float64())) for at in (0, 1)]
    return pa.record_batch(columns, names=[*names, "share", "means", "weights"])


def weighted_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, shares: Mapping[str, float], centroids: int = CENTROIDS
) -> DataFrame:
    """Per group the least value that has at least each share of the group's weight at or below it."""
    digests = weighted_digests(df, keys, value, weight, centroids)
    wanted = dict(shares)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = list(zip(batch.column("means").to_pylist(), batch.column("weights").to_pylist()))
            found = [[quantile(np.array(m), np.array(w), share) for m, w in states] for share in wanted.values()]
            own = [batch.column(at) for at in range(batch.num_columns - 2)]
            yield pa.record_batch([*own, *[pa.array(one, pa.float64()) for one in found]], names=[*names, *wanted])

    names = [f"k{at}" for at in range(len(keys))]
    kinds = "".join(f"{name} {kind.dataType.simpleString()}, " for name, kind in zip(names, digests.schema[: len(keys)]))
    plain = digests.toDF(*names, "means", "weights")
    return plain.mapInArrow(read, kinds + ", ".join(f"{name} double" for name in wanted)).toDF(*keys, *wanted)
