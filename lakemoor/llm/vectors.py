"""Vectors in blocks: an index of bounded shards met by bounded blocks of queries.

The index is cut into shards, the stated queries into blocks, and every shard meets every block in
groups of a bounded number of blocks, one group per task call. Each pair of a shard and a block
gives at most k rows per query, of which the best k stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemoor.session import pinned

BLOCK = 256  # queries
BLOCKS_TOGETHER = 32  # that one shard meets in one call


def clean(embeddings: DataFrame, every_row: bool = False) -> DataFrame:
    """``row`` (a number of its own), ``vec_id`` and ``vector`` (doubles) of the vectors that take part.

    With ``every_row`` those are all rows, also ones that share a vec_id or have none, but for vectors
    that are null or hold a null, a NaN or an infinity. Without it, empty vectors and rows without a
    vec_id take no part either, and of rows that share a vec_id the least vector stays.

    The numbers hold for what is written: pin the result before it is read twice.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = embeddings.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    if not every_row:
        rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")


class Named:
    """The rows of a group in the order of their vec_ids (none comes last), and what is built over them.

    ``rows`` and ``ids`` name them by their place; ``known`` says which have a vec_id.
    """

    def __init__(self, group: pa.Table, width: int, build: Callable[[np.ndarray, np.ndarray], object]) -> None:
        rows, ids = group.column("row").to_numpy(), group.column("vec_id")
        known, ids = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
        order = np.lexsort((rows, ids, ~known))
        self.rows, self.ids, self.known = rows[order], ids[order], known[order]
        self.made = build(np.arange(len(order)), matrix(group.column("vector"), width)[order])

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The place of each of ``rows`` here, -1 for one that is elsewhere."""
        order = np.argsort(self.rows)
        at = order[np.searchsorted(self.rows, rows, sorter=order).clip(max=len(order) - 1)]
        return np.where(self.rows[at] == rows, at, -1)


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles; a shorter vector counts as one with zeros behind."""
    flat = vectors.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def width_of(vectors: DataFrame) -> int:
    return max(1, vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(1))).first()[0])


def packed(rows: DataFrame, key: Column, build: Callable[[np.ndarray, np.ndarray], object], width: int) -> DataFrame:
    """One row per group of ``rows`` (see :func:`clean`): ``key``, and ``build(places, matrix)`` named and pickled."""

    def run(own: tuple, group: pa.Table) -> pa.Table:
        made = pickle.dumps(Named(group, width, build), protocol=5)
        return pa.table({"key": pa.array([own[0].as_py()], pa.int32()), "packed": pa.array([made], pa.binary())})

    named = rows.select(key.cast("int").alias("key"), "row", "vec_id", "vector")
    return named.groupBy("key").applyInArrow(run, "key int, packed binary")


def query_blocks(vectors: DataFrame, every: int, width: int) -> DataFrame:
    """The queries (vec_id divisible by ``every``) in blocks: ``block`` and ``queries``."""
    asked = vectors.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    return packed(asked, block, lambda places, rows: rows, width).toDF("block", "queries")


def search(shards: DataFrame, blocks: DataFrame, look: Callable, k: int, score: str = "double") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the best ``k`` of all shards for each query.

    ``shards``: ``shard`` and ``index`` (:func:`packed`); ``look(index, places, rows)`` yields for each
    query of a block the places and scores of its best ``k`` in that shard. ``places`` says where in
    the shard the query itself is (-1: elsewhere), which is never among them.
    """
    return ranked(meet(shards, blocks, look), k, score)


def meet(shards: DataFrame, blocks: DataFrame, look: Callable, score: str = "double") -> DataFrame:
    """``query_row``, ``query_id``, ``vec_id`` and ``score`` of all that ``look`` finds (see :func:`search`)."""
    shards, blocks = pinned(shards), pinned(blocks)
    together = max(1, -(-blocks.count() // BLOCKS_TOGETHER))
    last = shards.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]  # shards count from 0
    spread = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(together - 1))))
    asked = blocks.select(
        "block",
        "queries",
        F.pmod("block", F.lit(together)).alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"),
    )
    kind = pa.int64() if score == "long" else pa.float64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        query_rows, query_ids, ids, unknown, scores = [none], [none], [none], [np.empty(0, bool)], [np.empty(0)]
        for index in left.column("index"):
            shard: Named = pickle.loads(index.as_py())
            for block in right.column("queries"):
                asked: Named = pickle.loads(block.as_py())
                looked = look(shard.made, shard.places(asked.rows), asked.made)
                for row, query_id, (found, values) in zip(asked.rows, asked.ids, looked):
                    query_rows.append(np.full(len(found), row, np.int64))
                    query_ids.append(np.full(len(found), query_id, np.int64))
                    ids.append(shard.ids[found])
                    unknown.append(~shard.known[found])
                    scores.append(values)
        return pa.table(
            {
                "query_row": np.concatenate(query_rows),
                "query_id": np.concatenate(query_ids),
                "vec_id": pa.array(np.concatenate(ids), pa.int64(), mask=np.concatenate(unknown)),
                "score": pa.array(np.concatenate(scores), kind),
            }
        )

    met = spread.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part"))
    return met.applyInArrow(run, f"query_row long, query_id long, vec_id long, score {score}")


def ranked(met: DataFrame, k: int, score: str) -> DataFrame:
    """The ``k`` best of ``met`` for each query row; a null score comes last, ties go to the smaller vec_id."""
    best = Window.partitionBy("query_row").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("vec_id"))
    found = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast(score).alias("score"))


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best by score, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
