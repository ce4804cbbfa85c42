"""Approximate nearest neighbours by cosine, through an index of permutations.

A bounded set of pivots, the same everywhere, orders the space: a vector is known by the order of
its nearest pivots, and is posted under each of these with its place there. A query orders the
pivots alike, reads the postings of its own nearest ones, and ranks vectors by the footrule
distance of the two orders (the sum of the differences of places, a missing pivot counting as one
behind the last). The best share of each shard is then ranked by its exact cosine: a share at every
size, and at least ``LEAST_RANKED`` vectors, which is more than the share in a shard of less than
2,500 different ones. Every row is posted; pivots alone come from a sample of ``SAMPLED`` rows, each as far as possible from those
chosen before, so that a crowd of similar vectors gets few of them.

Recall of the five nearest against brute force, measured: README. Vectors that are null, empty,
zero or hold a null or a non-finite number take no part; vectors of unequal length are compared as
if zeros stood behind the shorter one; rows that share a vec_id are one vector, the least; an empty
table gives no rows; ties go to the smaller vec_id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import query, table
from lakemoor.llm.metric_tree import pivots_of
from lakemoor.llm.vectors import best_rows, clean, packed, query_blocks, search, width_of
from lakemoor.session import pinned

SAMPLED = 4096  # different vectors that the pivots are chosen from
PIVOTS = 256
PLACES = 64  # nearest pivots that a vector is posted under
SHARE = 0.12  # of a shard's different vectors that is ranked exactly
LEAST_RANKED = 300
SHARD = 8192


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares stay in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spread_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` unit rows of ``sample``, each with the least cosine to the nearest one so far."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(wanted, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """For each unit row the numbers of its ``places`` nearest pivots, nearest first."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :places]


class Postings:
    """Inverted files of pivots over a shard: who is posted, and at which place."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, places: int) -> None:
        # Equal vectors are posted once: very many of them must not fill what is ranked exactly.
        self.rows, owner = np.unique(rows, axis=0, return_inverse=True)
        by_owner = np.lexsort((ids, owner.ravel()))
        self.ids, self.own = ids[by_owner], np.searchsorted(owner.ravel()[by_owner], np.arange(len(self.rows) + 1))
        self.pivots = pivots
        self.places = min(places, len(pivots))
        order = nearest_pivots(_unit(self.rows), pivots, self.places)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.posted = (by_pivot // self.places).astype(np.int32)
        self.place = (by_pivot % self.places).astype(np.int32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def near(self, order: np.ndarray, wanted: int) -> np.ndarray:
        """Different vectors with the least footrule distance to a query that orders the pivots so.

        With both places known a posting saves twice the number of places behind the later one
        against two missing pivots, so the distance is a constant less the sum of what is saved.
        """
        saved = np.zeros(len(self.rows), np.int64)
        for place, pivot in enumerate(order[: self.places].tolist()):
            own = slice(self.starts[pivot], self.starts[pivot + 1])
            saved[self.posted[own]] += self.places - np.maximum(self.place[own], place)
        if wanted >= len(saved):
            return np.arange(len(saved))
        return np.argpartition(-saved, wanted - 1)[:wanted]

    def best(self, row: np.ndarray, some: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest vec_ids among the different vectors ``some``, without ``but``, and their cosines."""
        scores = cosines(row, self.rows[some])
        if len(some) > k + 1:  # each stands for one vec_id at least, and one of them may be the query
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            some, scores = some[scores >= least], scores[scores >= least]
        # Of equal vectors only the least ids can be among the best.
        ids = [self.ids[self.own[at] : self.own[at + 1]][: k + 1] for at in some.tolist()]
        scores = np.repeat(scores, [len(own) for own in ids])
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        return best_rows(ids[ids != but], scores[ids != but], k)


def cosines(row: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exactly the cosines in double precision."""
    return (rows @ row) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt(row @ row))


def nearest_by_cosine(
    embeddings: DataFrame,
    every: int = 50,
    k: int = 5,
    share: float = SHARE,
    places: int = PLACES,
    every_row: bool = False,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all other rows.
    """
    vectors = clean(embeddings, every_row)
    vectors = pinned(vectors.filter(F.exists("vector", lambda x: x != 0)))
    width = width_of(vectors)
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = spread_pivots(_unit(pivots_of(vectors, SAMPLED, width)), PIVOTS)
    shard = F.pmod(F.xxhash64("row"), F.lit(-(-n // SHARD)))
    shards = packed(vectors, shard, lambda ids, rows: Postings(ids, rows, pivots, places), width)

    def look(index: Postings, own: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wanted = max(LEAST_RANKED, int(share * len(index.rows))) + 1  # the query may be one of them
        for place, row, order in zip(own, rows, nearest_pivots(_unit(rows), index.pivots, index.places)):
            yield index.best(row, index.near(order, wanted), k, place)

    return search(shards.toDF("shard", "index"), query_blocks(vectors, every, width), look, k)


@query()
def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_cosine(table(spark, sf_dir, "embeddings"), every_row=True)
