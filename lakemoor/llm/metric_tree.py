"""Exact largest inner products by best-first search in M-trees.

Inner products become distances: every vector gets one more component that brings all of a tree to
the same length M, queries a zero, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors
are those of the largest product. A tree is a page of routing entries (a centre, the distance to
its parent's centre, a covering radius) over pages of routing entries or leaf pages of vectors with
the distances to their page's centre. A search takes pages off a heap in the order of their least
possible distance, and skips entries, without computing a distance, whose stored distance to the
parent already shows by the triangle inequality that they are too far.

The forest: a bounded number of pivots deals the vectors into shards of neighbours; what falls to
one pivot beyond a shard's size is split by a hash, so many equal vectors make many shards. A tree
holds one shard.

Components are scaled and floored to integers. Products of vectors within a bound (see ``small``)
are exact in doubles, and these vectors are in the trees. Every pair with a vector beyond it is
scored in shards and blocks of its own: doubles with a bound on their error tell which rows can be
among the best, and integers without a bound score those. A score that is too large for a bigint is
an error, as it is in the SQL; one too small for it is an error where it is among the best.

Vectors that are null, empty or hold a null or a non-finite number take no part; vectors of unequal
length are compared as if zeros stood behind the shorter one; rows that share a vec_id are one
vector, the least; an empty table gives no rows; ties go to the smaller vec_id; other columns are
not read. With ``every_row``, as the registered query has it, each row is a vector of its own: rows
that share a vec_id are candidates for each other, and each of them asks where its vec_id does;
rows without a vec_id are candidates, behind all others in ties; an empty vector counts as zeros.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import each_batch, query, table
from lakemoor.llm.vectors import best_rows, clean, matrix, meet, packed, query_blocks, ranked, width_of
from lakemoor.session import pinned

SHARD = 4096  # vectors in a tree
PAGE = 64  # entries of a routing page
LEAF = 128  # vectors of a leaf page
PIVOTS = 256  # at most; they deal vectors into shards
SLACK = 1e-6  # relative: what rounding may add to a bound
LARGEST = float(1 << 21)  # of a component in a tree, scaled
LARGEST_SQUARE = float(1 << 52)  # of a vector in a tree: no product of two is larger
SCALE = 256
BIGINT = 1 << 63


class MetricTree:
    """A bulk-loaded M-tree over rows of integers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        squares = (rows * rows).sum(axis=1)
        self.reach = float(squares.max()) if len(rows) else 0.0  # M^2
        self.ids, self.rows, self.squares = ids, rows, squares
        self.lift = np.sqrt(self.reach - squares)
        # Pages: (rows of centres, distance to the parent's centre, radius, pages below) or
        # (rows, distance to the page's centre, None, None) for a leaf.
        self.pages: list[tuple] = []
        self._rng = np.random.default_rng(len(ids))
        self.root = self._load(np.arange(len(ids)), None) if len(ids) else None

    def _distances(self, some: np.ndarray, centre: int) -> np.ndarray:
        cross = self.rows[some] @ self.rows[centre]
        gap = self.lift[some] - self.lift[centre]
        return np.sqrt(np.maximum(self.squares[some] + self.squares[centre] - 2 * cross + gap * gap, 0.0))

    def _load(self, some: np.ndarray, centre: int | None) -> int:
        """Number of the page over the rows ``some``, whose parent entry has this centre."""
        away = self._distances(some, centre) if centre is not None else np.zeros(len(some))
        if len(some) <= LEAF:
            order = np.argsort(away, kind="stable")
            self.pages.append((some[order], away[order], None, None))
            return len(self.pages) - 1
        wanted = min(PAGE, -(-2 * len(some) // LEAF))
        seeds = self._rng.choice(some, wanted, replace=False)
        to_seeds = np.stack([self._distances(some, int(seed)) for seed in seeds])
        nearest = to_seeds.argmin(axis=0)
        if np.bincount(nearest).max() > 0.9 * len(some):  # nearly equal vectors: any cut is as good
            nearest = np.arange(len(some)) * wanted // len(some)
        centres, radii, below = [], [], []
        for at in np.unique(nearest).tolist():
            own = nearest == at
            centres.append(int(seeds[at]))
            radii.append(float(to_seeds[at][own].max()))
            below.append(self._load(some[own], int(seeds[at])))
        centres = np.array(centres)
        to_parent = self._distances(centres, centre) if centre is not None else np.zeros(len(centres))
        self.pages.append((centres, to_parent, np.array(radii), below))
        return len(self.pages) - 1

    def nearest(self, row: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """The vec_ids and products of the ``k`` largest products with ``row``, without vec_id ``but``."""
        ids, scores = np.empty(0, np.int64), np.empty(0)
        if self.root is None:
            return ids, scores
        square = float(row @ row) + self.reach
        limit = np.inf  # distance of the k-th best so far
        heap: list[tuple[float, int, float]] = [(0.0, self.root, np.nan)]
        while heap:
            bound, page, to_centre = heapq.heappop(heap)
            if bound > limit:
                break
            members, to_parent, radii, below = self.pages[page]
            if to_centre == to_centre:  # not the root page
                apart = np.abs(to_centre - to_parent)
                near = apart <= limit if radii is None else apart - radii <= limit
                members = members[near]
            else:
                near = slice(None)
            products = self.rows[members] @ row
            if radii is None:
                own = self.ids[members] != but
                ids, scores = best_rows(
                    np.concatenate([ids, self.ids[members][own]]), np.concatenate([scores, products[own]]), k
                )
                if len(ids) == k:
                    limit = np.sqrt(max(square - 2 * scores[-1], 0.0))
                    limit += SLACK * (1 + limit)
                continue
            away = np.sqrt(np.maximum(square - 2 * products, 0.0))
            least = np.maximum(away - radii[near], bound)
            for bound_of, number, distance in zip(least.tolist(), np.arange(len(below))[near].tolist(), away.tolist()):
                if bound_of <= limit:
                    heapq.heappush(heap, (bound_of, below[number], distance))
        return ids, scores


class ExactRows:
    """Rows of any finite numbers, for products in integers without a bound. Equal rows are one.

    Of the vec_ids of equal rows the ``k + 1`` least are kept: no more can be among the best ``k``.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, scale: float) -> None:
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        cuts = np.cumsum(np.bincount(which.ravel(), minlength=len(self.rows)))[:-1]
        self.ids = [own[: k + 1].tolist() for own in np.split(ids[order], cuts)]
        self.k, self.scale = k, scale
        self.units, exponents = _units(self.rows, scale)
        self.powers = exponents - exponents.max()
        self.norms = np.ldexp(np.sqrt((self.units * self.units).sum(axis=1)), self.powers)
        self._whole: dict[int, list[int]] = {}

    def _integers(self, at: int) -> list[int]:
        if at not in self._whole:
            self._whole[at] = _integers(self.rows[at], self.scale)
        return self._whole[at]

    def best(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the vec_ids and products of the largest products; None for one below a bigint."""
        units, _ = _units(rows, self.scale)  # what one query's products have in common decides nothing
        error = (rows.shape[1] + 8) * 2.0**-50
        for query_id, row, unit in zip(ids.tolist(), rows, units):
            about = np.ldexp(self.units @ unit, self.powers)
            doubt = error * np.sqrt(unit @ unit) * self.norms + 1e-300
            others = np.array([own != [query_id] for own in self.ids])
            sure = np.sort((about - doubt)[others])[-self.k :]
            some = others if len(sure) < self.k else others & (about + doubt >= sure[0])
            asked, found = _integers(row, self.scale), []
            for at in np.flatnonzero(some).tolist():
                score = sum(a * b for a, b in zip(asked, self._integers(at)))
                found += [(-score, one) for one in self.ids[at] if one != query_id]
            found = sorted(found)[: self.k]
            if found and -found[0][0] >= BIGINT:
                raise OverflowError("a product among the best is too large for a bigint")
            scores = np.array([None if score > BIGINT else -score for score, _ in found], object)
            yield np.array([one for _, one in found], np.int64), scores


def _units(rows: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The integers of ``rows`` over a power of two for each row, nearly; and the exponents."""
    with np.errstate(over="ignore"):
        shift = np.where(np.isfinite(scale * rows).all(axis=1), 0, 64)
    whole = np.floor(scale * np.ldexp(rows, -shift[:, None]))
    exponents = np.frexp(np.abs(whole).max(axis=1, initial=0.0))[1]
    return np.ldexp(whole, -exponents[:, None]), exponents + shift


def _integers(row: np.ndarray, scale: float) -> list[int]:
    """``floor(scale * x)`` of every component, also where a double cannot hold it."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * row).tolist()
    return [
        int(y) if abs(y) != np.inf else int(Fraction(x) * Fraction(scale)) for x, y in zip(row.tolist(), whole)
    ]


def _scaled(rows: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * rows)


def pivots_of(vectors: DataFrame, wanted: int, width: int) -> np.ndarray:
    """At most ``wanted`` different vectors, chosen by a hash; equal ones, however many, count once."""
    different = vectors.select("vector").distinct()
    rows = different.orderBy(F.xxhash64("vector"), "vector").limit(wanted)
    return matrix(rows.toArrow().column("vector"), width) if wanted else np.zeros((0, width))


def forest(vectors: DataFrame, scale: float, width: int) -> DataFrame:
    """``shard`` and ``index`` (a pickled tree) over all ``vectors``."""
    n = vectors.count()
    pivots = _scaled(pivots_of(vectors, min(PIVOTS, -(-n // SHARD)), width), scale)
    squares = (pivots * pivots).sum(axis=1)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _scaled(matrix(pa.chunked_array([batch.column("vector")]), width), scale)
        nearest = (squares - 2 * rows @ pivots.T).argmin(axis=1).astype(np.int32)
        return pa.record_batch([*batch.columns, pa.array(nearest)], names=["row", "vec_id", "vector", "pivot"])

    dealt = pinned(vectors.mapInArrow(each_batch(deal), "row long, vec_id long, vector array<double>, pivot int"))
    counts = {row.pivot: row["count"] for row in dealt.groupBy("pivot").count().collect()}  # PIVOTS rows at most
    parts, first = {}, 0
    for pivot in sorted(counts):
        parts[pivot] = (first, -(-counts[pivot] // SHARD))
        first += parts[pivot][1]
    firsts = F.lit([parts.get(p, (0, 1))[0] for p in range(len(pivots))]).cast("array<int>")
    numbers = F.lit([parts.get(p, (0, 1))[1] for p in range(len(pivots))]).cast("array<int>")
    shard = F.get(firsts, F.col("pivot")) + F.pmod(F.xxhash64("row"), F.get(numbers, F.col("pivot")))
    if not counts:
        return vectors.sparkSession.createDataFrame([], "shard int, index binary")
    return packed(dealt, shard, lambda ids, rows: MetricTree(ids, _scaled(rows, scale)), width).toDF("shard", "index")


def largest_products(
    embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = SCALE, every_row: bool = False
) -> DataFrame:
    """The ``k`` largest inner products of ``floor(scale * x)`` for each query, against all other rows.

    Queries are the rows whose vec_id is divisible by ``every``. ``query_id``, ``rank``, ``vec_id``, ``score``.
    """
    vectors = pinned(clean(embeddings, every_row).withColumn("small", small(F.col("vector"), scale)))
    width = width_of(vectors)
    trees, large = (vectors.filter(one).select("row", "vec_id", "vector") for one in ("small", "NOT small"))

    def look(tree: MetricTree, places: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for own, row in zip(places.tolist(), _scaled(rows, scale)):
            yield tree.nearest(row, k, own)

    met = meet(forest(trees, scale, width), query_blocks(trees, every, width), look, "long")
    if large.isEmpty():
        return ranked(met, k, "long")

    def exact(some: DataFrame, asked: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-some.count() // SHARD))))
        shards = packed(some, shard, lambda ids, rows: ExactRows(ids, rows, k, scale), width)
        blocks = query_blocks(asked, every, width)
        return meet(shards.toDF("shard", "index"), blocks, lambda index, ids, rows: index.best(ids, rows), "long")

    all_pairs = met.unionByName(exact(large, vectors)).unionByName(exact(trees, large))
    best = ranked(all_pairs, k, "long")
    told = F.raise_error(F.lit("a product among the best is too small for a bigint")).cast("long")
    return best.withColumn("score", F.when(F.col("score").isNull(), told).otherwise(F.col("score")))


def small(vector: Column, scale: float) -> Column:
    """Whether all products of such vectors are exact in doubles."""
    square = F.aggregate(vector, F.lit(0.0), lambda done, x: done + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    return F.forall(vector, lambda x: F.abs(x) * scale <= LARGEST) & (square <= LARGEST_SQUARE)


@query(
    """
    WITH v AS (
      SELECT vec_id, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
)
def op3_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_products(table(spark, sf_dir, "embeddings"), every_row=True)
