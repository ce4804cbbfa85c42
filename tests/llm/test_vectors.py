import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemoor.llm import metric_tree, permutation


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x"))


@pytest.fixture(scope="module")
def rows():
    """Random vectors, a third of them equal, and all that takes no part."""
    rng = np.random.default_rng(4)
    out = [(i, [float(v) for v in rng.normal(size=8)], 0) for i in range(400)]
    out += [(400 + i, [0.5] * 8, 1) for i in range(200)]
    out += [(700, None, 0), (701, [], 0), (702, [None] + [1.0] * 7, 0), (703, [float("nan")] * 8, 0),
            (704, [float("inf")] * 8, 0), (705, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (1, out[1][1], 0),
            (750, [0.0] * 8, 0)]
    return out


def plain(rows):
    vectors = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = np.array([*np.float32(v), *[0.0] * (8 - len(v))], float)
    return vectors


def test_exact_products(spark, rows, monkeypatch):
    monkeypatch.setattr(metric_tree, "SHARD", 60)
    vectors = {i: np.floor(256 * v) for i, v in plain(rows).items()}
    want = []
    for q in sorted(i for i in vectors if i % 50 == 0):
        scores = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
        want += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scores)]
    found = metric_tree.largest_products(table(spark, rows))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert found.dtypes[3] == ("score", "bigint")


@pytest.mark.parametrize("share", [0.05, 1.0])
def test_exact_products_of_large_vectors(spark, monkeypatch, share):
    """Components beyond what a tree takes: products in integers, some of them beyond 2^53."""
    monkeypatch.setattr(metric_tree, "SHARD", 60)
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(300, 8))
    rows[rng.random(300) < share, 3] = 10_000.0
    rows[[7, 50, 51, 52]] = [12345.678, -9000.0, 1e6, 3e6, 0.0, 1.0, -1.0, 8192.01]
    rows[100] = [8192.5] + [0.0] * 7
    rows[101:120] = rows[101]
    rows = np.float32(rows).astype(float)
    whole = [[int(np.floor(256 * x)) for x in row] for row in rows]
    want = []
    for q in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(300) if i != q)[:5]
        want += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scores)]
    found = metric_tree.largest_products(table(spark, [(i, row.tolist(), 0) for i, row in enumerate(rows)]))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert max(score for *_, score in want) > 1 << 53


def test_products_beyond_a_bigint(spark):
    rows = [(0, [1e30, 0.0], 0), (1, [-1e30, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 2.0], 0)]
    found = metric_tree.largest_products(table(spark, rows), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 2, 0), (0, 2, 3, 0)]
    for more, told in (([1e30, 0.0], "too large"), (None, "too small")):
        with pytest.raises(Exception, match=told):
            metric_tree.largest_products(table(spark, [*rows, (4, more, 0)]), k=3).collect()
    index = metric_tree.ExactRows(np.array([1, 2]), np.array([[1e308, 0.0], [1e-3, 2.0]]), 2, 256)
    ((ids, scores),) = index.best(np.array([5]), np.array([[-1.7e308, 3.0]]))
    assert ids.tolist() == [2, 1] and scores.tolist() == [768 * 512, None]


def test_trees_against_plain_search():
    rng = np.random.default_rng(2)
    for size in (0, 1, 3, 200, 3000):
        rows = np.floor(256 * rng.normal(size=(size, 6)) * (1 + 5 * (rng.random((size, 1)) < 0.1)))
        rows[: size // 3] = rows[:1]
        tree = metric_tree.MetricTree(np.arange(size), rows)
        for _ in range(20):
            asked = np.floor(256 * rng.normal(size=6))
            ids, scores = tree.nearest(asked, 5, 2)
            order = sorted((-float(rows[i] @ asked), i) for i in range(size) if i != 2)[:5]
            assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == order


def test_pages_are_skipped():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 20
    rows = np.floor(256 * (centres[rng.integers(40, size=4000)] + 0.05 * rng.normal(size=(4000, 6))))
    tree = metric_tree.MetricTree(np.arange(4000), rows)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            seen.append(np.size(key))
            return np.asarray(super().__getitem__(key))

    tree.rows = rows.view(Counted)
    tree.nearest(rows[5], 5, 5)
    assert sum(seen) < 2500


def test_recall(spark, sf_dir):
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in embeddings.collect()}
    found = {}
    for r in permutation.nearest_by_cosine(embeddings).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, own in found.items():
        a = vectors[q]
        scores = {i: a @ v / np.sqrt((a @ a) * (v @ v)) for i, v in vectors.items() if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert [r["rank"] for r in sorted(own, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(best))
        total += 5
    assert set(found) == {i for i in vectors if i % 50 == 0} and hits / total >= 0.9


def test_recall_in_many_shards():
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(5000, 64))
    pivots = permutation._unit(rows[:256])
    index = permutation.Postings(np.arange(5000), rows, pivots, permutation.PLACES)
    hits = 0
    for q in range(0, 5000, 100):
        order = permutation.nearest_pivots(permutation._unit(rows[q : q + 1]), pivots, permutation.PLACES)[0]
        some = index.near(order, int(permutation.SHARE * 5000) + 1)
        scores = permutation.cosines(rows[q], rows)
        scores[q] = -2
        best = index.best(rows[q], some, 5, q)[0]
        hits += np.isin(np.argsort(-scores)[:5], best).sum()
    assert hits / 250 >= 0.9


def test_a_crowd_of_similar_vectors_gets_few_pivots():
    rng = np.random.default_rng(12)
    crowd = rng.normal(size=64) + 0.1 * rng.normal(size=(500, 64))
    sample = permutation._unit(np.concatenate([crowd, rng.normal(size=(500, 64))]))
    pivots = permutation.spread_pivots(sample, 100)
    assert len(np.unique(pivots, axis=0)) == 100
    assert (pivots @ permutation._unit(crowd[:1])[0] > 0.9).sum() <= 2


def test_many_equal_vectors_crowd_nobody_out():
    rng = np.random.default_rng(10)
    rows = rng.normal(size=(4000, 64))
    rows[rng.random(4000) < 0.4] = rows[3]
    pivots = permutation._unit(np.unique(rows, axis=0)[:256])
    index = permutation.Postings(np.arange(4000), rows, pivots, permutation.PLACES)
    hits = 0
    for q in range(0, 4000, 80):
        order = permutation.nearest_pivots(permutation._unit(rows[q : q + 1]), pivots, permutation.PLACES)[0]
        ids, found = index.best(rows[q], index.near(order, int(permutation.SHARE * len(index.rows)) + 1), 5, q)
        scores = permutation.cosines(rows[q], rows)
        scores[q] = -2
        want = np.sort(scores)[::-1][:5]
        hits += (found >= want[-1] - 1e-12).sum()
        if (rows[q] == rows[3]).all():  # ties: the smallest ids
            same = [i for i in range(4000) if i != q and (rows[i] == rows[3]).all()][:5]
            assert ids.tolist() == same
    assert hits / 250 >= 0.9


def test_footrule_ranks():
    rng = random.Random(1)
    rows = np.random.default_rng(1).normal(size=(30, 4))
    pivots = permutation._unit(rows[:10])
    index = permutation.Postings(np.arange(30), rows, pivots, 6)
    orders = [list(o) for o in permutation.nearest_pivots(permutation._unit(rows), pivots, 6)]
    asked = rng.sample(range(10), 6)

    def footrule(order):
        places = {p: i for i, p in enumerate(order)}
        mine = {p: i for i, p in enumerate(asked)}
        return sum(abs(places.get(p, 6) - mine.get(p, 6)) for p in range(10))

    near = set(index.near(np.array(asked), 8).tolist())
    limit = sorted(map(footrule, orders))[7]
    numbers = {tuple(row): i for i, row in enumerate(rows)}
    assert all(footrule(orders[numbers[tuple(index.rows[i])]]) <= limit for i in near)


def test_odd_vectors(spark, rows):
    found = permutation.nearest_by_cosine(table(spark, rows)).collect()
    vectors = {i: v for i, v in plain(rows).items() if v.any()}
    assert {r.query_id for r in found} == {i for i in vectors if i % 50 == 0}
    assert all(r.vec_id in vectors and r.vec_id != r.query_id for r in found)
    for search in (permutation.nearest_by_cosine, metric_tree.largest_products):
        assert search(table(spark, rows).limit(0)).collect() == []
        few = search(table(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])).collect()
        assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]


def every_row_plain(rows, score):
    """Per query row its five best rows as (score, vec_id), ties to the smaller vec_id, no vec_id last."""
    out = []
    for at, (q, a) in enumerate(rows):
        if q is None or q % 50:
            continue
        found = [(-score(a, b), i is None, i or 0) for other, (i, b) in enumerate(rows) if other != at]
        out += [(q, rank + 1, None if gone else i, -s) for rank, (s, gone, i) in enumerate(sorted(found)[:5])]
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [False, True])
def test_every_row_is_a_candidate(spark, monkeypatch, large):
    """Different vectors under one vec_id, among them a query's, rows without one, empty vectors."""
    monkeypatch.setattr(metric_tree, "SHARD", 30)
    rng = np.random.default_rng(21)
    rows = [(int(i), np.float32(rng.normal(size=4)).astype(float)) for i in rng.integers(0, 120, 200)]
    rows += [(0, np.array([30.0, 0, 0, 0])), (0, np.array([40.0, 0, 0, 0])), (50, np.zeros(4)), (3, np.zeros(4))]
    rows += [(None, np.array([20.0, 20, 20, 20])), (None, -np.ones(4)), (7, np.array([3.0, 0, 0, 0]))] * 2
    if large:
        rows += [(100, np.array([9000.0, 1, 0, 0])), (100, np.array([9000.0, 1, 0, 0])), (9, np.array([0, -9000.0, 0, 0]))]
    given = table(spark, [(i, v.tolist() if v.any() else [], 0) for i, v in rows] + [(4, None, 0), (4, [None], 0)])
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = every_row_plain(whole, lambda a, b: sum(x * y for x, y in zip(a, b)))
    found = metric_tree.largest_products(given, every_row=True).collect()
    assert sorted((tuple(r) for r in found), key=str) == want
    assert any(i is None for _, _, i, _ in want) and any(q == i for q, _, i, _ in want)

    units = [(i, v) for i, v in rows if v.any()]
    cosine = lambda a, b: float(permutation.cosines(a, b[None, :])[0])
    want = every_row_plain(units, lambda a, b: round(cosine(a, b), 9))
    found = permutation.nearest_by_cosine(given, share=1.0, every_row=True).collect()
    key = lambda r: (r[0], r[1], r[3])
    assert sorted(map(key, ((q, n, i, round(s, 9)) for q, n, i, s in found))) == sorted(map(key, want))
    assert {r.vec_id for r in found} <= {i for i, _ in units}
    assert any(r.vec_id == r.query_id for r in found)


def test_two_vectors_of_one_id(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [3.0, 0.0], 0), (1, [0.5, 0.0], 0)]
    found = metric_tree.largest_products(table(spark, rows), every_row=True)
    assert sorted((r["rank"], r.vec_id, r.score) for r in found.collect()) == [(1, 1, 196608), (2, 1, 32768)]
