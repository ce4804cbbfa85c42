import zlib

import numpy as np
from odd import TEXTS, odd_documents
from pyspark.sql import functions as F

from lakemoor.llm import quality


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    for quality_of in (0, 1):
        own = [r.predicted == quality_of for r in held if r.quality == quality_of]
        assert len(own) > 5 and np.mean(own) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good


def test_labels_alone_decide_what_is_learned(spark, sf_dir):
    """Held-out labels turned round change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.train(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_tables_only():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no feature alone tells
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    by_hand = model.base
    for j in range(4):
        by_hand += model.tables[j][np.searchsorted(model.edges[j], x[7, j], side="right")]
    for i, j, entries in model.pairs:
        at = [np.searchsorted(model.pair_edges[k], x[7, k], side="right") for k in (i, j)]
        by_hand += entries[at[0], at[1]]
    assert np.isclose(model.margin(x[7:8])[0], by_hand)


def test_odd_rows(spark):
    docs = odd_documents(spark, "score", "predicted", "x", "quality")
    labels = spark.createDataFrame(
        [(1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 0), (3, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int"
    )
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).collect() == []
    assert quality.keep_good(docs, none).count() == len(TEXTS)


def test_training_rows_are_bounded_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(3, f"text number {i} of one id") for i in range(300)] + [(6, "another")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    x, y = quality.training_rows(docs, labels, most=10)
    assert len(x) == len(y) <= 10
    assert (quality.training_rows(docs.repartition(7), labels, most=10)[0] == x).all()


def gain_of(parts):
    return sum(g * g / (h + 1.0) for g, h in parts)


def test_trees_against_every_split():
    """The first split of a tree is the best of all; so is the next one, given the first."""
    rng = np.random.default_rng(23)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        g, h = rng.normal(size=n) * 20, rng.uniform(0.2, 3, size=n) * quality.LEAST_WEIGHT
        h[rng.random(n) < 0.2] = 0
        cuts = [0, n]
        for leaves in (2, 3):
            tried = {}
            for at in set(range(1, n)) - set(cuts):
                new = sorted([*cuts, at])
                left, right = new[new.index(at) - 1], new[new.index(at) + 1]
                if min(h[left:at].sum(), h[at:right].sum()) >= quality.LEAST_WEIGHT:
                    tried[at] = gain_of((g[a:b].sum(), h[a:b].sum()) for a, b in zip(new, new[1:]))
            now = gain_of((g[a:b].sum(), h[a:b].sum()) for a, b in zip(cuts, cuts[1:]))
            if tried and max(tried.values()) > now + 1e-9:
                cuts = sorted([*cuts, max(tried, key=tried.get)])
            want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(cuts, cuts[1:])])
            assert np.allclose(quality._shallow_tree(g, h, leaves), want)


def test_pairs_against_every_cross():
    rng = np.random.default_rng(24)
    for _ in range(40):
        g = rng.normal(size=rng.integers(2, 6, size=2))
        h = rng.uniform(0, 2, size=g.shape)
        best, values = -np.inf, None
        for i in range(1, g.shape[0]):
            for j in range(1, g.shape[1]):
                spans = [(a, b) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))]
                gain = gain_of((g[s].sum(), h[s].sum()) for s in spans) - gain_of([(g.sum(), h.sum())])
                if gain > best:
                    best, values = gain, np.zeros_like(g)
                    for s in spans:
                        values[s] = g[s].sum() / (h[s].sum() + 1)
        found, entries = quality._cross(g, h)
        assert np.isclose(found, best) and np.allclose(entries, values)
    assert quality._cross(np.ones((1, 3)), np.ones((1, 3)))[0] == 0
