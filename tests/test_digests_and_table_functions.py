"""Weighted quantiles by digests, and table functions over Arrow batches."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemoor.functions.udfs import Streaks, WordTable
from lakemoor.operators import digests


def exact(values, weights, share):
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(np.array(weights)[order])
    return np.array(values)[order][np.searchsorted(upto, share * upto[-1] * (1 - 1e-15))]


def error(values, weights, found, share):
    """How far the weight below, and up to, a value is from the share."""
    values, weights = np.array(values), np.array(weights)
    below, upto = weights[values < found].sum() / weights.sum(), weights[values <= found].sum() / weights.sum()
    return max(below - share, share - upto, 0.0)


@pytest.mark.parametrize("shape", ["normal", "heavy tail", "sorted", "one heavy value"])
def test_rank_error_after_merging(shape):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=60_000), "heavy tail": rng.pareto(0.5, 60_000), "sorted": np.arange(60_000.0),
              "one heavy value": np.where(rng.random(60_000) < 0.5, 7.0, rng.normal(size=60_000))}[shape]
    weights = rng.integers(1, 50, 60_000).astype(float)
    parts = [digests.compressed(values[at::40], weights[at::40]) for at in range(40)]
    means, summed = digests.compressed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert len(means) <= digests.CENTROIDS + 2 and abs(summed.sum() - weights.sum()) < 1e-6 * weights.sum()
    for share in (0.001, 0.25, 0.5, 0.9, 0.999):
        assert error(values, weights, digests.quantile(means, summed, share), share) <= 3 / digests.CENTROIDS


def test_quantiles_of_groups(spark, monkeypatch):
    """Half of the rows in one key; few different values are exact."""
    monkeypatch.setattr(digests, "WAITING", 500)
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice("abc"), rnd.gauss(0, 1), float(rnd.randrange(1, 9))) for _ in range(20_000)]
    rows += [("few", float(rnd.randrange(300)), rnd.random()) for _ in range(2000)] + [(None, 3.0, 2.0), (None, 4.0, 1.0)]
    odd = [("few", None, 1.0), ("few", 1e9, 0.0), ("few", 1e9, -5.0), ("few", float("nan"), 1.0), ("few", 1.0, float("nan")), ("gone", 1.0, None)]
    df = spark.createDataFrame(rows + odd, "`k.1` string, v double, w double").repartition(9)
    shares = {"p5": 0.05, "median": 0.5, "p99": 0.99}
    got = {r[0]: r for r in digests.weighted_quantiles(df, ["k.1"], "v", "w", shares).collect()}
    assert set(got) == {"hot", "a", "b", "c", "few", None}
    for key, found in got.items():
        values, weights = zip(*[(v, w) for k, v, w in rows if k == key])
        for name, share in shares.items():
            if key in ("few", None):
                assert found[name] == exact(values, weights, share)
            assert error(values, weights, found[name], share) <= 3 / digests.CENTROIDS
    whole = digests.weighted_quantiles(df.where("`k.1` = 'few'"), [], "v", "w", shares).collect()
    assert [tuple(r) for r in whole] == [tuple(got["few"])[1:]]
    assert digests.weighted_quantiles(df.limit(0), ["k.1"], "v", "w", shares).collect() == []


def test_partial_states_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(digests, "HELD", 50)
    df = spark.range(1000).selectExpr("id % 7 AS k", "CAST(id AS double) AS v", "1.0D AS w")
    got = {r.k: r.m for r in digests.weighted_quantiles(df, ["k"], "v", "w", {"m": 0.5}).collect()}
    assert got == {k: exact(list(range(k, 1000, 7)), [1.0] * len(range(k, 1000, 7)), 0.5) for k in range(7)}


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_of_a_table(spark, small_batches):
    texts = [("a", "x  y\nx"), ("a", " y"), (None, "x\ty x"), ("b", None), ("b", ""), ("b", " \n "), ("c", "é x")] * 5
    df = spark.createDataFrame(texts, "lang string, text string").coalesce(2)
    found = WordTable(df.asTable()).groupBy("lang", "word").agg(F.sum("uses"), F.min("first_place"))
    want = {("a", "x"): (10, 0), ("a", "y"): (10, 0), (None, "x"): (10, 0), (None, "y"): (5, 1), ("c", "é"): (5, 0), ("c", "x"): (5, 1)}
    assert {(r[0], r[1]): (r[2], r[3]) for r in found.collect()} == want


def test_streaks_go_on_across_batches(spark, small_batches):
    rnd = random.Random(2)
    day = datetime.date(2024, 1, 1)
    rows, want = [], []
    for user in (1, 2, None):
        at = 0
        for _ in range(12):
            kind, n = rnd.choice(["v", "w", None]), rnd.randrange(1, 30)
            if want and want[-1][0] == user and want[-1][2] == kind:
                want[-1] = (*want[-1][:4], at + n - 1, want[-1][5] + n)
            else:
                want.append((user, day, kind, at, at + n - 1, n))
            rows += [(user, day, kind, at + i) for i in range(n)]
            at += n
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id bigint, day date, event_type string, event_id bigint")
    found = Streaks(df.asTable().partitionBy("user_id", "day").orderBy("event_id"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert Streaks(df.limit(0).asTable().partitionBy("user_id", "day").orderBy("event_id")).collect() == []


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_streaks_of_many_users_in_a_partition(spark, small_batches, batch):
    """Stretches end with their user and day, also where the next one begins with the same kind."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rnd = random.Random(batch)
    days = [None, datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]
    rows, want = [], []
    for user in [None, *range(40)]:
        for day in rnd.sample(days, rnd.randrange(1, 4)):
            for _ in range(rnd.randrange(1, 4)):
                kind, n, at = rnd.choice(["v", "w", None]), rnd.randrange(1, 6), len(rows)
                if want and want[-1][:3] == (user, day, kind):
                    want[-1] = (*want[-1][:4], at + n - 1, want[-1][5] + n)
                else:
                    want.append((user, day, kind, at, at + n - 1, n))
                rows += [(user, day, kind, at + i, rnd.randrange(1)) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id bigint, day date, event_type string, event_id bigint, part int")
    found = Streaks(df.asTable().partitionBy("part").orderBy("user_id", "day", "event_id"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_partitions_of_streaks_do_not_grow_with_users(spark, tmp_path):
    """Python is called once for each partition, so there are as many as tasks ask for, not one for each user's day."""
    from lakemoor.plans import run
    from lakemoor.plans.udfs import PARTS_PER_TASK

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i % 72), i // 3, "v") for i in range(9000)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    found = run("streaks_of_users", spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan()
    repartition = next(line for line in plan.toString().splitlines() if "RepartitionByExpression" in line)
    assert "part" in repartition and "user_id" not in repartition
    assert PARTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")) < found.count()
    assert found.agg(F.sum("events")).first()[0] == 9000
