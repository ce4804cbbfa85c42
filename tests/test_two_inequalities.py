"""Counts over two inequalities, and pairs of two streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lakemoor.operators.joins import count_dominated
from lakemoor.session import scratch_path
from lakemoor.streaming.events import interval_pairs
from lakemoor.streaming.tables import event_time, stream_table

START = datetime.datetime(2024, 1, 1)


def brute(rows):
    known = [(x, y) for _, x, y in rows if x is not None and y is not None and y == y]
    return sorted(
        (i, sum(a < x and b < y for a, b in known) if x is not None and y is not None and y == y else 0) for i, x, y in rows
    )


@pytest.mark.parametrize("slabs", [None, 2, 7, 40])
@pytest.mark.parametrize("shape", ["spread", "hot", "equal"])
def test_dominated_rows(spark, slabs, shape):
    rnd = random.Random(slabs or 1)
    xs = {"spread": lambda: rnd.randrange(10_000), "hot": lambda: 5 if rnd.random() < 0.4 else rnd.randrange(12), "equal": lambda: 3}[shape]
    rows = [(i, xs(), rnd.choice([rnd.random(), 0.5, -1.0])) for i in range(700)]
    rows += [(700, None, 1.0), (701, 1, None), (702, 1, float("nan")), (703, 99_999, 99.0)]
    df = spark.createDataFrame(rows, "i int, x int, y double").repartition(5)
    found = count_dominated(df, "i", "x", "y", "n", slabs)
    assert sorted(map(tuple, found.collect())) == brute(rows)
    assert count_dominated(df.limit(0), "i", "x", "y", "n", slabs).collect() == []


def test_dominated_by_time(spark):
    rnd = random.Random(4)
    rows = [(i, START + datetime.timedelta(hours=rnd.randrange(200)), float(rnd.randrange(50))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x timestamp_ntz, y double")
    assert sorted(map(tuple, count_dominated(df, "i", "x", "y", "n", 8).collect())) == brute(rows)


@pytest.mark.parametrize("most_rows", [3, 250_000])
def test_dominated_with_hot_values_of_both(spark, most_rows):
    """A value with most of the rows is a slab or a strip of its own, its rows dealt to several groups."""
    rnd = random.Random(9)
    rows = [(i, 5 if i % 3 else rnd.randrange(12), 0.5 if i % 5 else rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, x int, y double").repartition(5)
    assert sorted(map(tuple, count_dominated(df, "i", "x", "y", "n", 6, most_rows).collect())) == brute(rows)


@pytest.mark.parametrize("slabs", [1, 2, 9])
def test_dominated_by_text(spark, slabs):
    """Values that have no quantiles."""
    rnd = random.Random(slabs)
    rows = [(i, rnd.choice("abcdeé") * rnd.randrange(1, 3), rnd.choice(["", "x", "y\0", "zz"])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x string, y string").repartition(3)
    assert sorted(map(tuple, count_dominated(df, "i", "x", "y", "n", slabs).collect())) == brute(rows)


def test_dominated_rows_of_one_id(spark):
    """Rows that share an id are one row with the sum of their counts, as GROUP BY has it."""
    rows = [(1, 1, 1.0), (2, 2, 2.0), (2, 3, 3.0), (None, 4, 4.0), (None, 5, None), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, x int, y double")
    found = count_dominated(df, "i", "x", "y", "n", 2)
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, 0), (2, 3), (3, 0), (None, 3)]


def test_dominated_rows_are_not_multiplied(spark):
    """What is shuffled grows with the rows alone: no row is repeated for each level of a tree of slabs."""
    df = spark.range(2000).selectExpr("id AS i", "id * 7 % 2000 AS x", "id * 13 % 2000 AS y")
    plans = [count_dominated(df, "i", "x", "y", "n", slabs)._jdf.queryExecution().optimizedPlan().toString() for slabs in (2, 40)]
    for plan in plans:
        assert "Generate" not in plan and plan.count("FlatMapGroupsInArrow") == 2 and plan.count("Join") == 1


def test_pairs_of_streams_and_their_state(spark):
    """Pairs are those of the batch join, and rows leave the state when the watermarks pass them."""
    path, rnd = scratch_path(spark, "pairs"), random.Random(6)
    all_points, all_spans = [], []
    kept = []
    for wave in range(3):
        base = wave * 300
        points = [(wave * 1000 + i, 1 if rnd.random() < 0.4 else rnd.randrange(5), base + rnd.random() * 100) for i in range(150)]
        spans = [(wave * 1000 + i, rnd.randrange(5), base + rnd.random() * 100) for i in range(60)] + [(wave * 1000 + 999, 2, base + 100)]
        all_points, all_spans = all_points + points, all_spans + spans
        for name, rows in (("p", points), ("s", spans)):
            data = [(i, k, START + datetime.timedelta(minutes=m)) for i, k, m in rows]
            spark.createDataFrame(data, f"{name} long, k long, {name}_at timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{path}/{name}")
        sides = [
            event_time(stream_table(spark, f"{path}/{name}", f"{name} long, k long, {name}_at timestamp_ntz"), f"{name}_at", "10 minutes")
            for name in "ps"
        ]
        pairs = interval_pairs(sides[0], "p_at", sides[1], "s_at", "k", 10 * 60 * 1_000_000).select("p", "s", "k")
        query = (
            pairs.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True).start(f"{path}/out")
        )
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    found = sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()))
    want = sorted((p, s, k) for p, k, m in all_points for s, j, e in all_spans if j == k and e - 10 <= m <= e)
    assert found == want
    landed = len(all_points) + 2 * len(all_spans)
    assert kept[2] <= kept[0] * 1.5 and kept[2] < landed / 2, kept


def test_streams_without_pairs(spark):
    path = scratch_path(spark, "none")
    for name in "ps":
        spark.createDataFrame([], f"{name} long, k long, {name}_at timestamp_ntz").write.parquet(f"{path}/{name}")
    sides = [event_time(stream_table(spark, f"{path}/{n}", f"{n} long, k long, {n}_at timestamp_ntz"), f"{n}_at", "1 minute") for n in "ps"]
    assert interval_pairs(sides[0], "p_at", sides[1], "s_at", "k", 1_000_000).select(F.lit(1)).columns == ["1"]
