"""The route for large groups must give what ordinary windows and joins give.

Each operator runs twice: with a limit no group reaches, and with one that most groups exceed.
"""

import random

import pytest
from pyspark.sql import functions as F

from lakemoor.operators import ordered
from lakemoor.operators.joins import (
    asof_join,
    count_below,
    dense_grid,
    frame_bytes,
    having_partner,
    interval_join,
    outer_join,
    sized_join,
)
from lakemoor.operators.ordered import (
    _segments,
    exact_quantiles,
    split_groups,
    top_per_group,
    with_last_known,
    with_neighbours,
    with_ranks,
    with_running,
    with_trailing_range,
    with_trailing_rows,
)

C = F.col
ORDER = ["v", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two thirds of the rows belong to key 0; values repeat; keys and values may be NULL."""
    rng = random.Random(7)
    data = [
        (
            None if i % 50 == 0 else (0 if i % 3 else i % 7),
            i,
            rng.choice([None, *range(12)]),
            rng.choice([None, 1.0, 2.0, 3.5]),
        )
        for i in range(500)
    ]
    return spark.createDataFrame(data, "k int, id bigint, v int, w double").cache()


def _plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 9)
    return x


def same(build):
    def rounded(df):
        lines = [tuple(_plain(x) for x in row) for row in df.collect()]
        return sorted(lines, key=repr)

    usual, split = rounded(build(10**9)), rounded(build(40))
    assert usual and usual == split
    return usual


def test_split(rows):
    parts = split_groups(rows, ["k"], 100)
    assert parts.large_groups == 1 and parts.large_rows == rows.where("k = 0").count()
    assert parts.large.select("k").distinct().collect()[0]["k"] == 0
    assert parts.small.count() + parts.large.count() == 500
    assert split_groups(rows, ["k"], 10**6).large is None


def test_running(rows):
    found = same(lambda m: with_running(rows, ["k"], ORDER, {"total": C("w"), "place": F.lit(1)}, m))
    assert len(found) == 500


def test_both_routes_have_one_schema(rows):
    exact = rows.withColumn("w", C("w").cast("decimal(18,2)"))
    sums = {"total": C("w"), "place": F.lit(1)}
    usual, split = (with_running(exact, ["k"], ORDER, sums, m) for m in (10**9, 40))
    assert usual.schema.simpleString() == split.schema.simpleString()
    same(lambda m: with_running(exact, ["k"], ORDER, sums, m))


def test_running_downwards(rows):
    same(lambda m: with_running(rows, ["k"], [C("v").desc_nulls_last(), C("id").desc()], {"n": F.lit(1)}, m))


def test_last_known(rows):
    same(lambda m: with_last_known(rows, ["k"], ORDER, "w", "last_w", m))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("tiles", [1, 4, 7, 1000])
def test_ranks(rows, descending, tiles):
    same(lambda m: with_ranks(rows, ["k"], "v", "id", descending, tiles, m))


def test_ranks_of_one_value(spark):
    flat = spark.range(300).selectExpr("1 AS k", "id", "5 AS v")
    found = same(lambda m: with_ranks(flat, ["k"], "v", "id", most_rows=m))
    assert {r[4] for r in found} == {1} and {r[5] for r in found} == {1}


@pytest.mark.parametrize("before,after,nth", [(1, 1, 2), (3, 2, 45)])
def test_neighbours(rows, before, after, nth):
    same(lambda m: with_neighbours(rows, ["k"], ORDER, "id", before, after, nth, m))


@pytest.mark.parametrize("reach", [0, 2, 60])
def test_trailing_rows(rows, reach):
    same(lambda m: with_trailing_rows(rows, ["k"], ORDER, C("v"), "total", reach, m))


@pytest.mark.parametrize("reach", [0, 3])
def test_trailing_range(rows, reach):
    some = rows.where("v IS NOT NULL")
    same(lambda m: with_trailing_range(some, ["k"], "v", "id", reach, {"n": F.lit(1), "ids": C("id")}, m))


@pytest.fixture(scope="module")
def doubles(spark):
    """One key, values that a difference of running sums would lose: huge ones, NaN, infinities, NULL."""
    rng = random.Random(11)
    odd = [1e17, float("nan"), float("inf"), float("-inf"), None, 1.0, 2.0, 3.0, None, 4.0, 1e-9]
    data = [(0, i, i // 2, rng.choice(odd)) for i in range(300)]
    # Stretches of NULL alone, and of small numbers behind a huge one.
    data += [(0, 300 + i, 200 + i, None) for i in range(20)] + [(0, 320, 220, 1e17)]
    data += [(0, 321 + i, 221 + i, float(i)) for i in range(60)] + [(0, 400, None, 1.0), (0, 401, None, 2.0)]
    return spark.createDataFrame(data, "k int, id bigint, at bigint, x double").cache()


@pytest.mark.parametrize("reach", [1, 5, 70])
def test_trailing_sums_of_doubles(doubles, reach):
    same(lambda m: with_trailing_rows(doubles, ["k"], ["id"], C("x"), "total", reach, m))
    same(lambda m: with_trailing_range(doubles, ["k"], "at", "id", reach, {"total": C("x")}, m))
    whole = {"n": F.when(C("x") > 1, C("id"))}
    same(lambda m: with_trailing_range(doubles.where("at IS NOT NULL"), ["k"], "at", "id", reach, whole, m))


def test_quantiles(rows):
    found = same(lambda m: exact_quantiles(rows, ["k"], "id", {"low": 0.1, "mid": 0.5, "top": 1.0}, m))
    expected = rows.groupBy("k").agg(*[F.percentile("id", p).alias(f"p{i}") for i, p in enumerate((0.1, 0.5, 1.0))])
    assert found == sorted([(r[0], *[round(x, 9) for x in r[1:]]) for r in expected.collect()], key=repr)


def test_asof(rows):
    asked, known = rows.where("id % 4 = 0").drop("w"), rows.where("id % 4 <> 0")
    found = same(lambda m: asof_join(asked, known, ["k"], "v", "id", "w", "last_w", m))
    assert len(found) == asked.count()


def test_asof_takes_a_null_value_of_the_latest_row(spark):
    known = spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 2, None)], "k int, at int, id int, w double")
    asked = spark.createDataFrame([(1, 3, 9), (1, 1, 8), (1, 0, 7), (2, 5, 6)], "k int, at int, id int")
    found = {r["id"]: r["w"] for r in asof_join(asked, known, ["k"], "at", "id", "w", "w").collect()}
    assert found == {9: None, 8: 5.0, 7: None, 6: None}


@pytest.mark.parametrize("width", [1, 3, 100])
def test_intervals(rows, width):
    points = rows.where("id % 4 <> 0 AND k IS NOT NULL AND v IS NOT NULL").select("k", "v", C("id").alias("p"))
    intervals = rows.where("id % 4 = 0 AND v IS NOT NULL").select(
        "k", C("id").alias("i"), (C("v") - 2).alias("s"), C("v").alias("e")
    )
    found = same(lambda m: interval_join(points, intervals, ["k"], "v", "s", "e", width, m).select("p", "i"))
    brute = points.alias("p").join(intervals.alias("i"), F.expr("p.k = i.k AND p.v BETWEEN i.s AND i.e"))
    assert found == sorted([tuple(r) for r in brute.select("p.p", "i.i").collect()], key=repr)


def test_intervals_of_any_length(spark):
    """Open-ended intervals touch few cells, and a cell hot on both sides is cut."""
    points = spark.range(300).selectExpr("1 AS k", "id AS p", "id * 1000 - 5000 AS v")
    rows = [(1, 0, -(10**15), 10**17), (1, 1, 0, 0), (1, 2, 10**10, 10**16), (1, 3, -10**16, -1), (1, 4, 7, 3)]
    intervals = spark.createDataFrame(rows, "k int, i int, s bigint, e bigint")
    found = interval_join(points, intervals, ["k"], "v", "s", "e", 10).groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in found} == {0: 300, 1: 1, 3: 5}
    many = spark.range(400).selectExpr("1 AS k", "id AS i", "0L AS s", "id % 7 AS e")
    hot = spark.range(400).selectExpr("1 AS k", "id AS p", "id % 5 AS v")
    joined = interval_join(hot, many, ["k"], "v", "s", "e", 100, most_rows=1)
    want = hot.alias("p").join(many.alias("i"), F.expr("p.v BETWEEN i.s AND i.e")).count()
    assert joined.count() == want


def test_count_below(rows):
    left, right = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    found = dict(same(lambda m: count_below(left, right, "id", "id", "n", m)))
    assert found == {i: i // 2 for i in range(0, 500, 2)}


def test_copies_of_one_row(spark):
    """Rows equal in every column are spread over segments and blocks as well."""
    copies = spark.range(400).selectExpr("1 AS k", "7L AS id", "5 AS v", "2.0D AS w")
    groups = split_groups(copies, ["k"], 50)
    sizes = _segments(groups, ["k"], ["v", "id"], 50).rows.groupBy("_seg").count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) <= 150
    found = with_running(copies, ["k"], ["v", "id"], {"n": F.lit(1), "s": C("w")}, 50).collect()
    assert sorted(r["n"] for r in found) == list(range(1, 401))
    assert sorted(r["s"] for r in found) == [2.0 * i for i in range(1, 401)]
    ranked = with_ranks(copies, ["k"], "v", "id", most_rows=50).collect()
    assert {r["rank"] for r in ranked} == {1} and sorted(r["row_number"] for r in ranked) == list(range(1, 401))
    asked = spark.createDataFrame([(1, 1, 4, 6), (1, 2, 6, 9)], "k int, i int, s int, e int")
    pairs = interval_join(copies.drop("id"), asked, ["k"], "v", "s", "e", 2, 50)
    assert [tuple(r) for r in pairs.groupBy("i").count().collect()] == [(1, 400)]


def test_top_per_group(rows):
    found = top_per_group(rows, ["k"], [C("v").desc_nulls_last(), C("id")], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert found.groupBy("k").count().where("count > 3").count() == 0


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins(rows, how):
    left = rows.where("id < 300").select("k", C("id").alias("a"))
    right = rows.where("k IS NULL OR k > 2").select((C("k") + 2).alias("k"), C("id").alias("b"))
    found = sorted([tuple(r) for r in outer_join(left, right, ["k"], how).select("k", "a", "b").collect()], key=repr)
    expected = left.join(right, "k", how).select("k", "a", "b").collect()
    assert found == sorted([tuple(r) for r in expected], key=repr)


def test_join_strategies(rows):
    left, right = rows.select("k", "id"), rows.where("id < 9").select("k", C("id").alias("other"))
    plans, results = {}, []
    for strategy in ("auto", "broadcast", "merge", "shuffle_hash"):
        joined = sized_join(left, right, ["k"], strategy=strategy)
        plans[strategy] = joined._jdf.queryExecution().executedPlan().toString()
        results.append(sorted(map(tuple, joined.collect())))
    assert all(r == results[0] for r in results)
    assert "BroadcastHashJoin" in plans["broadcast"]
    assert "SortMergeJoin" in plans["merge"]
    assert "ShuffledHashJoin" in plans["shuffle_hash"]
    too_large = sized_join(left, right, ["k"], strategy="broadcast", most_bytes=1)
    assert "SortMergeJoin" in too_large._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sized_join(left, right, ["k"], strategy="magic")


def test_hot_keys_of_an_inner_join_are_split(spark):
    """With thresholds fit for a test, AQE splits the hot partition of an ordinary join."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name, None) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        facts = spark.range(0, 200_000, 1, 16).selectExpr("IF(id % 3 = 0, 0, id % 5000) AS k", "id", "id * 7 AS x")
        members = spark.range(5000).selectExpr("id AS k", "id AS name")
        joined = sized_join(facts, members, ["k"])
        total = joined.agg(F.count(F.lit(1)).alias("n"), F.sum("name").alias("s"))
        assert total.collect()[0]["n"] == 200_000
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def test_wide_summaries_are_not_broadcast(spark, monkeypatch):
    """Few groups whose keys or carried values are wide: the same rows, with joins that shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(300).select((C("id") % 3).alias("k"), "id", F.repeat(F.lit("x"), (C("id") % 90).cast("int")).alias("w"))
        found, plans = [], []
        for limit in (ordered.MOST_BROADCAST_BYTES, 50):
            monkeypatch.setattr(ordered, "MOST_BROADCAST_BYTES", limit)
            made = with_neighbours(rows, ["k"], ["id"], "w", 1, 1, 2, most_rows=40)
            found.append(sorted(map(tuple, made.collect())))
            plans.append(made._jdf.queryExecution().optimizedPlan().toString())
        assert found[0] == found[1] and len(found[0]) == 300
        assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frame_bytes(spark):
    df = spark.createDataFrame([(1, "abc", [1, 2]), (2, None, None)], "a int, b string, c array<int>")
    assert 90 < frame_bytes(df) < 250
    assert frame_bytes(df.limit(0)) == 0


def test_partners(rows):
    left = rows.select("k").distinct()
    right = rows.where("k > 3")
    assert {r["k"] for r in having_partner(left, right, "k", "k").collect()} == {4, 5, 6} & {
        r["k"] for r in left.collect()
    }
    without = {r["k"] for r in having_partner(left, right, "k", "k", found=False).collect()}
    assert None in without and 0 in without and 6 not in without


def test_dense_grid(spark):
    members = spark.createDataFrame([(1,), (2,)], "m int")
    facts = spark.createDataFrame([(1, 3, 7)], "m int, step int, n int")
    grid = dense_grid(facts, members, "m", "step", F.sequence(F.lit(2), F.lit(3)), "n")
    assert sorted(map(tuple, grid.select("m", "step", "n").collect())) == [(1, 2, 0), (1, 3, 7), (2, 2, 0), (2, 3, 0)]
