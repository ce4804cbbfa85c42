"""Sketches per day: bounds per group, merging, and days that change alone."""

import datetime
import math
import random

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from lakemoor.operators import sketches as sk
from lakemoor.plans import QUERIES, run
from lakemoor.sources.files import read_path

LG, K = 9, 200


@pytest.fixture(scope="module")
def rows():
    """Groups of 50 to 40,000 values over ten days, one of them with most of the rows."""
    rnd = random.Random(22)
    out = []
    for group, n in {"a": 50, "b": 3000, "c": 40_000, "d": 1}.items():
        out += [(group, f"2024-01-{rnd.randrange(1, 11):02d}", rnd.randrange(10 * n), rnd.lognormvariate(0, 2)) for _ in range(n)]
    return out + [("e", "2024-01-01", None, None), ("b", "2024-01-01", 5, float("nan"))]


@pytest.fixture(scope="module")
def made(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "g string, at string, id long, v double").repartition(7)
    path = str(tmp_path_factory.mktemp("sketches") / "daily")
    sk.write_sketches(sk.daily_sketches(df, ["g"], "at", ["id"], ["v"], lg_nominal=LG, k=K), path)
    return path


def test_distinct_estimates_within_three_errors(spark, rows, made):
    daily = read_path(spark, made)
    found = sk.merged(daily.select("g", "id_theta"), ["g"], LG).select("g", sk.distinct_estimate(F.col("id_theta")).alias("n"))
    got = {r.g: r.n for r in found.collect()}
    for group in "abcde":
        exact = len({r[2] for r in rows if r[0] == group and r[2] is not None})
        allowed = 0 if exact <= 2**LG else 3 * exact / math.sqrt(2**LG)
        assert abs(got[group] - exact) <= allowed, group
    first, rest = F.col("day") <= "2024-01-05", F.col("day") > "2024-01-05"
    a = sk.merged(daily.where(first).select("g", "id_theta"), ["g"], LG)
    b = sk.merged(daily.where(rest).select("g", F.col("id_theta").alias("o_theta")), ["g"], LG)
    both = a.join(b, "g").select(
        "g",
        sk.distinct_estimate(sk.union_of(F.col("id_theta"), F.col("o_theta"), lg_nominal=LG)).alias("n"),
        sk.distinct_estimate(sk.without(F.col("o_theta"), F.col("id_theta"))).alias("new"),
    )
    for r in both.collect():
        early = {x[2] for x in rows if x[0] == r.g and x[1] <= "2024-01-05"} - {None}
        late = {x[2] for x in rows if x[0] == r.g and x[1] > "2024-01-05"} - {None}
        error = 0 if len(early | late) <= 2**LG else 3 * len(early | late) / math.sqrt(2**LG)
        assert abs(r.n - len(early | late)) <= error and abs(r.new - len(late - early)) <= error


def test_quantiles_within_the_rank_error(spark, rows, made):
    shares = (0.01, 0.25, 0.5, 0.9)
    found = sk.merged(read_path(spark, made).select("g", "v_kll"), ["g"])
    quantiles = [sk.quantile_estimate(F.col("v_kll"), share).alias(f"q{at}") for at, share in enumerate(shares)]
    got = {r.g: r for r in found.where("g <> 'e'").select("g", *quantiles, sk.rank_estimate(F.col("v_kll"), 1.0).alias("one")).collect()}
    for group in "abcd":
        values = sorted(r[3] for r in rows if r[0] == group and r[3] == r[3])
        allowed = 0 if len(values) <= K else 2 * sk.rank_error(K)
        for at, share in enumerate(shares):
            below = sum(v < got[group][f"q{at}"] for v in values) / len(values)
            upto = sum(v <= got[group][f"q{at}"] for v in values) / len(values)
            assert below - allowed <= share <= upto + allowed, (group, share)
        assert abs(got[group].one - sum(v <= 1.0 for v in values) / len(values)) <= allowed + 1e-12


def test_one_day_again(spark, rows, made):
    """Only the folder of the day that is sketched again gets new files."""
    from pathlib import Path

    before = {p.parent.name: p.name for p in Path(made).glob("day=*/*.parquet")}
    df = spark.createDataFrame([("z", "2024-01-03", 1, 1.0)], "g string, at string, id long, v double")
    sk.write_sketches(sk.daily_sketches(df, ["g"], "at", ["id"], ["v"], lg_nominal=LG, k=K), made)
    after = {p.parent.name: p.name for p in Path(made).glob("day=*/*.parquet")}
    assert {day for day in before if before[day] != after[day]} == {"day=2024-01-03"}
    daily = read_path(spark, made)
    assert [r.g for r in daily.where("day = '2024-01-03'").collect()] == ["z"]
    assert daily.where("g = 'c'").count() == 9


START = datetime.datetime(2024, 1, 1)
EVENTS = [(i, START + datetime.timedelta(days=i % 30), i % 7, "both", float(i % 11)) for i in range(90)]


def told_apart(spark, tmp_path, key, events):
    """How a query over ``events`` differs from its SQL; ``None``: it does not."""
    df = spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    made = tmp_path / "made"
    df.coalesce(1).write.parquet(str(made))
    (tmp_path / "lake").mkdir()
    (tmp_path / "lake" / "events.parquet").write_bytes(next(made.glob("*.parquet")).read_bytes())
    with connect(str(tmp_path / "lake")) as con:
        return difference(run(key, spark, str(tmp_path / "lake")), con, QUERIES[key].oracle)


@pytest.mark.parametrize("at, kind", [(0, "old"), (29, "new"), (0, None), (29, None), (None, "untimed"), (None, "both"), (29, "(any)")])
def test_types_of_one_time_are_counted(spark, tmp_path, at, kind):
    """Types with early or late events alone, without a name, and events without a time."""
    ts = None if at is None else START + datetime.timedelta(days=at)
    events = [*EVENTS, (900, ts, 98, kind, 77.0), (901, ts, 99, kind, None)]
    assert told_apart(spark, tmp_path, "distinct_by_sketch", events) is None


def test_no_events_to_sketch(spark, tmp_path):
    assert told_apart(spark, tmp_path, "distinct_by_sketch", []) is None


def test_types_without_values_have_no_quantiles(spark, tmp_path):
    """Days and types with nulls alone, and a type that has no name."""
    odd = [(900, START, 1, "nulls", None), (901, START + datetime.timedelta(days=29), 2, "nulls", None)]
    odd += [(902, None, 3, "some", None), (903, START, 3, "some", None), (904, None, 3, "some", 4.0), (905, START, 3, None, 5.0)]
    assert told_apart(spark, tmp_path, "quantiles_by_sketch", EVENTS + odd) is None


def test_no_events_to_rank(spark, tmp_path):
    assert told_apart(spark, tmp_path, "quantiles_by_sketch", []) is None


def test_quantiles_of_an_empty_sketch_are_null(spark, made):
    found = sk.merged(read_path(spark, made).select("g", "v_kll"), ["g"]).where("g = 'e'")
    row = found.select(sk.ranked_rows(F.col("v_kll")), sk.quantile_estimate(F.col("v_kll"), 0.5), sk.rank_estimate(F.col("v_kll"), 1.0)).first()
    assert tuple(row) == (0, None, None)
