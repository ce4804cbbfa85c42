"""Files along a Z-order curve, and joins with hot keys."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakemoor.operators.clustering import interleaved, rank_cells, write_clustered
from lakemoor.operators.joins import outer_join


def files_in_range(path, ranges):
    """Files whose statistics allow rows in all ranges."""
    n = 0
    for file in Path(path).glob("*.parquet"):
        data = pq.ParquetFile(file).metadata
        names = [data.schema.column(at).name for at in range(data.num_columns)]
        stats = {name: data.row_group(0).column(names.index(name)).statistics for name in ranges}
        n += all(stats[name].min <= high and stats[name].max >= low for name, (low, high) in ranges.items())
    return n


def test_each_column_narrows_the_scan(spark, tmp_path):
    df = spark.range(20_000).select(
        "id", (F.hash("id") % 1000).alias("a"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(7)).alias("b")
    )
    df = df.persist()
    path = write_clustered(df, str(tmp_path / "z"), ["a", "b"], 64)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    total = len(list(Path(path).glob("*.parquet")))
    assert total >= 50
    assert files_in_range(path, {"a": (100, 140)}) < total / 2.5
    assert files_in_range(path, {"b": (0.30, 0.35)}) < total / 2.5
    assert files_in_range(path, {"a": (100, 140), "b": (0.30, 0.35)}) < total / 8
    sizes = [pq.ParquetFile(file).metadata.num_rows for file in Path(path).glob("*.parquet")]
    assert max(sizes) < 6 * 20_000 / 64  # a third of the rows have one b: no file has them all
    df.unpersist()


def test_cells_and_curve(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, rnd.randrange(10**6)]), f"w{rnd.randrange(500):03d}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "`x.y` int, s string").coalesce(1)
    cells = rank_cells(df, ["x.y", "s"])
    found = df.select("*", cells["x.y"].alias("cx"), cells["s"].alias("cs")).collect()
    for value, cell in ((0, 2), (1, 3)):
        pairs = sorted((r[value], r[cell]) for r in found if r[value] is not None)
        assert [cell for _, cell in pairs] == sorted(cell for _, cell in pairs)
        assert 0 <= pairs[0][1] and pairs[-1][1] <= 255 and len({cell for _, cell in pairs}) > 60
    assert {r[2] for r in found if r[0] is None} == {0}
    a, b = rnd.randrange(256), rnd.randrange(256)
    curve = spark.range(1).select(interleaved([F.lit(a), F.lit(b)])).first()[0]
    assert curve == int("".join(x + y for x, y in zip(f"{a:08b}", f"{b:08b}")), 2)
    with pytest.raises(ValueError):
        write_clustered(df, "/nowhere", [], 4)


def brute_full(left, right):
    out = [(k, a, b) for k, a in left for j, b in right if k is not None and k == j]
    keys_l, keys_r = {k for k, _ in left} - {None}, {k for k, _ in right} - {None}
    out += [(k, a, None) for k, a in left if k not in keys_r] + [(k, None, b) for k, b in right if k not in keys_l]
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_rows", [10, 200, 10**6])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_full_join_with_hot_keys(spark, most_rows, kind):
    """40 % of a side in one key; hot on one side alone, on both, and without a partner; null keys."""
    rnd = random.Random(most_rows)
    make = int if kind == "long" else float
    left = [(make(1 if rnd.random() < 0.4 else rnd.randrange(60)), at) for at in range(400)]
    left += [(make(77), at) for at in range(1000, 1100)] + [(None, at) for at in range(2000, 2030)]
    right = [(make(rnd.choice([1, 1, 5, 5, 5, 5, rnd.randrange(90, 120)])), at) for at in range(60)]
    right += [(make(88), at) for at in range(500, 580)] + [(None, at) for at in range(600, 603)] + [(make(at), at) for at in range(3)]
    a = spark.createDataFrame(left, f"k {kind}, a int").repartition(5)
    b = spark.createDataFrame(right, f"k {kind}, b int").repartition(3)
    found = outer_join(a, b, ["k"], "full", most_rows)
    assert found.columns == ["k", "a", "b"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_full(left, right)
    assert outer_join(a.limit(0), b, ["k"], "full", most_rows).count() == len(right)
    assert outer_join(a.limit(0), b.limit(0), ["k"], "full", most_rows).count() == 0


def test_full_join_reads_each_side_once(spark, tmp_path):
    for name in "ab":
        spark.range(1000).selectExpr("IF(id < 400, 1, id) AS k", "id % 3 AS m", f"id AS {name}").write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    plan = outer_join(a, b.withColumnRenamed("m", "m"), ["k", "m"], "full", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("FullOuter") == 1
