"""Changes that rewrite only the partitions they touch."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakemoor.operators.changes import delete_touched, rewrite_touched, upsert_touched
from lakemoor.sources.files import read_path, write_path

SCHEMA = "id int, name string, day string"


@pytest.fixture
def path(spark, tmp_path):
    rows = [(i, f"n{i}", f"2024-01-0{1 + i % 4}") for i in range(40)] + [(100, "odd", "a b/ü=%"), (101, None, None)]
    return write_path(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), partition_by=["day"])


def files(path):
    found = {}
    for p in Path(path).glob("day=*/*.parquet"):
        found.setdefault(p.parent.name, set()).add(p.name)
    return found


def rows(spark, path):
    return sorted(map(tuple, read_path(spark, path, schema=SCHEMA).collect()), key=repr)


def changed(before, after):
    return {day for day in before.keys() | after.keys() if before.get(day) != after.get(day)}


def test_upsert_moves_rows_and_leaves_other_files(spark, path):
    before, old = files(path), rows(spark, path)
    patch = [(0, "moved", "2024-01-09"), (4, "same day", "2024-01-01"), (77, "added", "2024-01-02"), (100, "moved", "2024-01-09")]
    target = read_path(spark, path, schema=SCHEMA)
    upsert_touched(target, path, spark.createDataFrame(patch, SCHEMA), ["id"], ["day"])
    gone = {0, 4, 77, 100}
    assert rows(spark, path) == sorted([r for r in old if r[0] not in gone] + patch, key=repr)
    touched = changed(before, files(path))
    assert {"day=2024-01-01", "day=2024-01-02", "day=2024-01-09"} <= touched and len(touched) == 4
    assert not any("ü" in day for day in files(path))  # the partition that was emptied is gone


def test_delete_removes_empty_partitions(spark, path):
    before, old = files(path), rows(spark, path)
    target = read_path(spark, path, schema=SCHEMA)
    delete_touched(target, path, (F.col("day") == "2024-01-03") | (F.col("id") == 5) | (F.col("id") == 101), ["day"])
    assert rows(spark, path) == [r for r in old if r[2] != "2024-01-03" and r[0] not in (5, 101)]
    after = files(path)
    assert changed(before, after) == {"day=2024-01-03", "day=2024-01-02", "day=__HIVE_DEFAULT_PARTITION__"}
    assert set(after) == {day for day in before if day not in ("day=2024-01-03", "day=__HIVE_DEFAULT_PARTITION__")}


def test_a_failed_change_leaves_the_table(spark, path):
    before, old = files(path), rows(spark, path)
    target = read_path(spark, path, schema=SCHEMA)
    twice = spark.createDataFrame([(1, "x", "2024-01-02"), (1, "y", "2024-01-02")], SCHEMA)
    with pytest.raises(Exception, match="two rows of the patch"):
        upsert_touched(target, path, twice, ["id"], ["day"])
    assert files(path) == before and rows(spark, path) == old
    rewrite_touched(target, path, target.limit(0), lambda rows: rows, ["day"])
    assert files(path) == before


def test_only_touched_partitions_are_read(spark, path):
    target, plans = read_path(spark, path, schema=SCHEMA), []

    def change(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    rewrite_touched(target, path, target.where("day = '2024-01-02'").select("day"), change, ["day"])
    # The whole condition is one on partitions: nothing is left to filter in the rows.
    assert "DataFilters: []" in plans[0] and "Filter (" not in plans[0] and "PartitionFilters: []" not in plans[0]
