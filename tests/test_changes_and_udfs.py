import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakemoor import session
from lakemoor.functions.udfs import Words, elide_batch, weighted_means
from lakemoor.operators.changes import delete_rows, latest_per_key, update_rows, upsert
from lakemoor.sources.files import read_path, write_path


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "id int, name string, x double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert(spark, target):
    changes = spark.createDataFrame(
        [(2, "old", 0.0, 1), (2, "new", 9.0, 2), (4, "added", None, 1)], "id int, name string, x double, version int"
    )
    patch = latest_per_key(changes, ["id"], "version").drop("version")
    assert rows(upsert(target, patch, ["id"])) == [
        (1, "a", 1.0),
        (2, "new", 9.0),
        (3, None, 3.0),
        (4, "added", None),
    ]


def test_upsert_refuses_two_rows_of_one_key(spark, target):
    twice = spark.createDataFrame([(2, "x", 1.0), (2, "y", 2.0)], target.schema)
    with pytest.raises(Exception, match="two rows of the patch"):
        upsert(target, twice, ["id"]).collect()


def test_update_reads_old_values(target):
    changed = update_rows(target, F.col("id") < 3, {"id": F.col("id") * 10, "x": F.col("id") + 0.5})
    assert rows(changed) == [(10, "a", 1.5), (20, "b", 2.5), (3, None, 3.0)]


def test_delete_keeps_unknown(target):
    assert rows(delete_rows(target, F.col("x") > 2)) == [(1, "a", 1.0), (2, "b", None)]
    assert rows(delete_rows(target, F.col("name") == "a")) == [(2, "b", None), (3, None, 3.0)]


def test_partitioned_table(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "IF(id < 900, 'hot', 'cold') AS kind")
    path = write_path(df, str(tmp_path / "t"), partition_by=["kind"])
    back = read_path(spark, path).where("kind = 'cold'")
    assert back.count() == 100
    assert "PartitionFilters: [isnotnull(kind" in back._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "t" / "kind=cold").glob("*.parquet"))) == 1


def test_elide_batch(spark):
    df = spark.createDataFrame([("é" * n,) for n in (0, 59, 60, 61)] + [(None,)], "t string")
    found = [r[0] for r in df.coalesce(1).select(elide_batch("t")).collect()]
    assert found == ["", "é" * 59, "é" * 60, "é" * 59 + "…", "NULL"]


def test_weighted_means(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 4.0, 2.0), ("b", 5.0, 0.0), (None, 2.0, 1.0), ("a", None, 9.0)],
        "k string, v double, w double",
    )
    found = {r["k"]: (r["weighted_mean"], r["weight"]) for r in weighted_means(df, ["k"], "v", "w").collect()}
    assert found == {"a": (3.0, 3.0), "b": (None, 0.0), None: (2.0, 1.0)}
    shuffled = weighted_means(df, ["k"], "v", "w")._jdf.queryExecution().executedPlan().toString()
    assert shuffled.index("MapInArrow") > shuffled.index("Exchange")  # reduced before the shuffle


def test_words(spark):
    df = spark.createDataFrame([(1, "a  bc\n a"), (2, None), (3, "")], "id int, t string")
    found = df.lateralJoin(Words(F.col("t").outer())).select("id", "word", "uses", "first_place")
    assert rows(found) == [(1, "a", 2, 0), (1, "bc", 1, 1)]


def test_shared_dir_is_the_sessions(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    a, b = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert a != b and a.startswith(session.shared_dir(spark))


def test_pandas_is_only_used_in_tasks():
    assert isinstance(elide_batch.func(pd.Series(["x"])), pd.Series)
