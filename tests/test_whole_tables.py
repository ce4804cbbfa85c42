"""Queries on tables as large ones are stored, and on values that today's tables do not hold."""

import datetime
from pathlib import Path

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from lakemoor.functions.values import normalise
from lakemoor.plans import QUERIES, run

STREAMS = [key for key in QUERIES if key.startswith("stream_")]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The tables of the streams as directories of part files."""
    root = tmp_path_factory.mktemp("parts")
    for name in ("events", "customer"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("key", STREAMS)
def test_streams_read_directories(key, spark, in_parts):
    with connect(SMALL) as con:
        assert difference(run(key, spark, in_parts), con, QUERIES[key].oracle) is None


def test_a_stream_of_nothing_has_a_schema(spark, in_parts, tmp_path):
    for name in ("events", "customer"):
        table = spark.read.parquet(f"{in_parts}/{name}.parquet").limit(0)
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert run("stream_with_customers", spark, str(tmp_path)).collect() == []


def test_years_and_types_come_from_the_data(spark, tmp_path):
    for path in Path(SMALL).glob("*.parquet"):
        table = spark.read.parquet(str(path))
        if path.stem == "orders":
            late = table.limit(1).withColumn("o_orderdate", F.lit(datetime.datetime(2031, 5, 1)).cast(
                table.schema["o_orderdate"].dataType))
            table = table.unionByName(late)
        if path.stem == "events":
            table = table.unionByName(table.limit(1).withColumn("event_type", F.lit("refund")))
        if path.stem in ("orders", "events", "customer", "nation"):
            table.write.parquet(str(tmp_path / path.name))
    years = run("join_every_year", spark, str(tmp_path))
    assert years.agg(F.max("year"), F.sum("orders")).first()[0] == 2031
    assert years.agg(F.sum("orders")).first()[0] == spark.read.parquet(str(tmp_path / "orders.parquet")).count()
    assert "refund" in run("pivot_types", spark, str(tmp_path)).columns


def test_sketches_are_close(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users, near = events.agg(F.countDistinct("user_id"), F.approx_count_distinct("user_id", 0.02)).first()
    assert abs(near / users - 1) < 0.1
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice")
    low, middle, high = lines.agg(
        F.percentile(price, 0.49), F.percentile_approx(price, 0.5, 10000), F.percentile(price, 0.51)
    ).first()
    assert low <= middle <= high


def test_keys_of_maps_keep_six_digits(spark):
    df = spark.sql("SELECT map(timestamp_ntz'2024-01-01 00:00:00.5', 1, timestamp_ntz'2024-01-01 00:00:00', 2) AS m")
    assert dict(normalise(df).first()["m"]) == {"2024-01-01 00:00:00.500000": 1, "2024-01-01 00:00:00": 2}
