import datetime
import decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakemoor.functions.cells import cells, column_widths, elide, text_rows, widths_by_column
from lakemoor.functions.values import float_text, is_plain, normalise, truncate_text


def one(df):
    (row,) = df.collect()
    return row


def test_scalar_types(spark):
    row = one(
        normalise(
            spark.sql(
                """
                SELECT CAST(NULL AS INT) AS none, true AS yes, 7 AS i, CAST(0.5 AS FLOAT) AS f, 'text' AS s,
                       TIMESTAMP_NTZ'2024-01-31 10:00:00' AS t0, TIMESTAMP_NTZ'2024-01-31 10:00:00.1795' AS t1,
                       TIMESTAMP'2024-01-31 10:00:00.000001' AS t2, DATE'2024-01-31' AS d, 12.340BD AS dec,
                       X'00AbFf' AS bin, INTERVAL '1' DAY AS day, INTERVAL '1-2' YEAR TO MONTH AS months,
                       parse_json('{"a": [1, null]}') AS v, double('NaN') AS nan, NULL AS void
                """
            )
        )
    )
    assert row.none is None and row.void is None and row.yes is True and row.i == 7
    assert (row.f, row.s, row.dec, row.bin) == (0.5, "text", 12.34, "00abff")
    assert row.t0 == "2024-01-31T10:00:00"
    assert row.t1 == datetime.datetime(2024, 1, 31, 10, 0, 0, 179500).isoformat()
    assert row.t2 == "2024-01-31T10:00:00.000001"
    assert row.d == "2024-01-31"
    assert row.day == "INTERVAL '1' DAY" and row.months == "INTERVAL '1-2' YEAR TO MONTH"
    assert row.v == '{"a":[1,null]}'
    assert row.nan != row.nan


def test_nested_types(spark):
    row = one(
        normalise(
            spark.sql(
                """
                SELECT array(DATE'2024-01-01', NULL) AS a, CAST(NULL AS ARRAY<DATE>) AS no_array,
                       named_struct('at', DATE'2024-01-01', 'in', named_struct('x', 1.5BD)) AS s,
                       CAST(NULL AS STRUCT<d: DATE>) AS no_struct,
                       map(true, X'0A', false, NULL) AS m,
                       map(TIMESTAMP_NTZ'2024-01-01 00:00:00', 1) AS by_time,
                       map(1.50BD, array(named_struct('d', DATE'2024-01-02'))) AS deep
                """
            )
        )
    ).asDict(recursive=True)
    assert row["a"] == ["2024-01-01", None] and row["no_array"] is None
    assert row["s"] == {"at": "2024-01-01", "in": {"x": 1.5}} and row["no_struct"] is None
    assert row["m"] == {"True": "0a", "False": None}
    assert row["by_time"] == {"2024-01-01 00:00:00": 1}
    assert row["deep"] == {"1.50": [{"d": "2024-01-02"}]}


def test_time_type(spark):
    try:
        df = spark.sql("SELECT TIME'10:11:12' AS t")
        df.schema
    except Exception:
        pytest.skip("no TIME type in this release")
    assert one(normalise(df)).t == "10:11:12"


def test_plain_frames_stay_as_they_are(spark):
    df = spark.sql("SELECT 1L AS a, array('x') AS b, map('k', 1.0D) AS c")
    assert all(is_plain(f.dataType) for f in df.schema.fields)
    assert normalise(df).schema == df.schema


def test_names_with_dots_and_repeats(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS `a.b`, 1 AS `q``t`, 2 AS x, 3 AS x")
    plain = normalise(df)
    assert plain.columns == ["a.b", "q`t", "x", "x"]
    assert tuple(one(plain)) == ("2024-01-01", 1, 2, 3)


def test_normalising_uses_no_python(spark):
    df = normalise(spark.sql("SELECT array(now()) AS a, map(id, X'0A') AS m FROM range(5)"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("size", [0, 59, 60, 61, 3999, 4000, 4001])
def test_cuts(spark, size):
    text = ("é" * size)[:size]
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    row = one(df.select(elide(t).alias("e"), truncate_text(t).alias("c"), truncate_text(t, style="stream").alias("s")))
    assert row.e == (text if size <= 60 else text[:59] + "…")
    assert row.c == (text if size <= 4000 else text[:4000] + "…")
    assert row.s == (text if size <= 4000 else text[:4000] + f"\n… [truncated, {size} chars total]")


def test_null_cells_and_width(spark):
    df = spark.createDataFrame([(None,), ("abcdef",)], "t string")
    assert [r[0] for r in df.select(elide(F.col("t"), 5)).collect()] == ["NULL", "abcd…"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=40), st.integers(-8, 6))
def test_float_text_is_shortest(spark, digits, power):
    numbers = [float(f"{d}e{power}") for d in digits]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for row in df.select("x", float_text(F.col("x")).alias("t")).collect():
        assert row.t == repr(row.x)


def test_float_text_edges(spark):
    edges = ["nan", "inf", "-inf", "0", "-0.0", "1e-5", "0.0001", "9.99e-4", "0.001", "1e7", "1e15", "1e16", "1e300"]
    df = spark.createDataFrame([(float(x),) for x in edges], "x double")
    for row in df.select("x", float_text(F.col("x")).alias("t")).collect():
        assert row.t == repr(row.x)


def test_cells_of_types(spark):
    row = one(cells(spark.sql("SELECT true AS b, 0.00012D AS d, array(1, 2) AS a, CAST(NULL AS INT) AS n, 5.50BD AS p")))
    assert tuple(row) == ("True", "0.00012", "[1,2]", "NULL", "5.5")


def test_widths(spark):
    df = spark.createDataFrame([(1, "Alice"), (222222, None)], "id int, a_long_name string")
    assert tuple(one(column_widths(df))) == (6, 11)
    rows = widths_by_column(df).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [(0, "id", 6), (1, "a_long_name", 11)]
    assert tuple(one(column_widths(df.limit(0)))) == (2, 11)


def test_text_rows(spark):
    df = spark.createDataFrame([(1, "Alice"), (2, None)], "id int, name string").coalesce(1)
    table = text_rows(df)
    assert table.text().splitlines() == ["id | name ", "---+------", "1  | Alice", "2  | NULL ", "[2 row(s)]"]
    assert text_rows(df, truncated=True, limit=2).footer == "[2 row(s); truncated at limit 2]"


def test_decimal_loses_only_its_scale(spark):
    df = spark.createDataFrame([(decimal.Decimal("1.10"),)], "d decimal(10,2)")
    assert one(normalise(df)).d == 1.1
