import pytest
from pyspark.errors import AnalysisException, ArithmeticException

from lakemoor import Lake
from lakemoor.operators.bounded import bounded
from lakemoor.sources.catalog import MissingTable, UnknownDatabase
from lakemoor.sources.files import read_path, register_path, rows_source, write_path
from lakemoor.sources.names import database_name, name_parts, quote, quote_text


def test_a_query_mounts_what_it_names(stored):
    lake, db = stored
    assert not lake.is_mounted(db, "customer")
    assert lake.sql(f"SELECT * FROM {db}.customer").count() == 3
    assert lake.is_mounted(db, "customer")
    assert not lake.is_mounted(db, "Sources")


def test_names_are_found_in_any_case(stored):
    lake, db = stored
    assert lake.sql(f"SELECT * FROM {db.upper()}.customer").count() == 3
    assert lake.database(db.lower()).name == db
    assert lake.sql(f"SELECT * FROM spark_catalog.{db}.customer").count() == 3


def test_several_tables_and_a_cte(stored):
    lake, db = stored
    text = f"""-- two tables
        WITH a AS (SELECT id FROM {db}.customer) SELECT s.name FROM a JOIN {db}.Sources s ON a.id = s.id"""
    assert {r[0] for r in lake.sql(text).collect()} == {"n0", "n1", "n2"}


def test_unknown_database_keeps_its_error(stored):
    lake, _ = stored
    with pytest.raises(AnalysisException) as error:
        lake.sql("SELECT * FROM randomdb.t")
    assert error.value.getCondition() == "TABLE_OR_VIEW_NOT_FOUND"


def test_one_part_names_are_not_mounted(stored):
    lake, db = stored
    lake.spark.sql(f"USE {db}")
    try:
        with pytest.raises(AnalysisException):
            lake.sql("SELECT * FROM customer")
    finally:
        lake.spark.sql("USE default")
    assert not lake.is_mounted(db, "customer")


def test_other_errors_mount_nothing(stored):
    lake, db = stored
    with pytest.raises(AnalysisException):
        lake.sql(f"SELECT no_such_column FROM VALUES (1) t(a)")
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        lake.sql(f"SELEC * FROM {db}.customer")
    assert not lake.is_mounted(db, "customer")


def test_a_mount_that_does_not_help_ends(stored, monkeypatch):
    lake, db = stored
    calls = []
    monkeypatch.setattr(Lake, "mount", lambda self, d, t: calls.append((d, t)))
    with pytest.raises(AnalysisException):
        lake.sql(f"SELECT * FROM {db}.customer")
    assert calls == [(db, "customer")]


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE {db}.customer",
        "INSERT INTO {db}.customer VALUES (9)",
        "WITH x AS (SELECT 1 AS id) INSERT INTO {db}.customer SELECT * FROM x",
        "FROM (SELECT 1 AS id) INSERT INTO {db}.customer SELECT id",
    ],
)
def test_writes_mount_nothing(stored, text):
    lake, db = stored
    with pytest.raises(AnalysisException):
        lake.sql(text.format(db=db))
    assert not lake.is_mounted(db, "customer")


def test_missing_table_names_its_path(stored):
    lake, db = stored
    with pytest.raises(MissingTable, match="nowhere"):
        lake.sql(f"SELECT * FROM {db}.nowhere")
    with pytest.raises(UnknownDatabase, match="'sideboard' is registered here"):
        lake.mount("sideboard", "cutlery")


def test_mounting_reports_failures_and_goes_on(stored):
    lake, db = stored
    report = lake.mount_many(db, ["customer", "nowhere", "Sources"]).collect()
    assert [(r["table"], r["status"]) for r in report] == [
        ("customer", "mounted"),
        ("nowhere", "failed"),
        ("Sources", "mounted"),
    ]
    assert report[1]["error"].startswith("MissingTable: ")
    again = lake.mount_all(db).collect()
    assert {(r["table"], r["status"]) for r in again} == {("customer", "mounted"), ("Sources", "mounted")}


def test_listing_does_not_need_mounts(stored):
    lake, db = stored
    rows = {r["table"]: r["mounted"] for r in lake.tables(db).collect()}
    assert rows == {"customer": False, "Sources": False}
    lake.mount(db, "customer")
    assert {r["table"]: r["mounted"] for r in lake.tables(db).collect()}["customer"]


def test_odd_names(spark, tmp_path):
    root = tmp_path / "it's a lake"
    spark.range(2).write.parquet(str(root / "odd"))
    lake = Lake(spark)
    name = lake.add_database(str(root), name=f"odd_{tmp_path.name}")
    assert lake.sql(f"SELECT * FROM {name}.odd").count() == 2
    assert quote("a`b") == "`a``b`"
    assert name_parts("`a``b`.`c d`") == ["a`b", "c d"]
    assert quote_text("it's") == "'it\\'s'"


def test_a_database_stands_for_one_root(spark, tmp_path):
    lake = Lake(spark)
    lake.add_database(str(tmp_path / "a"), name=f"one_{tmp_path.name}")
    lake.add_database(str(tmp_path / "a"), name=f"one_{tmp_path.name}")
    with pytest.raises(ValueError, match="already stands for"):
        lake.add_database(str(tmp_path / "b"), name=f"one_{tmp_path.name}")
    assert database_name("/x/sf0.01") != database_name("/y/sf0.01")


def test_a_directory_of_databases(spark, tmp_path):
    for name in ("gold", "Silver", "bronze"):
        spark.range(2).write.parquet(str(tmp_path / name / "Tables" / "t"))
    (tmp_path / "_logs").mkdir()
    lake = Lake(spark)
    assert lake.add_databases(str(tmp_path), exclude=[" silver "], inside="Tables") == ["bronze", "gold"]
    assert lake.sql("SELECT * FROM gold.t").count() == 2
    assert lake.table_names("bronze") == ["t"]
    with pytest.raises(UnknownDatabase):
        lake.mount("silver", "t")
    lake.reset()


def test_limits_of_results(spark, tmp_path):
    spark.range(7).selectExpr("id * id AS square", "chr(97 + id) AS letter").write.parquet(str(tmp_path / "squares"))
    lake = Lake(spark, default_limit=2, most_rows=6)
    name = lake.add_database(str(tmp_path), name=f"sq_{tmp_path.name}")
    text = f"SELECT letter, square FROM {name}.squares ORDER BY square DESC"
    short = lake.run_sql(text)
    assert short.columns == ["letter", "square"] and short.rows == [["g", 36], ["f", 25]]
    assert short.truncated and short.row_count == short.limit == 2
    assert lake.run_sql(text, limit=6).truncated
    assert not lake.run_sql(f"{text} LIMIT 6", limit=6).truncated
    for limit in (0, 7, -3):
        with pytest.raises(ValueError, match="between 1 and 6"):
            lake.run_sql(text, limit=limit)
    wider = Lake(spark, most_rows=10**7)
    assert wider.run_sql("SELECT id FROM range(150000)", limit=150_000).row_count == 150_000
    told = bounded(spark.range(9), 8).summary().first()
    assert tuple(told) == (8, True, 8) and tuple(bounded(spark.range(3), 8).summary().first()) == (3, False, 8)


def test_databases_of_a_listing(spark, tmp_path):
    for folder in ("id-1", "id-2"):
        spark.range(3).write.parquet(str(tmp_path / folder / "Tables" / "t"))
    listing = spark.createDataFrame([("north", "id-1"), ("south", "id-2"), ("north", "id-1")], "name string, id string")
    lake = Lake(spark)
    assert lake.add_listed(listing, str(tmp_path), inside="Tables") == ["north", "south"]
    assert lake.sql("SELECT * FROM south.t").count() == 3
    twice = spark.createDataFrame([("north", "id-2")], "name string, id string")
    with pytest.raises(ValueError, match="already stands for"):
        lake.add_listed(twice, str(tmp_path), inside="Tables")
    lake.reset()


def test_plain_values_of_a_result(spark):
    found = Lake(spark).run_sql(
        "SELECT named_struct('a', 1, 'b', array(1.5BD)) AS s, X'0AFF' AS b, DATE'2024-01-31' AS d, 1 AS d"
    )
    assert found.columns == ["s", "b", "d", "d"]
    assert found.rows == [[[1, [1.5]], "0aff", "2024-01-31", 1]]


def test_text_of_a_result(spark):
    lake = Lake(spark)
    lines = lake.show_sql("SELECT * FROM VALUES (1, 'Alice'), (2, NULL) t(id, name) ORDER BY id").splitlines()
    assert lines == ["id | name ", "---+------", "1  | Alice", "2  | NULL ", "[2 row(s)]"]
    assert "truncated at limit 2" in lake.show_sql("SELECT * FROM range(3) ORDER BY id", limit=2)
    assert "no result set" in lake.show_sql("CREATE DATABASE IF NOT EXISTS lakemoor_scratch")
    assert lake.show_sql("SELECT 1 AS x WHERE false").splitlines()[-1] == "[0 row(s)]"
    assert lake.run_sql("CREATE DATABASE IF NOT EXISTS lakemoor_scratch").columns == []


def test_errors_are_outcomes(stored):
    lake, db = stored
    rows = lake.outcomes(
        ["SELECT 1 / 0", f"SELECT * FROM {db}.customer", "SELECT * FROM nope", "SET spark.sql.ansi.enabled"], limit=2
    ).collect()
    assert [(r["ok"], r["has_result"], r["row_count"], r["truncated"]) for r in rows] == [
        (False, False, None, None),
        (True, True, 2, True),
        (False, False, None, None),
        (True, True, 1, False),
    ]
    assert rows[0]["error_condition"] == "DIVIDE_BY_ZERO"
    assert rows[2]["message"].startswith("AnalysisException: ")
    with pytest.raises(ArithmeticException):
        lake.run_sql("SELECT 1 / 0")


def test_reset_forgets_but_keeps_data(stored):
    lake, db = stored
    root = lake.database(db).root
    lake.mount_all(db)
    lake.spark.sql(f"USE {db}")
    lake.sql(f"SELECT * FROM {db}.customer").createOrReplaceTempView("forget_me")
    lake.reset()
    assert not lake.spark.catalog.databaseExists(db)
    assert not lake.spark.catalog.tableExists("forget_me")
    assert lake.spark.catalog.currentDatabase() == "default"
    with pytest.raises(UnknownDatabase):
        lake.database(db)
    assert read_path(lake.spark, f"{root}/customer").count() == 3
    lake.add_database(root, name=db)
    assert lake.sql(f"SELECT * FROM {db}.customer").count() == 3


def test_reset_keeps_tables_that_spark_stores(stored):
    lake, db = stored
    lake.spark.range(4).write.saveAsTable(f"{db}.own")
    lake.mount_all(db)
    lake.reset()
    assert lake.spark.table(f"{db}.own").count() == 4
    assert not lake.is_mounted(db, "customer")
    lake.spark.sql(f"DROP DATABASE {db} CASCADE")


def test_registering_twice(spark, tmp_path):
    path = write_path(spark.range(3), str(tmp_path / "t"))
    spark.sql("CREATE DATABASE IF NOT EXISTS lakemoor_scratch")
    name = ("lakemoor_scratch", f"t_{tmp_path.name}")
    register_path(spark, name, path)
    register_path(spark, name, path)
    with pytest.raises(AnalysisException):
        register_path(spark, name, path, exist_ok=False)
    people = rows_source(spark, [(1, "Alice", "2024-01-01"), (2, "Bob", "2024-02-01")], ["id", "name", "joined"])
    assert [f.dataType.simpleString() for f in people.schema] == ["bigint", "string", "string"]


def test_snapshot_and_columns(stored):
    lake, db = stored
    lake.mount(db, "Sources")
    entries = {r["key"]: r["value"] for r in lake.snapshot().collect()}
    assert entries["registered"] == db and db.lower() in entries["databases"].lower()
    assert entries["spark_version"] == lake.spark.version
    text = lake.describe()
    assert f"spark_version: {lake.spark.version}" in text and f"registered (1): {db}" in text
    columns = [(r["column"], r["type"]) for r in lake.columns(db).orderBy("position").collect()]
    assert columns == [("id", "bigint"), ("name", "string")]
    registered = lake.databases().where("registered").collect()
    assert [r["database"].lower() for r in registered] == [db.lower()]


@pytest.mark.parametrize(
    "text",
    [
        "CREATE TEMPORARY VIEW seen_{n} AS SELECT * FROM {db}.customer",
        "CACHE TABLE kept_{n} AS SELECT * FROM {db}.customer",
        "CREATE TABLE copy_{n} USING parquet AS SELECT * FROM {db}.customer",
        "INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT * FROM {db}.customer",
        "SHOW COLUMNS IN {db}.customer",
        "EXPLAIN SELECT * FROM {db}.customer",
        "/* why */ EXPLAIN FORMATTED SELECT * FROM {db}.customer",
        "SELECT count(*) FROM {db}.customer WHERE 'insert into x' <> 'UnresolvedTable [a, b]' -- insert into y",
    ],
)
def test_what_a_statement_reads_is_mounted(stored, tmp_path, text):
    lake, db = stored
    found = lake.sql(text.format(db=db, n=tmp_path.name.replace("-", "_"), path=tmp_path / "out")).collect()
    assert lake.is_mounted(db, "customer")
    assert not any("Error occurred" in str(row) for row in found)
