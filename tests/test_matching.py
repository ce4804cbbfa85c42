from lakemoor.operators.inventory import flatten_pages, last_page, mount_report, mount_text, table_probe, table_sample
from lakemoor.operators.matching import exclude_names, lookup_name, resolve_unique_name
from lakemoor.sources.catalog import REPORT_SCHEMA


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_exclusion_keeps_order_and_ignores_case(spark):
    df = spark.createDataFrame([("customer",), ("Silver",), ("gold",), (None,)], "name string").coalesce(1)
    assert names(exclude_names(df, "name", [" SILVER ", ""])) == ["customer", "gold", None]
    assert names(exclude_names(df, "name", [])) == ["customer", "Silver", "gold", None]
    barred = spark.createDataFrame([("GOLD",), ("gold",), (None,)], "n string")
    assert set(names(exclude_names(df, "name", barred))) == {"customer", "Silver", None}


def test_one_match_or_none(spark):
    ports = [("Oslo", 11), ("oslo", 12), ("Bergen", 13), ("BERGEN ", 14), (None, 15)]
    known = spark.createDataFrame(ports, "name string, id int")
    asked = spark.createDataFrame([("bergen", None), ("OSLO", None), ("Turku", None), ("Turku", 99), ("Oslo", 11)],
                                  "name string, id int")
    found = {tuple(r)[:2]: tuple(r)[2:] for r in resolve_unique_name(asked, known).collect()}
    assert found[("bergen", None)] == (13, "resolved")  # blanks are part of a name
    assert found[("OSLO", None)] == (None, "ambiguous (2)")
    assert found[("Turku", None)] == (None, "not found")
    assert found[("Turku", 99)] == (99, "given") and found[("Oslo", 11)] == (11, "given")
    without_ids = resolve_unique_name(asked.select("name").distinct(), known).collect()
    assert {r["name"]: r["status"] for r in without_ids}["Oslo"] == "ambiguous (2)"


def test_spelling_of_a_known_name(spark):
    known = spark.createDataFrame([("Rhône", 3), ("rhône", 5), ("Po", 1)], "river string, at int")
    asked = spark.createDataFrame([("rhône",), ("RHÔNE",), ("PO",), ("Elbe",), (None,)], "river string")
    found = {r["river"]: r["found"] for r in lookup_name(asked, known, "at", "river").collect()}
    assert found == {"rhône": "rhône", "RHÔNE": "Rhône", "PO": "Po", "Elbe": None, None: None}


def test_landed_pages(spark):
    bodies = [
        '{"rows": [{"n": 4, "tag": "x"}, {"tag": "y"}, {"n": 6}], "continuationToken": "next"}',
        '{"rows": [], "continuationToken": "more"}',
        '{"other": 1, "continuationToken": null}',
        "not a page",
    ]
    pages = spark.createDataFrame([(10 * i, body) for i, body in enumerate(bodies)], "at int, raw string")
    items = flatten_pages(pages, "n int, tag string", items_key="rows", body="raw", seq="at")
    assert sorted(map(tuple, items.collect())) == [(0, 0, 4, "x"), (0, 1, None, "y"), (0, 2, 6, None)]
    ends = {r["seq"]: r["is_last"] for r in last_page(pages, body="raw", seq="at").collect()}
    assert ends == {0: False, 10: False, 20: True, 30: True}


def test_reports_are_cut(spark):
    good = [("sea", i, name, "mounted", None) for i, name in enumerate(("kelp", "eel", "cod", "crab"))]
    bad = [("sea", 10 - i, f"wreck_{i}", "failed", f"depth {i}") for i in range(3)]
    report = spark.createDataFrame([*bad, *good, ("air", 0, "kite", "failed", "no wind")], REPORT_SCHEMA)
    found = {r["database"]: r for r in mount_report(report, max_listed=3).collect()}
    assert found["sea"]["mounted"] == "kelp, eel, cod, … (+1 more)" and found["sea"]["mounted_count"] == 4
    assert found["sea"]["failed"].splitlines() == ["wreck_2: depth 2", "wreck_1: depth 1", "wreck_0: depth 0"]
    assert (found["air"]["mounted"], found["air"]["failed_count"]) == ("(none)", 1)
    lines = mount_text(report, max_listed=4).splitlines()
    assert lines[:3] == ["Mounted 0 table(s) in air: (none)", "1 failed:", "  kite: no wind"]
    assert lines[3] == "Mounted 4 table(s) in sea: kelp, eel, cod, crab" and len(lines) == 8
    many = spark.createDataFrame([("d", i, "t", "failed", str(i)) for i in range(30)], REPORT_SCHEMA)
    (row,) = mount_report(many).collect()
    assert row["failed"].splitlines() == [f"t: {i}" for i in range(10)] and row["failed_count"] == 30


def test_probe_and_sample(stored):
    lake, db = stored
    rows = {r["table"]: (r["row_count"], r["column_count"], r["columns"]) for r in table_probe(lake, db).collect()}
    assert rows == {"customer": (3, 1, "id bigint"), "Sources": (5, 2, "id bigint, name string")}
    assert table_sample(lake, db, "Sources").text().splitlines()[-1] == "[5 row(s)]"
