"""Rows that do not fit their schema, as data."""

import pytest

from lakemoor.sources.files import read_with_damage

LINES = {
    "json": ['{"a": 1, "b.c": "x"}', '{"a": 1, "b.c": ', "", '{"a": "no"}', '{"b.c": "only"}', "[1", '{"a": 2, "z": 9}'],
    "csv": ["1,x", "no,y", "", ",only", '2,"q, r"'],
}
WANT = {
    "json": {(1, "x", None), (None, None, '{"a": 1, "b.c": '), (None, None, '{"a": "no"}'), (None, "only", None), (None, None, "[1"), (2, None, None)},
    "csv": {(1, "x", None), (None, None, "no,y"), (None, "only", None), (2, "q, r", None)},
}


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_damaged_rows_are_kept_as_text(spark, tmp_path, fmt):
    for name, lines in (("one", LINES[fmt]), ("two", LINES[fmt][:2])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    found = read_with_damage(spark, str(tmp_path), fmt, "a int, `b.c` string")
    assert found.columns == ["a", "b.c", "_damaged", "_file"]
    rows = [tuple(r) for r in found.collect()]
    assert {r[:3] for r in rows} == WANT[fmt] and len(rows) == len(WANT[fmt]) + 2
    assert {r[3].rsplit("/", 1)[1] for r in rows if r[2] is not None} == {"one", "two"}
    assert len(found.where("_damaged IS NOT NULL").select("a", "_file").collect()) == len([r for r in rows if r[2] is not None])
