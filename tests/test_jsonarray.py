"""Arrays read in ranges against Python's parser, at every cut."""

import json

import pytest

from tagloom import catalog
from tagloom.schema import CORRUPT_COLUMN
from tagloom.sources import jsonarray

RECORDS = [
    {"appId": "1", "description": 'a "quoted" } brace { and \\ backslash', "package": "p"},
    {"appId": "2", "description": "nested", "extra": [{"a": {"b": [1, {"c": "]}"}]}}, {}]},
    {},
    {"appId": "é}ß\n", "description": '\\"}\\\\', "appName": "[{,"},
    {"description": ""},
]


def write(tmp_path, text, name="a.json"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def read(spark, path, size=None):
    key = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(key)
    try:
        if size:
            spark.conf.set(key, str(size))
        df = jsonarray.read_json_array(spark, path)
        rows = df.collect()
        return sorted(((r.appId, r.package, r.appName, r.description, r[CORRUPT_COLUMN]) for r in rows), key=str)
    finally:
        spark.conf.set(key, kept)


def expected(records):
    return sorted(
        ((r.get("appId"), r.get("package"), r.get("appName"), r.get("description"), None) for r in records), key=str
    )


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 11, 13, 17, 29, 37, 53, 64, 101, 10_000])
def test_all_cuts_give_the_same_records(spark, tmp_path, size):
    text = json.dumps(RECORDS, ensure_ascii=False)
    path = write(tmp_path, text)
    write(tmp_path, "\n " + json.dumps(RECORDS[:2], indent=2) + "\n", "b.json")
    assert read(spark, path, size) == expected(RECORDS + RECORDS[:2])


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    records = [{"appId": str(i), "description": "x}" * (i % 50)} for i in range(3000)]
    path = write(tmp_path, json.dumps(records))
    key = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        assert jsonarray._fragments(spark, path).select("start").distinct().count() > 3
    finally:
        spark.conf.set(key, kept)
    assert read(spark, path, 20_000) == expected(records)


def test_broken_and_empty_files(spark, tmp_path):
    cases = {
        "empty": ("", []),
        "none": (" [ ] \n", []),
        "early": ('[{"appId":"1"},{"appId":"2"', [("1", None), (None, '{"appId":"2"')]),
        "open": ('[{"appId":"1"}', [("1", None)]),
        "text": ('[{"appId":"1"},{"appId":"2","description":"never ends', [("1", None), (None, '{"appId":"2","description":"never ends')]),
        "bad": ('[{"appId":1 2},{"appId":"3"}]', [(None, '{"appId":1 2}'), ("3", None)]),
        "other": ('[7,{"appId":"1"},{"appId":"2"}]', [(None, '7,{"appId":"1"}'), ("2", None)]),
        "object": ('{"appId":"1"}', [(None, '{"appId":"1"}')]),
        "mark": ('﻿[{"appId":"1"}]', [("1", None)]),
        "mark early": ('﻿[{"appId":"1"},{"appId":"2"', [("1", None), (None, '{"appId":"2"')]),
        "null": ('[null]', [(None, "null]")]),
    }
    for name, (text, rows) in cases.items():
        folder = tmp_path / name.replace(" ", "-")
        folder.mkdir()
        got = read(spark, write(folder, text))
        assert [(r[0], r[4]) for r in got] == sorted(rows, key=str), name


def test_documents_are_written_as_more_arrays_when_they_grow(spark, sf_dir, tmp_path, monkeypatch):
    expected = sorted(map(str, catalog.QUERIES["ingest_json_array"](spark, sf_dir).collect()))
    monkeypatch.setattr(catalog, "ARRAY_BYTES", 100_000, raising=False)
    monkeypatch.setattr(catalog, "new_path", lambda spark, name: str(tmp_path / name))
    found = catalog.QUERIES["ingest_json_array"](spark, sf_dir)
    files = list((tmp_path / "json-arrays").rglob("part-*.txt"))
    assert len(files) > 4 and max(f.stat().st_size for f in files) < 300_000
    assert sorted(map(str, found.collect())) == expected
