import json

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from tagloom.catalog import QUERIES
from tagloom.plans import corpus
from tagloom.schema import CORRUPT_COLUMN
from tagloom.shared import new_path, shared_folder
from tagloom.sources import folders, readers, writers


def test_payload(spark):
    payload = '[{"appId":"1","description":"a\nb"},{"appId":"2"}]'
    rows = readers.parse_payloads(spark.createDataFrame([(payload,)], "p string"), "p").collect()
    assert [tuple(row) for row in rows] == [
        ("1", None, None, "ab", None, None),
        ("2", None, None, None, None, None),
    ]


def test_broken_payloads_are_kept(spark):
    broken = ['[{"appId":"1"},{"appId":"2"', "not json"]
    payloads = [*broken, "[]", None, '[{"appId":"3"}]']
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    rows = readers.parse_payloads(df, "p").collect()
    assert [(row.appId, row[CORRUPT_COLUMN]) for row in rows] == [(None, p) for p in broken] + [("3", None)]


def test_delimited_roundtrip_and_bad_line(spark, tmp_path):
    records = spark.createDataFrame(
        [("007", "p", "n", ' say "hi" | bye ', "s")],
        "appId string, package string, appName string, description string, segment string",
    )
    path = str(tmp_path / "d")
    writers.write_delimited(records, path)
    back = readers.read_delimited(spark, path)
    assert back.drop(CORRUPT_COLUMN).collect() == records.collect()

    other = tmp_path / "other.txt"
    other.write_text("segment|description|extra|appId\nGames|chess game|x|7\n")
    row = readers.read_delimited(spark, str(other)).first()
    assert tuple(row) == ("7", None, None, "chess game", "Games", None)

    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.txt").write_text("appId|segment\n1|x\n")
    (tmp_path / "two" / "b.txt").write_text("segment|appId\nx|1\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_delimited(spark, str(tmp_path / "two")).collect()

    bad = tmp_path / "bad.txt"
    bad.write_text("appId|package|appName|description|segment\n1|a|b|c|d\n2|only\n")
    rows = readers.read_delimited(spark, str(bad)).orderBy("appId").collect()
    assert rows[0][CORRUPT_COLUMN] is None
    assert rows[1][CORRUPT_COLUMN] == "2|only"


def test_json_files(spark, tmp_path):
    one = tmp_path / "array.json"
    one.write_text(json.dumps([{"appId": "1", "description": "x"}, {"appId": "2"}]))
    assert readers.read_json_records(spark, str(one), one_array=True).count() == 2
    lines = tmp_path / "lines.json"
    lines.write_text('{"appId": "1"}\n{"appId": "2"}\n')
    assert readers.read_json_records(spark, str(lines)).count() == 2
    lines.write_text('{"appId": "1"}\n{"appId": \n')
    rows = readers.read_json_records(spark, str(lines)).orderBy("appId").collect()
    assert [(row.appId, row[CORRUPT_COLUMN]) for row in rows] == [(None, '{"appId": '), ("1", None)]


def test_html_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Hello\nworld</p>")
    (tmp_path / "b.txt").write_text("no")
    rows = readers.read_html_folder(spark, str(tmp_path)).collect()
    assert [tuple(row) for row in rows] == [("a.html", "<p>Hello\nworld</p>")]


def test_word_list(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("the\nand\nthe\n\n")
    words = readers.read_word_list(spark, str(path))
    assert sorted(row.word for row in words.collect()) == ["and", "the"]


def test_json_rows_and_brackets(spark):
    df = spark.createDataFrame([("1", "Arts & Entertainment", 2)], "appId string, f string, x int")
    assert writers.json_rows(df, "appId", "f").first().json == '{"appId":"1","f":"Arts & Entertainment"}'
    assert df.select(writers.bracketed(F.col("appId"), F.col("f")).alias("t")).first().t == (
        "[1,Arts & Entertainment]"
    )


def test_clean_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>The Cats\nran 12 miles</p>")
    target = str(tmp_path / "out")
    corpus.clean_folder(spark, str(tmp_path / "in"), target)
    assert [tuple(row) for row in spark.read.parquet(target).collect()] == [("a.html", "cats ran miles")]


def test_small_table_is_spread_and_large_is_not(spark, sf_dir, monkeypatch):
    path = f"{sf_dir}/documents.parquet"
    cores = spark.sparkContext.defaultParallelism
    assert readers.read_table(spark, path, "doc_id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(readers, "SPREAD_BYTES", 1000)
    plan = readers.read_table(spark, path, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_files_are_dealt_into_tasks_of_like_size(spark):
    rows = [(f"f{i}", 40 + (i * 7919) % 5000) for i in range(4000)] + [(f"big{i}", 60_000) for i in range(16)] + [("none", 0)]
    files = spark.createDataFrame(rows, "file string, size long")
    dealt = folders.dealt(files, 8)
    assert dealt.count() == len(rows) == dealt.select("file").distinct().count()
    sizes = [r.size for r in dealt.groupBy("task").agg(F.sum("size").alias("size")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * min(sizes)


def test_packed_folder_and_rerun(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(40):
        (source / f"page {i}.html").write_text(f"<p>The Cats number{'x' * i * 50}\nran</p>")
    (source / "other.txt").write_text("not read")
    packed = folders.read_packed(spark, str(source), task_bytes=10_000)
    assert packed.count() == 40
    found = packed.groupBy("task", F.spark_partition_id().alias("p")).agg(F.sum(F.length("text")).alias("size")).collect()
    assert len(found) == len({r.p for r in found}) == len({r.task for r in found}) > 2
    assert max(r["size"] for r in found) <= 2 * min(r["size"] for r in found)
    rows = []
    for _ in range(2):
        corpus.clean_folder_parts(spark, str(source), target, task_bytes=10_000)
        rows.append(sorted(map(str, spark.read.parquet(target).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 40
    (tmp_path / "none").mkdir()
    assert folders.read_packed(spark, str(tmp_path / "none")).count() == 0


def test_a_folder_is_listed_once(spark, tmp_path, monkeypatch):
    texts = {"a.html": "one\r\ntwo \u00e9", "b.html": "\n", "c.html": "\ufeffthree\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    loads = []
    for method in ("load", "text"):
        whole = getattr(DataFrameReader, method)
        monkeypatch.setattr(
            DataFrameReader, method, lambda self, *a, whole=whole, **kw: loads.append(1) or whole(self, *a, **kw)
        )
    rows = folders.read_packed(spark, str(tmp_path)).collect()
    assert len(loads) == 1
    assert {r.file.split("/")[-1]: r.text for r in rows} == texts


ODD_PAGES = [(1, "<p>The Cats</p>"), (1, "ran\r\n12 miles"), (2, "same"), (2, "same"), (-3, "é \U0001f600\n"), (None, "none"), (4, "")]


def test_rows_are_files_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, html string")
    # Bytes that are no UTF-8 stay as they are.
    pages = pages.unionByName(spark.sql("SELECT 5L AS page_id, CAST(X'61FF62' AS STRING) AS html"))
    path = str(tmp_path / "pages")
    for _ in range(2):
        folders.write_files(pages, path, "page_id", "html")
    found = folders.read_packed(spark, path, "*.txt", recursive=True)
    key = F.regexp_extract("file", "page_id=(.+?)-[0-9A-F]+-[0-9]", 1)
    rows = sorted(map(tuple, found.select(key, F.col("text").cast("binary")).collect()))
    null = "__HIVE_DEFAULT_PARTITION__"
    wanted = [(null if i is None else str(i), text.encode() + b"\n") for i, text in ODD_PAGES] + [("5", b"a\xffb\n")]
    assert [(k, bytes(v)) for k, v in rows] == sorted(wanted)
    assert found.select("file").distinct().count() == len(wanted)
    # A folder holds many files.
    assert len(list((tmp_path / "pages").iterdir())) == 1


def test_a_folder_is_listed_in_groups(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"part={i}" / "deep").mkdir(parents=True)
        (tmp_path / f"part={i}" / "deep" / f"a b#{i}%.txt").write_text(f"text {i}")
    (tmp_path / "top.txt").write_text("top")
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "no.txt").write_text("no")
    (tmp_path / ".no.txt").write_text("no")
    path = str(tmp_path)
    found = folders.groups(spark, path, True, listed=4)
    assert sorted(map(len, found)) == [1, 1, 4, 4]
    whole = folders.listing(spark, path, "*.txt", True)
    kept = folders._kept(spark, (folders.listing(spark, group, "*.txt", True) for group in found))
    assert sorted(kept.collect()) == sorted(whole.collect()) and kept.count() == 10
    packed = folders.read_packed(spark, path, "*.txt", True)
    assert sorted(r.text for r in packed.collect()) == sorted([*(f"text {i}" for i in range(9)), "top"])
    # Files are read where they are dealt to: no scan of contents and so no exchange of them.
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "content" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert folders.groups(spark, path, False, listed=4) == folders.groups(spark, path, True, listed=99) == [path]


def test_stores_that_only_spark_reads(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./in", f"file://{tmp_path}")
    path, pages = "viewfs://tests/in/pages", spark.createDataFrame(ODD_PAGES, "page_id long, html string")
    assert folders.mounted(spark, path) is None and folders.mounted(spark, str(tmp_path)) == str(tmp_path)
    folders.write_files(pages, path, "page_id", "html")
    texts = [r.text for r in folders.read_packed(spark, path, "*.txt", recursive=True).collect()]
    assert sorted(texts) == sorted(text + "\n" for _, text in ODD_PAGES)


def test_folder_roundtrip_of_shared_and_odd_ids(spark, tmp_path):
    spark.createDataFrame(ODD_PAGES, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = QUERIES["clean_folder_roundtrip"](spark, str(tmp_path)).collect()
    wanted = [(1, "cats"), (1, "ran miles"), (2, ""), (2, ""), (4, ""), (None, "none")]
    assert sorted((r.page_id or 0, r.cleaned) for r in rows if r.page_id != -3) == sorted((i or 0, t) for i, t in wanted)
    assert len(rows) == len(ODD_PAGES)
