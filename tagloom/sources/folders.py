"""Folders of many small files: tasks of equal size from a listing, and tables that reruns replace.

The listing has one row a file and no contents. Files are numbered within classes of like size (a class
spans a factor of two) and dealt round the tasks in that order, the largest class first; every task gets
as many files of each class as any other, give or take one. Contents do not move: the task that a file was
dealt to reads it, and so does the task that has a file's row when files are written.

Files of a file system that machines mount are opened by Python workers, because Hadoop's classes fork a
process for each file they make there. Other stores are read and written by Spark's own sources.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.shared import new_path

# Bytes of files that a task takes.
TASK_BYTES = 32 * 1024 * 1024
# Groups in which files of a class are numbered, so that no task numbers a whole class.
NUMBERED = 256
# Parts of a table of documents, by a hash of the file's name.
PARTS = 64
# Files in a folder that is written, and folders whose listing the driver holds at a time; it lists more
# than 32 folders in tasks, not by itself.
FOLDER_FILES = 2000
LISTED = 64
# A folder with more children than that is listed whole.
CHILDREN = 20_000
# Bytes of contents that a Python worker holds at a time, besides one file.
HELD_BYTES = 4 * 1024 * 1024


def _located(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path, and the path with its scheme."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system, system.makeQualified(found)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path for ``open()``, or None if only Hadoop's classes reach it."""
    uri = _located(spark, path)[1].toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _files(spark: SparkSession, path: str | list[str], pattern: str, recursive: bool) -> DataFrame:
    """The files of a folder, listed once however often the table is read; their contents are read only if asked for."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )


def _sizes(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def listing(spark: SparkSession, path: str, pattern: str = "*.html", recursive: bool = False) -> DataFrame:
    """``(file, size)`` of the files of a folder; no content is read."""
    return _sizes(_files(spark, path, pattern, recursive))


def groups(spark: SparkSession, path: str, recursive: bool = False, listed: int = LISTED) -> list[str | list[str]]:
    """The folder as paths to list one after the other: ``listed`` folders of it at a time, and the files beside them."""
    special = set("{}[]*?\\")
    if not recursive or special & set(path):
        return [path]
    system, whole = _located(spark, path)
    children = system.listStatus(whole)
    if not listed < len(children) <= CHILDREN:
        return [path]
    files, folders = [], []
    for child in children:
        name = child.getPath().getName()
        # Spark does not list these.
        if not name.startswith(".") and not (name.startswith("_") and "=" not in name):
            (folders if child.isDirectory() else files).append(child.getPath().toString())
    if any(special & set(child) for child in files + folders):
        return [path]
    return [group for group in (files, *(folders[i : i + listed] for i in range(0, len(folders), listed))) if group]


def _kept(spark: SparkSession, listings: Iterator[DataFrame]) -> DataFrame:
    """The listings as one table, each written before the next one is made."""
    path = new_path(spark, "listing")
    for files in listings:
        # A scan has a partition for some thirty small files.
        files.coalesce(4 * spark.sparkContext.defaultParallelism).write.mode("append").parquet(path)
    return spark.read.schema("file string, size long").parquet(path)


def dealt(files: DataFrame, tasks: int) -> DataFrame:
    """``(file, size, task)``: every file of ``files(file, size)`` with one of ``tasks`` of like total size."""
    numbered = files.withColumn(
        "_class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    ).withColumn("_group", F.pmod(F.xxhash64("file"), F.lit(NUMBERED)).cast("int"))
    # One row per class and group: some thousands, however many files there are.
    counts = numbered.groupBy("_class", "_group").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(F.col("_class").desc(), "_group").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_class", "_group", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    in_group = Window.partitionBy("_class", "_group").orderBy(F.col("size").desc(), "file")
    place = F.row_number().over(in_group) - 1 + F.col("_before")
    return numbered.join(before, ["_class", "_group"]).select(
        "file", "size", (place % F.lit(tasks)).cast("int").alias("task")
    )


def read_packed(
    spark: SparkSession,
    path: str,
    pattern: str = "*.html",
    recursive: bool = False,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """``(file, text, task)``: every file as one row, in tasks of about ``task_bytes`` each.

    A file is never cut: one larger than a task makes its task larger. An empty folder gives no rows.
    A folder of few bytes is dealt to all cores.
    """
    if mounted(spark, path) is None:
        whole = _files(spark, path, pattern, recursive)
        files = _kept(spark, iter([_sizes(whole)]))
    else:
        whole = None
        files = _kept(spark, (listing(spark, group, pattern, recursive) for group in groups(spark, path, recursive)))
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, min(total.n, max(spark.sparkContext.defaultParallelism, -(-total.size // task_bytes))))
    placed = dealt(files, tasks)
    if whole is None:
        return placed.repartitionById(tasks, F.col("task")).mapInArrow(
            _reader(), "file string, content binary, task int"
        ).select("file", F.col("content").cast("string").alias("text"), "task")
    contents = whole.select(F.col("_metadata.file_path").alias("file"), F.col("content").cast("string").alias("text"))
    return contents.join(placed.select("file", "task"), "file").repartitionById(tasks, F.col("task"))


def _reader() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(file, content, task)`` of rows ``(file, size, task)``."""

    def packed(files: list[str], contents: list[bytes], tasks: list[int]) -> pa.RecordBatch:
        columns = [pa.array(files, pa.string()), pa.array(contents, pa.binary()), pa.array(tasks, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["file", "content", "task"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, contents, tasks, held = [], [], [], 0
            for file, task in zip(batch.column("file").to_pylist(), batch.column("task").to_pylist(), strict=True):
                with open(unquote(urlsplit(file).path), "rb") as source:
                    content = source.read()
                if contents and held + len(content) > HELD_BYTES:
                    yield packed(files, contents, tasks)
                    files, contents, tasks, held = [], [], [], 0
                files.append(file)
                contents.append(content)
                tasks.append(task)
                held += len(content)
            if contents:
                yield packed(files, contents, tasks)

    # A function of a function goes to the workers by value: they need no copy of this module.
    return read


def write_files(docs: DataFrame, path: str, key: str, text: str) -> None:
    """Every row of ``docs`` as a text file of its own, ``key=value`` in its path; a NULL text is an empty file.

    Rows that share a key have a file each. Their names depend on the rows only, so that a task that
    runs again replaces its files.
    """
    spark = docs.sparkSession
    folder = mounted(spark, path)
    if folder is None:
        docs.select(key, text).write.partitionBy(key).option("maxRecordsPerFile", 1).text(path)
        return
    rows = docs.select(F.xxhash64(key, F.xxhash64(text)).alias("row"), F.spark_partition_id().alias("partition"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("distinct")).first()
    count = -(-total.n // FOLDER_FILES) or 1
    named = docs.select(
        F.pmod(F.xxhash64(key), F.lit(count)).alias("folder"),
        F.col(key).cast("string").alias("key"),
        F.hex(F.xxhash64(text)).alias("digest"),
        F.col(text).cast("binary").alias("content"),
    )
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, copies, written = set(), {}, 0
        for batch in batches:
            *names, contents = batch.columns
            for row, (number, value, digest) in enumerate(zip(*(column.to_pylist() for column in names), strict=True)):
                place = f"{folder}/part={number:05d}"
                if place not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(place)
                value = "__HIVE_DEFAULT_PARTITION__" if value is None else quote(value, safe=" ")
                copy = copies[value, digest] = copies.get((value, digest), -1) + 1
                name = f"{key}={value}-{digest}-{copy}.txt"
                # Under another name until it is whole, which no listing finds.
                part = f"{place}/.{name}.{os.getpid()}"
                with open(part, "wb") as target:
                    target.write(contents[row].as_buffer() or b"")
                    target.write(b"\n")
                os.replace(part, f"{place}/{name}")
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    # Rows are written where they stand, unless few tasks have most of them or there are equal ones:
    # those go to one task, which numbers them.
    most = rows.groupBy("partition").count().agg(F.max("count").alias("n")).first().n or 0
    if total.distinct < total.n or most > max(FOLDER_FILES, 2 * total.n // spark.sparkContext.defaultParallelism):
        named = named.repartition("key", "digest")
    named.mapInArrow(write, "n long").agg(F.sum("n")).first()


def write_parts(docs: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Write ``docs`` in ``parts`` by a hash of ``key``; a part that is written again is replaced.

    A rerun over the same files leaves the same rows, one over some files replaces their parts only:
    give all files of a part together.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    (
        docs.select("*", part)
        .repartition(parts, "part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )
