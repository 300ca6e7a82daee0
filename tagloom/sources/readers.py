"""Records from delimited files, JSON payloads, JSON files, HTML folders and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import strip_control_characters
from tagloom.schema import APP_RECORD, CORRUPT_COLUMN, TRAINING_RECORD


# A table of fewer bytes is worth moving once, so that text work on it uses all cores.
SPREAD_BYTES = 256 * 1024 * 1024


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A Parquet table.

    A table of less than ``SPREAD_BYTES`` often has one row group, which is one task. With a
    ``key`` it is dealt to all cores; a larger table is read where it lies, without a shuffle.
    """
    df = spark.read.parquet(path)
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    if key is None or size >= SPREAD_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType = TRAINING_RECORD, delimiter: str = "|"
) -> DataFrame:
    """Delimited files with a header; a malformed line is kept in ``_corrupt_record``.

    Columns are found by their names in the header, in any order: those of ``schema`` that the
    files lack are NULL, others are left out. All files need the same header; one that differs
    is an error, not a wrong binding. One record per line, so Spark can split large files.
    """
    options = {"header": True, "sep": delimiter, "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    fields = [T.StructField(name, T.StringType()) for name in [*names, CORRUPT_COLUMN]]
    rows = (
        spark.read.schema(T.StructType(fields))
        .options(**options, enforceSchema=False, mode="PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .csv(path)
    )
    columns = [
        F.col(f"`{field.name}`") if field.name in names else F.lit(None).cast("string").alias(field.name)
        for field in schema.fields
    ]
    return rows.select(*columns, CORRUPT_COLUMN)


def parse_payloads(
    payloads: DataFrame, column: str, schema: T.StructType = TRAINING_RECORD
) -> DataFrame:
    """One row per record of every payload, a payload being a string with one JSON array.

    Raw control characters are deleted first; a field that a record lacks becomes NULL. A
    payload that is no JSON array of records is kept as one row with its text in ``_corrupt_record``;
    a NULL payload and an empty array have no records.
    """
    payload = strip_control_characters(F.col(column))
    records = F.from_json(payload, T.ArrayType(schema))
    names = schema.names
    good = F.transform(
        "_records",
        lambda record: F.struct(
            *[record.getField(name).alias(name) for name in names],
            F.lit(None).cast("string").alias(CORRUPT_COLUMN),
        ),
    )
    bad = F.array(
        F.struct(
            *[F.lit(None).cast("string").alias(name) for name in names],
            F.col("_payload").alias(CORRUPT_COLUMN),
        )
    )
    parsed = payloads.select(records.alias("_records"), payload.alias("_payload"))
    broken = F.col("_records").isNull() & F.col("_payload").isNotNull()
    return parsed.select(F.inline(F.when(broken, bad).otherwise(good)))


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType = APP_RECORD, one_array: bool = False
) -> DataFrame:
    """JSON files: one record per line, or ``one_array`` for files that hold one array each.

    A line or file that is no JSON is one row with its text in ``_corrupt_record``.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("multiLine", one_array)
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .json(path)
    )


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.html`` file of a folder as one row ``(file, text)``."""
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    )


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lines of a word-list file as ``word``, for ``lexicon.drop_words_by_table``."""
    words = spark.read.text(path).select(F.col("value").alias("word"))
    return words.where(F.col("word") != "").distinct()
