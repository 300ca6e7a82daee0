"""One huge JSON array as a table: byte ranges of the file are read by as many tasks.

Spark's text source splits a file at any byte string, here at ``}``, so a fragment never tears a
character and ends where a record may end. Whether it does depends on all that comes before: whether the
brace stands within a string, and how deep it is nested. Both add up: a fragment changes the string state by
its unescaped quotes and the depth by the brackets outside of strings. Sums of whole ranges are carried
over first, one row a range; then every range adds up its own fragments. A record is what lies between
two braces that lead back to the depth of the array, and fragments of a record meet wherever a range cut it.
Column expressions only; the text is written once and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.schema import APP_RECORD, CORRUPT_COLUMN
from tagloom.shared import materialize

# Bytes that a mark of byte order takes at the start of a file; Spark's reader leaves it out.
MARK = 3


def read_json_array(
    spark: SparkSession, path: str, schema: T.StructType = APP_RECORD
) -> DataFrame:
    """The records of JSON files that hold one array of objects each.

    A field that a record lacks is NULL. An object that does not parse, or before which something else
    stands in the array, is one row with its text in ``_corrupt_record``; so is what is left of a file that ends
    too early or is no array. An empty file and an empty array have no records. A task reads
    ``spark.sql.files.maxPartitionBytes`` of a file.
    """
    records = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
    parsed = F.from_json(
        F.when(F.col("ended") & F.col("text").startswith("{"), F.col("text")),
        records,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN},
    )
    rows = record_texts(spark, path).select("text", parsed.alias("r"))
    fields = [F.col(f"r.`{name}`").alias(name) for name in schema.names]
    corrupt = F.when(F.col("r").isNull(), F.col("text")).otherwise(F.col(f"r.{CORRUPT_COLUMN}"))
    return rows.select(*fields, corrupt.alias(CORRUPT_COLUMN))


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, text, ended)`` of all records, numbered from 0 in their file.

    ``ended`` is false for what stands after the last record; the closing bracket is left out.
    """
    fragments = _fragments(spark, path)
    quotes = _carried(fragments.groupBy("file", "start").agg(F.sum("quotes").alias("sum")), "quotes_before")
    in_range = Window.partitionBy("file", "start").orderBy("nth")
    before = in_range.rowsBetween(Window.unboundedPreceding, -1)
    # Within a string: an odd number of quotes so far.
    so_far = F.coalesce(F.sum("quotes").over(before), F.lit(0)) + F.col("quotes_before")
    stated = fragments.join(F.broadcast(quotes), ["file", "start"]).withColumn("inside", (so_far % 2).cast("int"))
    closes = F.col("brace") & ((F.col("inside") + F.col("quotes")) % 2 == 0)
    change = _outside_brackets(F.col("value"), F.col("inside")) - closes.cast("int")
    text = F.when(F.col("brace"), F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    deep = materialize(
        stated.select("file", "start", "nth", text.alias("fragment"), closes.alias("closes"), change.alias("change")),
        "json-fragments",
    )
    depths = _carried(deep.groupBy("file", "start").agg(F.sum("change").alias("sum")), "depth_before")
    depth = F.sum("change").over(in_range) + F.col("depth_before")
    # A record ends where a brace outside of strings leads back to the depth of the array.
    ends = deep.join(F.broadcast(depths), ["file", "start"]).withColumn("depth", depth).withColumn(
        "ends", ((F.col("depth") == 1) & F.col("closes")).cast("int")
    )
    ended = _carried(ends.groupBy("file", "start").agg(F.sum("ends").alias("sum")), "records_before")
    number = F.coalesce(F.sum("ends").over(before), F.lit(0)) + F.col("records_before")
    numbered = ends.join(F.broadcast(ended), ["file", "start"]).withColumn("record", number)
    in_order = F.array_sort(F.collect_list(F.struct("start", "nth", "fragment")))
    whole = numbered.groupBy("file", "record").agg(
        F.array_join(in_order["fragment"], "").alias("text"), (F.max("ends") == 1).alias("ended")
    )
    # Before the first record stands the bracket, before others a comma.
    lead = F.when(F.col("record") == 0, F.lit(r"^\s*\[?\s*")).otherwise(F.lit(r"^\s*,?\s*"))
    text = F.regexp_replace(F.regexp_replace("text", lead, F.lit("")), r"\s+$", "")
    text = F.when(F.col("ended"), text).otherwise(F.regexp_replace(text, r"^\]$", ""))
    return whole.select("file", "record", text.alias("text"), "ended").where(F.col("text") != "")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, nth, value, quotes, brace)`` in the order of the files' bytes.

    ``start`` is where the task's range begins, ``nth`` rises within it; ``brace`` is whether a brace follows:
    the last fragment of a file has none unless the file ends with it, which the file's size tells.
    """
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("nth"),
        "value",
    )
    files = lines.groupBy("file").agg(
        (F.sum(F.octet_length("value") + 1) - F.max("size")).alias("excess"),
        F.max(F.struct("start", "nth")).alias("last"),
    )
    is_last = (F.col("start") == F.col("last.start")) & (F.col("nth") == F.col("last.nth"))
    phantom = is_last & F.col("excess").isin(1, 1 - MARK)
    # One row a file: joined by its name, all of a file would meet in one task.
    return lines.join(F.broadcast(files), "file").select(
        "file", "start", "nth", "value", _quotes(F.col("value")).alias("quotes"), (~phantom).alias("brace")
    )


def _unescaped(value: Column) -> Column:
    # A backslash and what it escapes stand in one fragment: a brace is never escaped.
    return F.regexp_replace(value, r"\\.", "")


def _quotes(value: Column) -> Column:
    return F.length(F.regexp_replace(_unescaped(value), r'[^"]+', ""))


def _outside_brackets(value: Column, inside: Column) -> Column:
    """Opening less closing brackets outside of strings; ``inside`` is 1 if the fragment begins within one."""
    pieces = F.split(_unescaped(value), '"')
    outside = F.array_join(F.filter(pieces, lambda _, i: (i + inside) % 2 == 0), "")
    opening = F.length(F.regexp_replace(outside, r"[^{\[]+", ""))
    return opening - F.length(F.regexp_replace(outside, r"[^\]]+", ""))


def _carried(sums: DataFrame, name: str) -> DataFrame:
    """``(file, start, name)``: what all earlier ranges of the file add up to; one row a range."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "start", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias(name))
