"""Distributed sinks: every task writes its own part, nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON object per row, keys in the given order, in column ``json``."""
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def write_json(df: DataFrame, path: str, *columns: str) -> None:
    df.select(*columns).write.mode("overwrite").json(path)


def write_delimited(df: DataFrame, path: str, delimiter: str = "|") -> None:
    """Delimited files with a header, as ``read_delimited`` reads them."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_documents(df: DataFrame, path: str) -> None:
    """Cleaned documents as Parquet rows keyed by name; not one small file per document."""
    df.write.mode("overwrite").parquet(path)


def bracketed(*columns: Column) -> Column:
    """``[a,b]``, the printed form of a row."""
    return F.concat(F.lit("["), F.concat_ws(",", *columns), F.lit("]"))
