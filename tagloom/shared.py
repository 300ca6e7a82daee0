"""Intermediate tables in the folder that every executor of the cluster can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    # "local" and "local[...]" only: "local-cluster[...]" has executors of its own.
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tagloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has been given."""
    return f"{shared_folder(spark)}/tagloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and return a scan of it.

    Cuts the lineage at a table that outlives executors, and later readers get column
    pruning, pushed filters and the true size for the join strategy.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What a broadcast may take, and what a row takes beyond its text.
BROADCAST_BYTES = 128 * 1024 * 1024
ROW_BYTES = 96


def broadcast_size(df: DataFrame, *text_cols: str, row_bytes: int = ROW_BYTES) -> int:
    """Bytes that broadcasting ``df`` takes, measured on all of its rows."""
    text = F.lit(row_bytes).cast("long")
    for name in text_cols:
        text = text + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(text), F.lit(0)).alias("size")).first().size
