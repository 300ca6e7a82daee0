"""Classification of a stream of records with a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

FILES_PER_TRIGGER = 200


def read_record_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Parquet files of a folder as they arrive, a bounded number per micro-batch.

    A path with ``*`` names files as well as folders of files, such as a table of either form.
    """
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
        .parquet(path)
    )


def score_stream(
    records: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score every micro-batch with ``score`` and write it under ``path``.

    A record is scored from its own text alone, so no state is kept between batches and no
    watermark is needed. Each batch overwrites its own ``batch=`` folder: a batch that is
    repeated after a failure replaces its earlier attempt.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
